"""Queries of the dependency audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import advisories as adv
from ..functions import compliance, dependency_risk, versions
from ..operators import audit, catalog
from ..sources import feeds, manifests
from .registry import placed, query, view

VERSION = "concat(cast(l_quantity AS INT) % 5, '.', l_linenumber, '.', l_suppkey % 10)"

view(
    "v_deps",
    f"""
SELECT l_orderkey AS project_id, l_linenumber AS o1, l_partkey AS o2, l_suppkey AS o3,
  CASE l_returnflag WHEN 'A' THEN 'producción' WHEN 'N' THEN 'desarrollo' ELSE 'peer' END AS section,
  'pkg-' || l_partkey AS package,
  CASE l_linenumber % 7 WHEN 1 THEN '^' || {VERSION} WHEN 2 THEN '~' || {VERSION} WHEN 3 THEN '>=' || {VERSION}
    WHEN 4 THEN {VERSION} WHEN 5 THEN '*' WHEN 6 THEN 'git+https://x/' || {VERSION}
    ELSE 'workspace:' || {VERSION} END AS spec
FROM lineitem""",
)
view(
    "v_declared",
    """
SELECT *, CASE WHEN spec = '*' OR regexp_matches(spec, '^(git|workspace:)') THEN NULL
    ELSE nullif(regexp_extract(spec, '\\d+(\\.\\d+){0,2}'), '') END AS installed,
  regexp_matches(spec, '^[0-9]') AS pinned
FROM v_deps""",
)
view(
    "v_registry",
    f"""
SELECT DISTINCT 'pkg-' || l_partkey AS package,
  {VERSION} || CASE WHEN round(100 * l_discount) = 10 THEN '-beta.1' ELSE '' END AS version
FROM lineitem""",
)
view(
    "v_stable",
    """
SELECT package, version, list_transform(string_split(version, '.'), lambda x: cast(x AS INT)) AS sv
FROM v_registry WHERE NOT contains(version, '-')""",
)
view(
    "v_newest",
    """
SELECT 'pkg-' || p_partkey AS package,
  CASE WHEN p_partkey % 13 = 0 THEN 'not-found' WHEN p_partkey % 17 = 0 THEN 'neterror' ELSE 'found' END AS lookup,
  'https://home/' || p_partkey AS homepage, 'git+https://x/' || p_partkey || '.git' AS repository,
  CASE WHEN p_partkey % 50 = 7 THEN 'valida rut chileno' WHEN p_partkey % 70 = 9 THEN 'consulta rut y nombre'
    ELSE p_name || ' ' || p_type END AS description,
  b.latest
FROM part LEFT JOIN (SELECT package, arg_max(version, sv) AS latest FROM v_stable GROUP BY 1) b
  ON b.package = 'pkg-' || p_partkey""",
)
view(
    "v_advisories",
    """
SELECT event_id, 'OSV-' || event_id AS osv_id, 'pkg-' || (event_id % 2000) AS package,
  concat(event_id % 5, '.', 1 + event_id % 7, '.', user_id % 10) AS version,
  CASE WHEN event_id % 2 = 0 THEN 'CVE-2024-' || event_id END AS cve,
  CASE event_id % 4 WHEN 0 THEN cast(cast(floor(value / 49) AS INT) AS VARCHAR) WHEN 1 THEN 'HIGH'
    WHEN 2 THEN 'CVSS:3.1/AV:N/AC:L' END AS severity,
  CASE WHEN event_id % 40 = 0 THEN 'malware in pkg-' || (event_id % 2000) ELSE 'issue ' || event_id END AS summary,
  'details of ' || event_id AS details, strftime(ts, '%Y-%m-%d') AS published
FROM events WHERE event_type = 'error'""",
)
view(
    "v_details",
    """
SELECT event_id, osv_id, coalesce(cve, osv_id) AS id, severity, summary, details, published,
  CASE WHEN cve IS NULL THEN '' ELSE 'GHSA-' || event_id || ',' || cve END AS aliases
FROM (SELECT * REPLACE (CASE WHEN event_id % 11 = 0 THEN 'GONE-' || event_id ELSE osv_id END AS osv_id) FROM v_advisories)""",
)
view(
    "v_listed",
    """
SELECT a.package, a.version, a.pos, a.n, a.osv_id, coalesce(d.id, a.osv_id) AS id, d.severity,
  coalesce(d.summary, '') AS summary, coalesce(d.details, '') AS details,
  CASE WHEN try_cast(d.severity AS DOUBLE) IS NOT NULL THEN
      CASE WHEN try_cast(d.severity AS DOUBLE) >= 9 THEN 4 WHEN try_cast(d.severity AS DOUBLE) >= 7 THEN 3
        WHEN try_cast(d.severity AS DOUBLE) >= 4 THEN 2 WHEN try_cast(d.severity AS DOUBLE) > 0 THEN 1 END
    WHEN contains(d.severity, 'CRITICAL') THEN 4 WHEN contains(d.severity, 'HIGH') THEN 3
    WHEN contains(d.severity, 'MEDIUM') THEN 2 WHEN contains(d.severity, 'LOW') THEN 1 END AS band
FROM (SELECT *, row_number() OVER (PARTITION BY package, version ORDER BY osv_id) AS pos,
        count(*) OVER (PARTITION BY package, version) AS n FROM v_advisories) a
LEFT JOIN v_details d ON d.osv_id = a.osv_id""",
)
view(
    "v_by_version",
    """
SELECT package, version, max(n) AS n, array_to_string(list(id ORDER BY pos) FILTER (WHERE pos <= 8), ', ') AS ids, max(band) AS band,
  first(id ORDER BY pos) FILTER (WHERE contains(summary || ' ' || details, 'malware')) AS malware_id,
  coalesce(array_to_string(list(id || ': ' || summary ORDER BY pos) FILTER (WHERE pos <= 8 AND summary <> ''), ' | '), '')
    AS first_risks
FROM v_listed GROUP BY ALL""",
)
view(
    "v_with_newest",
    """
SELECT d.*, n.lookup, n.homepage, n.repository, n.description,
  CASE WHEN n.lookup = 'found' THEN n.latest END AS latest,
  CASE WHEN n.lookup = 'neterror' THEN 'neterror' WHEN n.lookup IS DISTINCT FROM 'found' THEN
    CASE WHEN d.installed IS NULL THEN 'spec no resoluble (git/url/alias)' ELSE 'no encontrado en npm' END END AS note
FROM v_declared d LEFT JOIN v_newest n USING (package)""",
)
view(
    "v_gap",
    """
SELECT *, i < l AS outdated,
  CASE WHEN i >= l THEN 'al día' WHEN i[1] <> l[1] THEN 'major' WHEN i[2] <> l[2] THEN 'minor'
    WHEN i[3] <> l[3] THEN 'patch' END AS gap
FROM (SELECT *, list_transform(string_split(installed, '.'), lambda x: cast(x AS INT)) AS i,
        list_transform(string_split(latest, '.'), lambda x: cast(x AS INT)) AS l FROM v_with_newest)""",
)
view(
    "v_entries",
    """
SELECT g.*, k AS lookable,
  CASE WHEN k THEN CASE WHEN v.n > 0 THEN 'vulnerable' ELSE 'clean' END END AS vuln_status,
  CASE WHEN k THEN coalesce(v.n, 0) END AS vuln_count,
  CASE WHEN k THEN v.ids END AS vuln_ids, CASE WHEN k THEN v.band END AS band,
  CASE WHEN k THEN v.first_risks END AS first_risks, CASE WHEN k THEN v.malware_id END AS malware_id,
  CASE WHEN k AND v.malware_id IS NOT NULL THEN 'crítico' WHEN contains(description, 'consulta rut') THEN 'alto'
    WHEN contains(description, 'valida rut') THEN 'medio' END AS legal_level
FROM (SELECT *, installed IS NOT NULL AND note IS DISTINCT FROM 'neterror' AS k FROM v_gap) g
LEFT JOIN v_by_version v ON v.package = g.package AND v.version = g.installed""",
)
view(
    "v_rated",
    """
SELECT *, CASE rank WHEN 4 THEN 'crítico' WHEN 3 THEN 'alto' WHEN 2 THEN 'medio' WHEN 1 THEN 'bajo'
    ELSE CASE WHEN note = 'neterror' THEN 'desconocido' ELSE 'ok' END END AS level,
  CASE band WHEN 4 THEN 'crítica' WHEN 3 THEN 'alta' WHEN 2 THEN 'media' WHEN 1 THEN 'baja' END AS severity
FROM (SELECT *,
  greatest(CASE WHEN coalesce(vuln_count, 0) = 0 THEN 0 WHEN band = 4 THEN 4 WHEN band = 3 THEN 3 ELSE 2 END,
    CASE gap WHEN 'major' THEN 2 WHEN 'minor' THEN 1 WHEN 'patch' THEN 1 ELSE 0 END,
    CASE legal_level WHEN 'crítico' THEN 4 WHEN 'alto' THEN 3 WHEN 'medio' THEN 2 ELSE 0 END) AS rank,
  CASE WHEN coalesce(vuln_count, 0) = 0 THEN 0.0
    ELSE CASE band WHEN 4 THEN 10 WHEN 3 THEN 7 WHEN 2 THEN 4 WHEN 1 THEN 2 ELSE 3 END + 0.5 * least(vuln_count, 5) END
  + CASE gap WHEN 'major' THEN 3.0 WHEN 'minor' THEN 1.5 WHEN 'patch' THEN 0.5 ELSE 0 END
  + CASE legal_level WHEN 'crítico' THEN 12 WHEN 'alto' THEN 8 WHEN 'medio' THEN 4 ELSE 0 END AS score
  FROM v_entries)""",
)


# ---- sources and sections


def npm_manifests(t):
    """package.json texts built from the declared dependencies: one document per order, some of them broken."""
    pair = lambda label: F.map_from_entries(
        F.array_distinct(
            F.transform(
                F.filter("rows", lambda r: r["section"] == label), lambda r: F.struct(r["package"], r["spec"])
            )
        )
    )
    # Dealt by project first, so that neither grouping shuffles again.
    unique = t.deps.repartition("project_id").groupBy("project_id", "section", "package").agg(F.max("spec").alias("spec"))
    grouped = unique.groupBy("project_id").agg(F.collect_list(F.struct("section", "package", "spec")).alias("rows"))
    body = F.to_json(
        F.struct(
            F.concat(F.lit("app-"), "project_id").alias("name"),
            F.lit("1.0.0").alias("version"),
            pair("producción").alias("dependencies"),
            pair("desarrollo").alias("devDependencies"),
            pair("peer").alias("peerDependencies"),
        )
    )
    broken = F.col("project_id") % 29 == 0
    return grouped.select("project_id", F.when(broken, F.concat(body, F.lit("}{"))).otherwise(body).alias("content"))


@query(
    "src_01_npm_manifest",
    """
SELECT DISTINCT l_orderkey AS project_id, l_orderkey % 29 <> 0 AS ok,
  CASE WHEN l_orderkey % 29 <> 0 THEN 'app-' || l_orderkey END AS name FROM lineitem""",
)
def src_01(t):
    parsed = manifests.parse_npm(npm_manifests(t))
    return parsed.select("project_id", "ok", F.when(F.col("ok"), F.col("doc.name")).alias("name"))


@query(
    "u_01_npm_sections",
    """
SELECT project_id, section, package, max(spec) AS spec FROM v_deps WHERE project_id % 29 <> 0 GROUP BY ALL""",
)
def u_01(t):
    return manifests.npm_dependencies(manifests.parse_npm(npm_manifests(t))).drop("ord")


@query(
    "src_05_registry_document",
    """
SELECT 'pkg-' || l_partkey AS package, count(DISTINCT l_linenumber) AS versions, min(l_linenumber) || '.0.0' AS latest_tag,
  max(strftime(l_shipdate, '%Y-%m-%dT00:00:00')) AS newest_release
FROM lineitem GROUP BY l_partkey""",
)
def src_05(t):
    rows = t.table("lineitem").groupBy("l_partkey", "l_linenumber").agg(F.max("l_shipdate").alias("d"))
    entry = F.struct(
        F.concat(F.col("l_linenumber"), F.lit(".0.0")).alias("key"),
        F.date_format("d", "yyyy-MM-dd'T'HH:mm:ss").alias("value"),
    )
    grouped = rows.groupBy("l_partkey").agg(
        F.map_from_entries(F.collect_list(entry)).alias("time"), F.min("l_linenumber").alias("tag")
    )
    body = F.to_json(
        F.struct(
            F.transform_values("time", lambda k, v: F.create_map(F.lit("dist"), k)).alias("versions"),
            "time",
            F.create_map(F.lit("latest"), F.concat(F.col("tag"), F.lit(".0.0"))).alias("dist-tags"),
        )
    )
    documents = grouped.select(F.concat(F.lit("pkg-"), "l_partkey").alias("package"), body.alias("body"))
    return (
        feeds.registry_versions(documents)
        .groupBy("package", "latest_tag")
        .agg(F.count("*").alias("versions"), F.max("released").alias("newest_release"))
    )


@query(
    "src_06_newest_document",
    """
SELECT 'pkg-' || p_partkey AS package,
  CASE WHEN p_partkey % 13 = 0 THEN 'not-found' WHEN p_partkey % 17 = 0 THEN 'neterror' ELSE 'found' END AS lookup,
  CASE WHEN p_partkey % 13 <> 0 AND p_partkey % 17 <> 0 THEN p_size || '.0.0' END AS latest,
  CASE WHEN p_partkey % 13 <> 0 AND p_partkey % 17 <> 0 THEN 'https://x/' || p_partkey END AS repository,
  CASE WHEN p_partkey % 13 <> 0 AND p_partkey % 17 <> 0 THEN repeat(p_name || ' ', 30) END AS description
FROM part""",
)
def src_06(t):
    k = F.col("p_partkey")
    url = F.concat(F.lit("git+https://x/"), k, F.lit(".git"))
    common = [F.concat("p_size", F.lit(".0.0")).alias("version"), F.repeat(F.concat("p_name", F.lit(" ")), 30).alias("description")]
    body = F.when(k % 2 == 0, F.to_json(F.struct(*common, url.alias("repository")))).otherwise(
        F.to_json(F.struct(*common, F.struct(url.alias("url")).alias("repository")))
    )
    documents = t.table("part").select(
        F.concat(F.lit("pkg-"), k).alias("package"),
        F.when(k % 13 == 0, 404).when(k % 17 == 0, 503).otherwise(200).alias("http_status"),
        body.alias("body"),
    )
    return feeds.newest_documents(documents).drop("homepage")


@query(
    "src_08_advisory_document",
    """
SELECT osv_id, coalesce(cve, osv_id) AS id, severity, summary, published FROM v_advisories""",
)
def src_08(t):
    body = F.to_json(
        F.struct(
            F.col("osv_id").alias("id"),
            "aliases",
            F.col("severities").alias("severity"),
            "references",
            "summary",
            "details",
            "published",
        )
    )
    shaped = feeds.advisory_details(t.advisories.select(body.alias("body")))
    return shaped.select("osv_id", "detail.id", "detail.severity", "detail.summary", "detail.published")


# ---- scalars over declared versions


@query("s_03_semver", "SELECT package, version, cast(regexp_extract(version, '^(\\d+)\\.', 1) AS BIGINT) AS major,"
       " cast(regexp_extract(version, '^\\d+\\.(\\d+)', 1) AS BIGINT) AS minor,"
       " cast(regexp_extract(version, '^\\d+\\.\\d+\\.(\\d+)', 1) AS BIGINT) AS patch FROM v_registry")
def s_03(t):
    return t.registry.withColumn("v", versions.semver(F.col("version"))).select("package", "version", "v.*")


@query("s_04_clean_range", "SELECT project_id, package, spec, installed, pinned FROM v_declared")
def s_04(t):
    return t.declared.select("project_id", "package", "spec", "installed", "pinned")


@query("s_05_npm_gap", "SELECT project_id, package, installed, latest, outdated, gap FROM v_gap")
def s_05(t):
    return audit.with_newest(t.declared, t.newest).select(
        "project_id", "package", "installed", "latest", "outdated", "gap"
    )


@query(
    "s_06_digit_gap",
    """
SELECT project_id, package, installed, latest,
  CASE WHEN l[1] > i[1] THEN 'major' WHEN l[1] = i[1] AND l[2] > i[2] THEN 'minor'
    WHEN l[1:2] = i[1:2] AND l[3] > i[3] THEN 'patch' END AS gap FROM v_gap""",
)
def s_06(t):
    return audit.with_newest(t.declared, t.newest).select(
        "project_id", "package", "installed", "latest", versions.digit_gap(F.col("installed"), F.col("latest")).alias("gap")
    )


@query(
    "s_07_repository_url",
    "SELECT package, replace(replace(replace(repository, 'git+', ''), 'git://', 'https://'), '.git', '') AS repository FROM v_newest",
)
def s_07(t):
    return t.newest.select("package", versions.repository_url(F.col("repository")).alias("repository"))


@query(
    "s_08_manifest_kind",
    """
SELECT doc_id, kind FROM (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'gradle' WHEN 1 THEN 'npm' WHEN 2 THEN 'npm'
    WHEN 3 THEN 'gradle' WHEN 4 THEN CASE WHEN regexp_matches(text, '\\b(implementation|api|testImplementation|androidTestImplementation|classpath)\\b')
      THEN 'gradle' ELSE 'npm' END
    ELSE 'gradle' END AS kind FROM documents)""",
)
def s_08(t):
    k = F.col("doc_id") % 6
    name = F.when(k == 0, "Build.GRADLE").when(k == 1, "x.JSON").otherwise(None)
    content = (
        F.when(k == 2, F.concat(F.lit('  {"name": "a", "version": "1", "t": "'), "text", F.lit('"}')))
        .when(k == 3, F.concat(F.lit("plugins { }\n"), "text"))
        .when(k == 5, F.concat("text", F.lit('\nimplementation("a:b:1")')))
        .otherwise(F.col("text"))
    )
    return t.table("documents").select("doc_id", versions.manifest_kind(content, name).alias("kind"))


@query(
    "s_09_cvss_band",
    """
SELECT osv_id, CASE WHEN try_cast(severity AS DOUBLE) >= 9 THEN 'crítica' WHEN try_cast(severity AS DOUBLE) >= 7 THEN 'alta'
  WHEN try_cast(severity AS DOUBLE) >= 4 THEN 'media' WHEN try_cast(severity AS DOUBLE) > 0 THEN 'baja'
  WHEN severity = 'HIGH' THEN 'alta' END AS band FROM v_advisories""",
)
def s_09(t):
    return t.advisories.select("osv_id", adv.cvss_band(F.col("severities")[0]["score"]).alias("band"))


@query(
    "s_10_max_severity",
    """
SELECT package, version, CASE band WHEN 4 THEN 'crítica' WHEN 3 THEN 'alta' WHEN 2 THEN 'media' WHEN 1 THEN 'baja' END AS severity
FROM v_by_version""",
)
def s_10(t):
    return t.by_version.select("package", "version", "severity")


@query("s_11_preferred_id", "SELECT osv_id, coalesce(cve, osv_id) AS id FROM v_advisories")
def s_11(t):
    return t.advisories.select("osv_id", adv.preferred_id(F.col("osv_id"), F.col("aliases")).alias("id"))


@query(
    "s_12_advisory_shape",
    """
SELECT osv_id, id, aliases, summary, details, severity,
  array_to_string([concat('https://ref/', event_id, '/', i) FOR i IN [1, 3, 4, 5]], ' ') AS refs FROM v_details""",
)
def s_12(t):
    return t.details.select(
        "osv_id",
        "detail.id",
        F.array_join("detail.aliases", ",").alias("aliases"),
        "detail.summary",
        "detail.details",
        "detail.severity",
        F.array_join("detail.references", " ").alias("refs"),
    )


@query("s_13_malware", "SELECT package, version, malware_id, malware_id IS NOT NULL AS malicious FROM v_by_version")
def s_13(t):
    return t.by_version.select("package", "version", "malware_id", "malicious")


@query("s_14_compliance_level", "SELECT project_id, package, section, legal_level FROM v_entries")
def s_14(t):
    return t.entries.select("project_id", "package", "section", "legal_level")


@query(
    "s_15_compliance_record",
    """
SELECT project_id, package, legal_level AS nivel,
  CASE legal_level WHEN 'crítico' THEN 'paquete_malicioso' WHEN 'alto' THEN 'consulta_datos_personales'
    ELSE 'tratamiento_identificadores' END AS categoria,
  CASE legal_level WHEN 'crítico' THEN 5 WHEN 'alto' THEN 2 ELSE 1 END AS articles,
  CASE legal_level WHEN 'crítico' THEN 1 ELSE 2 END AS laws,
  CASE legal_level WHEN 'crítico' THEN contains(malware_id, '-') ELSE true END AS named
FROM v_entries WHERE legal_level IS NOT NULL""",
)
def s_15(t):
    r = audit.with_compliance_record(t.entries.where(F.col("legal_level").isNotNull()))
    return r.select(
        "project_id",
        "package",
        "compliance.nivel",
        "compliance.categoria",
        F.size("compliance.articulos").alias("articles"),
        F.size("compliance.leyes").alias("laws"),
        F.col("compliance.rationale").contains(F.col("package")).alias("named"),
    )


@query(
    "s_18_dependency_risk",
    "SELECT project_id, package, section, level, score, severity FROM v_rated",
)
def s_18(t):
    return t.rated.select("project_id", "package", "section", "level", "score", "severity")


view(
    "v_labels",
    """
SELECT *, CASE
  WHEN legal_level = 'crítico' THEN 'GRAVÍSIMO — riesgo legal: posible paquete malicioso (Ley 21.459)'
  WHEN legal_level = 'alto' THEN 'GRAVE — riesgo legal: posible tratamiento de datos de fuente ilícita (Ley 21.459 Art. 6)'
  WHEN level = 'crítico' THEN 'CRÍTICO — CVE de severidad ' || coalesce(severity, 'alta')
  WHEN level = 'alto' THEN 'ALTO — vulnerabilidad ' || coalesce(severity, 'alta')
  WHEN level = 'medio' THEN CASE WHEN legal_level = 'medio' THEN 'MEDIO — revisión de cumplimiento (tratamiento de datos personales)'
    WHEN severity IS NOT NULL THEN 'MEDIO — CVE ' || severity ELSE 'MEDIO — versión major atrasada' END
  WHEN level = 'bajo' THEN 'BAJO — desactualización menor'
  WHEN level = 'desconocido' THEN 'INDETERMINADO — sin datos de CVE (sin conexión a OSV)'
  ELSE 'OK — sin observaciones' END AS label FROM v_rated""",
)


@query("s_19_severity_label", "SELECT project_id, package, section, label FROM v_labels")
def s_19(t):
    label = dependency_risk.severity_label(
        F.col("level"), F.col("severity"), F.col("legal_level"), F.col("platform_kind")
    )
    return t.rated.select("project_id", "package", "section", label.alias("label"))


view(
    "v_risks",
    """
SELECT *, CASE WHEN legal_level IS NULL THEN '' ELSE '⚖;' END
  || CASE WHEN vuln_count > 0 THEN concat(vuln_count, ' CVE conocido(s) para la versión ', installed,
       CASE WHEN severity IS NULL THEN '' ELSE ' (severidad máx. ' || severity || ')' END, ': ', vuln_ids, '.;')
       || CASE WHEN first_risks = '' THEN '' ELSE replace(first_risks, ' | ', ';') || ';' END ELSE '' END
  || CASE WHEN gap = 'major' THEN concat('Versión major atrasada: instalada ', installed, ' vs. última ', latest,
       ' — posible deuda técnica y falta de parches.;')
       WHEN gap IN ('minor', 'patch') THEN concat('Desactualización ', gap, ': ', installed, ' → ', latest, '.;') ELSE '' END
  || CASE WHEN note <> 'neterror' THEN 'Especificación no resoluble (' || note || '): no se pudo evaluar la versión.;' ELSE '' END
  AS body,
  CASE WHEN legal_level IS NULL THEN '' ELSE '⚖;' END
  || CASE WHEN vuln_count > 0 THEN concat('Actualizar ', package, ' a una versión sin los CVE reportados (referencia: última ',
       coalesce(latest, 'None'), ') y re-auditar.;Revisar el detalle de cada CVE (impacto/explotabilidad) antes de aprobar el build.;') ELSE '' END
  || CASE WHEN gap = 'major' THEN concat('Planificar migración a la versión major ', latest,
       ' (revisar breaking changes y guía de migración del paquete).;')
       WHEN gap IN ('minor', 'patch') THEN concat('Actualizar a ', latest, ' (', gap, '), de bajo riesgo de ruptura.;') ELSE '' END
  || CASE WHEN NOT pinned AND installed IS NOT NULL THEN
       'Considerar fijar la versión (lockfile / versión exacta) para builds reproducibles.;' ELSE '' END
  || CASE WHEN note = 'neterror' THEN 'Reintentar la auditoría con conexión a OSV para confirmar ausencia de CVE.;' ELSE '' END
  AS measures
FROM v_rated""",
)


@query(
    "s_20_known_risks",
    """
SELECT project_id, package, section, CASE WHEN body = '' THEN 'Sin riesgos conocidos detectados.;' ELSE body END AS risks FROM v_risks""",
)
def s_20(t):
    rows = audit.with_compliance_record(t.listed)
    texts = F.transform(
        dependency_risk.known_risks(F.col), lambda x: F.concat(F.when(x.startswith("⚖"), "⚖").otherwise(x), F.lit(";"))
    )
    return rows.select("project_id", "package", "section", F.array_join(texts, "").alias("risks"))


view(
    "v_precision",
    """
SELECT project_id, package, section, spec, o1, o2, o3, CASE WHEN note = 'neterror' THEN 'Evaluación parcial: no se pudo consultar OSV para esta dependencia (sin conexión). El estado de versión proviene de npm; los CVE quedan pendientes.'
  WHEN note IS NOT NULL THEN 'Precisión limitada: la versión no se pudo resolver (catálogo/variable/alias o artefacto no encontrado), por lo que no se evalúa versión exacta ni CVE.'
  WHEN installed IS NULL THEN 'Precisión limitada: no se pudo determinar la versión instalada.'
  ELSE 'Alta: versión declarada (' || installed || '); última versión verificada en npm; CVE consultados en OSV con coincidencia exacta de versión.' END AS precision_text
FROM v_rated""",
)


@query("s_21_technical_precision", "SELECT project_id, package, section, precision_text AS text FROM v_precision")
def s_21(t):
    return t.rated.select("project_id", "package", "section", dependency_risk.technical_precision(F.col).alias("text"))


@query(
    "s_22_mitigations",
    """
SELECT project_id, package, section, CASE WHEN measures = '' THEN 'Mantener monitoreo; sin acción inmediata requerida.;' ELSE measures END AS measures FROM v_risks""",
)
def s_22(t):
    rows = audit.with_compliance_record(t.rated)
    texts = F.transform(
        dependency_risk.mitigations(F.col), lambda x: F.concat(F.when(x.startswith("⚖"), "⚖").otherwise(x), F.lit(";"))
    )
    return rows.select("project_id", "package", "section", F.array_join(texts, "").alias("measures"))


@query(
    "s_32_links",
    "SELECT DISTINCT package, 'https://www.npmjs.com/package/' || package AS npm_url FROM v_deps",
)
def s_32(t):
    return t.declared.select("package", "npm_url").distinct()


@query(
    "s_44_state_label",
    """
SELECT project_id, package, section, CASE WHEN legal_level = 'crítico' THEN '⚖ GRAVÍSIMO' WHEN legal_level = 'alto' THEN '⚖ GRAVE'
  WHEN vuln_count > 0 THEN 'VULNERABLE' WHEN legal_level = 'medio' THEN '⚖ REVISAR' WHEN gap = 'major' THEN 'MAJOR'
  WHEN note = 'neterror' THEN '?' WHEN outdated THEN 'DESACTUAL.' WHEN NOT outdated THEN 'OK' ELSE '—' END AS state,
  CASE WHEN note = 'neterror' THEN 'sin conexión' WHEN note IS NOT NULL THEN note WHEN NOT outdated THEN 'al día'
    WHEN gap = 'major' THEN 'major ▲' WHEN gap IS NOT NULL THEN gap ELSE '—' END AS gap_text
FROM v_entries""",
)
def s_44(t):
    c = F.col
    state = dependency_risk.state_label(c("legal_level"), c("vuln_count"), c("gap"), c("note"), c("outdated"))
    return t.entries.select(
        "project_id",
        "package",
        "section",
        state.alias("state"),
        dependency_risk.gap_label(c("note"), c("outdated"), c("gap")).alias("gap_text"),
    )


# ---- joins


@query(
    "j_04_eol_page",
    """
SELECT package, CASE WHEN page IS NULL THEN NULL ELSE 'https://endoflife.date/' || page END AS eol_url FROM (
  SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN 'vue' WHEN 1 THEN '@angular/cli' WHEN 2 THEN 'next' ELSE 'pkg-' || p_partkey END AS package,
    CASE p_partkey % 4 WHEN 0 THEN 'vue' WHEN 1 THEN 'angular' WHEN 2 THEN 'nextjs' END AS page FROM part)""",
)
def j_04(t):
    k = F.col("p_partkey") % 4
    package = (
        F.when(k == 0, "vue").when(k == 1, "@angular/cli").when(k == 2, "next").otherwise(F.concat(F.lit("pkg-"), "p_partkey"))
    )
    return audit.with_eol_page(t.table("part").select(package.alias("package")).distinct()).drop("eol_info")


@query("j_05_newest_join", "SELECT project_id, package, spec, latest, note FROM v_with_newest")
def j_05(t):
    return audit.with_newest(t.declared, t.newest).select("project_id", "package", "spec", "latest", "note")


@query(
    "j_06_advisory_join",
    "SELECT project_id, package, installed, vuln_status, vuln_count, vuln_ids FROM v_entries",
)
def j_06(t):
    return t.listed_entries.select(
        "project_id", "package", "installed", "vuln_status", "vuln_count", F.array_join("vuln_ids", ", ").alias("vuln_ids")
    )


@query(
    "j_06_failed_lookup",
    """
SELECT project_id, package, installed, CASE WHEN lost THEN 'neterror' ELSE vuln_status END AS vuln_status, CASE WHEN NOT lost THEN vuln_count END AS vuln_count,
  CASE WHEN NOT lost THEN band END IS NOT NULL AS judged
FROM (SELECT *, lookable AND cast(split_part(package, '-', 2) AS INT) % 31 = 0 AS lost FROM v_entries)""",
)
def j_06_failed(t):
    entries = audit.audit_npm(t.declared, t.newest, t.by_version, t.failed_lookups)
    return entries.select("project_id", "package", "installed", "vuln_status", "vuln_count", F.col("severity").isNotNull().alias("judged"))


@query(
    "j_06_no_version",
    """
SELECT d.package, d.installed AS version, CASE WHEN d.installed IS NULL THEN 'no-version' WHEN cast(split_part(d.package, '-', 2) AS INT) % 31 = 0 THEN 'neterror'
    WHEN v.n > 0 THEN 'vulnerable' ELSE 'clean' END AS vuln_status,
  CASE WHEN d.installed IS NOT NULL AND cast(split_part(d.package, '-', 2) AS INT) % 31 <> 0 THEN coalesce(v.n, 0) END AS vuln_count
FROM (SELECT DISTINCT package, installed FROM v_declared) d LEFT JOIN v_by_version v ON v.package = d.package AND v.version = d.installed""",
)
def j_06_no_version(t):
    queries = t.declared.select(F.lit("npm").alias("ecosystem"), "package", F.col("installed").alias("version")).distinct()
    return audit.advisory_status(queries, t.by_version, t.failed_lookups).drop("ecosystem")


@query("j_07_advisory_detail", "SELECT package, version, osv_id, id, summary FROM v_listed")
def j_07(t):
    return audit.advisory_details_of(t.advisories, t.details).select("package", "version", "osv_id", "detail.id", "detail.summary")


@query(
    "f_08_resolvable",
    "SELECT project_id, package, spec FROM v_with_newest WHERE installed IS NOT NULL AND note IS DISTINCT FROM 'neterror'",
)
def f_08(t):
    return audit.resolvable(audit.with_newest(t.declared, t.newest)).select("project_id", "package", "spec")


# ---- aggregates

view(
    "v_summary",
    """
SELECT project_id, count(*) AS total, count_if(outdated) AS outdated, count_if(gap = 'major') AS major_behind,
  count_if(vuln_count > 0) AS vulnerable, count_if(note = 'neterror') AS neterror,
  count_if(note <> 'neterror') AS unresolved, count(legal_level) AS compliance_flags,
  count_if(legal_level = 'crítico') AS compliance_critico, count_if(legal_level = 'alto') AS compliance_alto
FROM v_entries GROUP BY project_id""",
)


@query("a_01_npm_summary", "SELECT * FROM v_summary")
def a_01(t):
    return audit.npm_summary(t.entries)


@query(
    "s_45_headline",
    """
SELECT project_id, CASE WHEN compliance_critico > 0 THEN concat('⚖ ', compliance_critico, ' riesgo legal GRAVÍSIMO')
  WHEN compliance_alto > 0 THEN concat('⚖ ', compliance_alto, ' riesgo legal GRAVE') WHEN vulnerable > 0 THEN concat(vulnerable, ' con CVE')
  WHEN major_behind > 0 THEN concat(major_behind, ' con versión major atrasada') WHEN outdated > 0 THEN concat(outdated, ' desactualizadas')
  ELSE 'Sin observaciones críticas' END AS headline FROM v_summary""",
)
def s_45(t):
    return audit.npm_summary(t.entries).select("project_id", dependency_risk.audit_headline(F.col).alias("headline"))


@query(
    "a_03_compliance_totals",
    """
SELECT project_id, count(*) AS total, count_if(legal_level = 'crítico') AS critico, count_if(legal_level = 'alto') AS alto,
  count_if(legal_level = 'medio') AS medio FROM v_entries WHERE legal_level IS NOT NULL GROUP BY 1""",
)
def a_03(t):
    return audit.compliance_totals(t.entries)


view(
    "v_overall",
    """
SELECT *, round(total_score / entries, 2) AS avg_score FROM (SELECT project_id, count(*) AS entries, sum(score) AS total_score,
  count_if(level = 'crítico') AS critico, count_if(level = 'alto') AS alto, count_if(level = 'medio') AS medio,
  count_if(level = 'bajo') AS bajo, count_if(level = 'ok') AS ok, count_if(level = 'desconocido') AS desconocido,
  count_if(legal_level = 'crítico') AS compliance_critico, count_if(legal_level = 'alto') AS compliance_alto
FROM v_rated GROUP BY 1)""",
)


@query("a_04_risk_distribution", "SELECT * FROM v_overall")
def a_04(t):
    return audit.risk_distribution(t.rated).drop("verdict", "verdict_level")


view(
    "v_recommended",
    """
SELECT *, CASE WHEN compliance_critico > 0 THEN 'NO RECOMENDADO — RIESGO LEGAL GRAVÍSIMO'
  WHEN critico > 0 THEN 'NO RECOMENDADO — riesgo técnico crítico' WHEN compliance_alto > 0 THEN 'NO RECOMENDADO — RIESGO LEGAL GRAVE'
  WHEN alto > 0 THEN 'NO RECOMENDADO — riesgo técnico alto' WHEN medio > 0 THEN 'RECOMENDADO CON OBSERVACIONES'
  WHEN bajo > 0 THEN 'RECOMENDADO CON OBSERVACIONES MENORES' ELSE 'RECOMENDADO' END AS verdict,
  CASE WHEN compliance_critico > 0 OR critico > 0 THEN 'crítico' WHEN compliance_alto > 0 OR alto > 0 THEN 'alto'
    WHEN medio > 0 THEN 'medio' WHEN bajo > 0 THEN 'bajo' ELSE 'ok' END AS verdict_level
FROM v_overall""",
)


@query("a_05_recommendation", "SELECT project_id, avg_score, verdict, verdict_level FROM v_recommended")
def a_05(t):
    return audit.risk_distribution(t.rated).select("project_id", "avg_score", "verdict", "verdict_level")


@query(
    "s_52_verdict_class",
    """
SELECT project_id, CASE WHEN verdict_level IN ('crítico', 'alto') THEN 'bad' WHEN verdict_level IN ('medio', 'bajo') THEN 'warn' ELSE 'ok' END AS class FROM v_recommended""",
)
def s_52_verdict(t):
    return audit.risk_distribution(t.rated).select("project_id", catalog.verdict_class(F.col("verdict_level")).alias("class"))


@query("a_23_lookup_keys", "SELECT DISTINCT package FROM v_deps")
def a_23(t):
    return audit.lookup_keys(t.deps)


@query("a_30_advisories_per_version", "SELECT package, version, n AS vuln_count, ids AS vuln_ids FROM v_by_version")
def a_30(t):
    return t.listed_by_version.select("package", "version", "vuln_count", F.array_join("vuln_ids", ", ").alias("vuln_ids"))


@query("a_31_unique_advisories", "SELECT DISTINCT osv_id FROM v_advisories")
def a_31(t):
    return t.advisories.select("osv_id").distinct()


@query(
    "a_32_legal_items",
    "SELECT project_id, package, level, score, legal_level FROM v_rated WHERE legal_level IS NOT NULL",
)
def a_32(t):
    return audit.legal_items(t.rated).drop("compliance")


# ---- order and limits


@query(
    "o_02_risk_order",
    """
SELECT project_id, package, level, score, row_number() OVER (PARTITION BY project_id ORDER BY rank DESC, score DESC, package) AS n FROM v_rated""",
)
def o_02(t):
    rows = t.rated.select("project_id", "package", "level", "score")
    return placed(rows, ["project_id"], audit.risk_order())


@query(
    "o_05_audit_order",
    """
SELECT project_id, package, CASE WHEN vuln_count > 0 THEN 0 WHEN gap = 'major' THEN 1 WHEN gap = 'minor' THEN 2
  WHEN gap = 'patch' THEN 3 WHEN NOT outdated THEN 5 ELSE 4 END AS rank, row_number() OVER (PARTITION BY project_id ORDER BY rank, package) AS n FROM v_entries""",
)
def o_05(t):
    rank = dependency_risk.audit_rank(F.col("vuln_count"), F.col("gap"), F.col("outdated"))
    return placed(t.entries.select("project_id", "package", rank.alias("rank")), ["project_id"], [F.asc("rank"), F.asc("package")])


view(
    "v_priority",
    """
SELECT *, row_number() OVER (PARTITION BY project_id, rank >= 3 ORDER BY rank DESC, score DESC, package, o1, o2, o3) AS p1,
  row_number() OVER (PARTITION BY project_id, legal_level IS NOT NULL ORDER BY rank DESC, score DESC, package, o1, o2, o3) AS p2
FROM v_rated""",
)


@query(
    "o_08_priority_packages",
    """
SELECT project_id, array_to_string(list(package ORDER BY p1) FILTER (WHERE rank >= 3 AND p1 <= 5), ', ') AS priority,
  array_to_string(list(package ORDER BY p2) FILTER (WHERE legal_level IS NOT NULL AND p2 <= 6), ', ') AS legal
FROM v_priority GROUP BY 1 HAVING count_if(rank >= 3) + count(legal_level) > 0""",
)
def o_08(t):
    return audit.priority_packages(t.rated)


@query(
    "o_12_dependency_limit",
    """
SELECT project_id, package, spec, n > 5 AS truncated FROM (SELECT *, count(*) OVER (PARTITION BY project_id) AS n,
  row_number() OVER (PARTITION BY project_id ORDER BY o1, o2, o3) AS r FROM v_deps) WHERE r <= 5""",
)
def o_12(t):
    return audit.limit_dependencies(t.deps, 5).select("project_id", "package", "spec", "truncated")
