"""Queries of finding risk and conformity."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import controls as ctl
from ..functions import source_text as st
from ..operators import conformity, finding_risk
from ..rules import RULES
from ..sources import scanners
from .catalog_queries import values
from .registry import placed, query, view
from .scan_queries import REDACTED, case_roles

view(
    "v_redacted",
    f"SELECT * REPLACE ({REDACTED.format('evidence')} AS evidence) FROM v_findings",
)
REACHABLE = ", ".join(f"'{r}'" for r in finding_risk.EXTERNALLY_REACHABLE)
view(
    "v_scored",
    f"""
SELECT *, CASE WHEN run = '' THEN 0.0 ELSE list_sum(list_transform(list_sort(list_distinct(chars)),
    lambda c: -(len(list_filter(chars, lambda x: x = c)) / len(chars)) * log2(len(list_filter(chars, lambda x: x = c)) / len(chars)))) END AS raw,
  CASE WHEN contains(p, '/test/') OR contains(base, 'test') OR contains(p, '/androidtest/') THEN 0.5
    WHEN regexp_matches(p, 'example|sample|mock') THEN 0.4 WHEN ends_with(p, '.md') OR contains(p, '/docs/') THEN 0.3 ELSE 1.0 END AS exposure_weight
FROM (SELECT *, regexp_extract(evidence, '[A-Za-z0-9+/_\\-]{{12,}}') AS run, string_split(regexp_extract(evidence, '[A-Za-z0-9+/_\\-]{{12,}}'), '') AS chars,
  lower(path) AS p, regexp_extract(lower(path), '[^/]*$') AS base, count(*) OVER (PARTITION BY project_id, path) AS in_file,
  {case_roles('path')} AS role FROM v_redacted)""",
)
view(
    "v_risk",
    f"""
SELECT *, impact * probability AS risk_value, CASE WHEN impact * probability >= 15 THEN 'Crítico' WHEN impact * probability >= 9 THEN 'Alto'
    WHEN impact * probability >= 5 THEN 'Medio' WHEN impact * probability >= 3 THEN 'Bajo' ELSE 'Informativo' END AS risk_level,
  CASE WHEN impact * probability >= 15 THEN 5 WHEN impact * probability >= 9 THEN 4 WHEN impact * probability >= 5 THEN 3
    WHEN impact * probability >= 3 THEN 2 ELSE 1 END AS risk_rank,
  round(CASE severity WHEN 'crítico' THEN 100 WHEN 'alto' THEN 70 WHEN 'medio' THEN 40 WHEN 'bajo' THEN 15 ELSE 5 END * exposure_weight
    * CASE WHEN category = 'COMPARTIMENTAJE' THEN 1 + least(raw / 6.0, 0.6) ELSE 1 END, 1) AS score
FROM (SELECT *, in_file >= 2 AS hotspot,
  CASE WHEN exposure_weight >= 1 THEN 'producción' ELSE 'prueba/ejemplo' END AS exposure,
  greatest(1, CASE severity WHEN 'crítico' THEN 5 WHEN 'alto' THEN 4 WHEN 'medio' THEN 3 WHEN 'bajo' THEN 2 ELSE 1 END
    - CASE WHEN exposure_weight >= 1 THEN 0 ELSE 1 END) AS impact,
  greatest(1, least(CASE rule_id WHEN 'LIC-MISSING' THEN 1 WHEN 'PII-RUT' THEN 2 ELSE 5 END,
    CASE WHEN exposure_weight >= 1 THEN 3 ELSE 1 END + CASE WHEN category = 'COMPARTIMENTAJE' AND raw >= 4 THEN 1 ELSE 0 END
    + CASE WHEN reachable THEN 1 ELSE 0 END + CASE WHEN rule_id IN ({REACHABLE}) THEN 1 ELSE 0 END)) AS probability
FROM v_scored)""",
)


def redacted(t):
    return t.findings.withColumn("evidence", st.redact(F.col("evidence")))


def rated(t):
    return finding_risk.rate(redacted(t))


@query("s_24_entropy", "SELECT ord, evidence, round(raw, 2) AS entropy FROM v_scored")
def s_24(t):
    return redacted(t).select("ord", "evidence", F.round(st.entropy(F.col("evidence")), 2).alias("entropy"))


@query("s_26_exposure", "SELECT ord, path, exposure_weight, exposure FROM v_risk")
def s_26(t):
    return rated(t).select("ord", "path", "exposure_weight", "exposure")


@query("s_27_impact", "SELECT ord, rule_id, impact, hotspot FROM v_risk")
def s_27(t):
    return rated(t).select("ord", "rule_id", "impact", "hotspot")


@query("s_28_probability", "SELECT ord, rule_id, probability FROM v_risk")
def s_28(t):
    return rated(t).select("ord", "rule_id", "probability")


@query("s_29_risk_level", "SELECT ord, risk_value, risk_level FROM v_risk")
def s_29(t):
    return rated(t).select("ord", "risk_value", "risk_level")


@query("s_30_finding_score", "SELECT ord, score FROM v_risk")
def s_30(t):
    return rated(t).select("ord", "score")


NARRATIVE_SQL = f"""
SELECT ord, concat('En «', regexp_extract(path, '[^/]*$'), '»', CASE WHEN line IS NULL THEN '' ELSE concat(' (línea ', line, ')') END, ': ', mitigation) AS measure,
  concat('severidad intrínseca de la regla: ', severity,
    CASE WHEN category = 'COMPARTIMENTAJE' AND regexp_matches(role, 'credenciales|servicios externos|manifiesto') THEN
      '; el archivo cumple un rol de ' || role || ', donde exponer un secreto compromete directamente el acceso a la plataforma' ELSE '' END,
    CASE WHEN rule_id = 'SQL-CONCAT' AND contains(role, 'persistencia') THEN
      '; se ubica en la capa de acceso a datos, por lo que una inyección alcanzaría directamente el repositorio de información' ELSE '' END,
    CASE WHEN rule_id IN ('NET-CLEARTEXT', 'NET-TRUST-ALL') AND contains(role, 'red') THEN
      '; afecta la capa de comunicación con servicios remotos, exponiendo los datos en tránsito' ELSE '' END,
    CASE WHEN exposure_weight < 1 THEN
      '; al residir en código de prueba/ejemplo, el impacto sobre el sistema productivo es menor' ELSE '' END, '.') AS impact_reasons,
  role FROM v_risk"""


@query("s_31_narratives", NARRATIVE_SQL)
def s_31(t):
    return finding_risk.with_narratives(rated(t)).select("ord", "measure", "impact_reasons", "role")


view(
    "v_top",
    """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY risk_rank DESC, score DESC, path, line, rule_id) AS place FROM v_risk) WHERE place = 1""",
)
SCALE_SQL = "(['muy bajo', 'bajo', 'medio', 'alto', 'muy alto'])"


view(
    "v_executive",
    f"""
SELECT project_id, concat('El análisis estático identificó ', n, ' observaciones (', sev, '). Ponderadas por contexto (impacto × probabilidad), el riesgo se distribuye en ',
  lev, '. El nivel de riesgo agregado de la plataforma es ', global_level, '. La observación de mayor prioridad es «', title, '» en ', regexp_extract(path, '[^/]*$'),
  ', con nivel de riesgo ', lower(risk_level), ' (impacto ', {SCALE_SQL}[impact], ' × probabilidad ', {SCALE_SQL}[probability], ').',
  CASE WHEN hot > 0 THEN concat(' Se identificaron ', hot, ' punto(s) caliente(s) (archivos que concentran varios hallazgos), que deben revisarse de forma integral.') ELSE '' END,
  ' Se recomienda remediar primero las observaciones de nivel crítico y alto antes de promover la plataforma a producción. Este es un insumo técnico de aseguramiento de calidad; el detalle de impacto, probabilidad y justificación de cada punto se presenta en la sección de análisis técnico.') AS summary
FROM v_top JOIN (
  SELECT project_id, sum(c) AS n, string_agg(severity || ': ' || c, ', ' ORDER BY r) AS sev FROM (
    SELECT project_id, severity, CASE severity WHEN 'crítico' THEN 0 WHEN 'alto' THEN 1 WHEN 'medio' THEN 2 WHEN 'bajo' THEN 3 ELSE 4 END AS r, count(*) AS c FROM v_risk GROUP BY ALL) GROUP BY 1) USING (project_id)
JOIN (SELECT project_id, string_agg(lower(risk_level) || ': ' || c, ', ' ORDER BY risk_rank DESC) AS lev,
    CASE max(risk_rank) WHEN 5 THEN 'crítico' WHEN 4 THEN 'alto' WHEN 3 THEN 'medio' ELSE 'bajo' END AS global_level
  FROM (SELECT project_id, risk_level, risk_rank, count(*) AS c FROM v_risk GROUP BY ALL) GROUP BY 1) USING (project_id)
JOIN (SELECT project_id, count(DISTINCT path) FILTER (WHERE hotspot) AS hot FROM v_risk GROUP BY 1) USING (project_id)""",
)


@query("s_31_executive_summary", "SELECT * FROM v_executive")
def s_31_summary(t):
    return finding_risk.executive_summary(rated(t))


@query(
    "s_49_without_repetition",
    """
SELECT ord, CASE WHEN ord % 2 = 0 THEN '' ELSE concat(title, ': ', guide) END AS analysis FROM v_findings""",
)
def s_49(t):
    even = F.col("ord") % 2 == 0
    analysis = F.concat("title", F.lit(": "), "guide", F.when(even, F.concat(F.lit(" "), "mitigation")).otherwise(""))
    return t.findings.select(
        "ord",
        finding_risk.without_repetition(analysis, F.col("guide"), F.col("mitigation")).alias("analysis"),
    )


@query(
    "a_17_global_level",
    """
SELECT project_id, CASE max(risk_rank) WHEN 5 THEN 'crítico' WHEN 4 THEN 'alto' WHEN 3 THEN 'medio' ELSE 'bajo' END AS global_level FROM v_risk GROUP BY 1""",
)
def a_17(t):
    return finding_risk.project_risk(rated(t)).select("project_id", "global_level")


@query(
    "a_18_total_risk",
    "SELECT project_id, cast(sum(cast(score AS DECIMAL(20, 1))) AS DOUBLE) AS total_risk FROM v_risk GROUP BY 1",
)
def a_18(t):
    return finding_risk.project_risk(rated(t)).select("project_id", "total_risk")


view(
    "v_hot",
    """
SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY n DESC, path) AS rank FROM (
  SELECT project_id, path, count(*) AS n FROM v_findings GROUP BY 1, 2 HAVING count(*) >= 2)""",
)


@query(
    "a_19_hotspots",
    """
SELECT project_id, path, rank, n AS findings_in_file, rule_id, count(*) AS times FROM v_hot JOIN v_findings USING (project_id, path)
WHERE rank <= 8 GROUP BY ALL""",
)
def a_19(t):
    return finding_risk.hotspots(t.findings, 8)


@query("o_07_top_hotspots", "SELECT DISTINCT project_id, path, rank FROM v_hot WHERE rank <= 3")
def o_07(t):
    return finding_risk.hotspots(t.findings, 3).select("project_id", "path", "rank").distinct()


@query("a_20_level_counts", "SELECT project_id, risk_level, count(*) AS findings FROM v_risk GROUP BY ALL")
def a_20(t):
    return finding_risk.level_counts(rated(t))


@query(
    "o_03_risk_order",
    """
SELECT project_id, risk_level, score, path, line, rule_id,
  row_number() OVER (PARTITION BY project_id ORDER BY risk_rank DESC, score DESC, path, line NULLS FIRST, rule_id) AS n FROM v_risk""",
)
def o_03(t):
    rows = rated(t).select("project_id", "risk_level", "score", "path", "line", "rule_id")
    return placed(rows, ["project_id"], finding_risk.risk_order())


@query(
    "o_11_export_order",
    """
SELECT project_id, severity, category, path, row_number() OVER (PARTITION BY project_id ORDER BY CASE severity WHEN 'crítico' THEN 0 WHEN 'alto' THEN 1 WHEN 'medio' THEN 2
  WHEN 'bajo' THEN 3 ELSE 4 END, category, path) AS n FROM v_findings""",
)
def o_11(t):
    return placed(t.findings.select("project_id", "severity", "category", "path"), ["project_id"], finding_risk.severity_order())


@query(
    "w_10_finding_numbers",
    "SELECT project_id, row_number() OVER (PARTITION BY project_id ORDER BY score DESC) AS number, score FROM v_risk",
)
def w_10(t):
    return finding_risk.numbered(rated(t).select("project_id", "score", "path", "line", "rule_id")).select(
        "project_id", "number", "score"
    )


# ---- conformity

PAIRS = values((c.id, i, r) for c in ctl.CONTROLS if c.assessable for i, r in enumerate(c.violated_by))
CATALOGUE = values(
    (c.id, c.instrument, c.reference, c.domain, c.severity, int(c.assessable), len(c.violated_by), len(c.shown_by))
    for c in ctl.CONTROLS
)
view("v_pairs", f"SELECT * FROM ({PAIRS}) t(control_id, rule_pos, rule_id)")
view(
    "v_controls",
    f"SELECT * FROM ({CATALOGUE}) t(control_id, instrument, reference, domain, severity, assessable, violated, shown)",
)
# States differ between projects: a rule whose number shares a bit with that of its project counts as another rule.
view(
    "v_kept",
    f"""
SELECT * REPLACE (CASE WHEN ((list_position([{", ".join(f"'{r.id}'" for r in RULES)}], rule_id) - 1) & cast(substr(project_id, 4) AS INT)) = 0
  THEN rule_id ELSE 'OTHER' END AS rule_id) FROM v_redacted""",
)
view(
    "v_all_findings",
    """
SELECT project_id, rule_id, path, line, title FROM v_kept
UNION ALL SELECT 'src' || (project_id % 20), 'DEP-MALWARE', '(manifiesto de dependencias)', NULL, 'Dependencia con aviso de malware: ' || package
FROM v_entries WHERE legal_level = 'crítico'""",
)
view("v_levels", "SELECT 'src' || i AS project_id, (['crítico', 'alto', 'medio', 'bajo'])[i % 4 + 1] AS global_level FROM range(20) t(i)")
view(
    "v_violations",
    "SELECT project_id, control_id, count(*) AS n FROM v_all_findings JOIN v_pairs USING (rule_id) GROUP BY 1, 2",
)
view(
    "v_evaluated",
    """
SELECT p.project_id, c.control_id, c.instrument, c.reference, c.domain, coalesce(v.n, 0) AS n_findings,
  CASE WHEN c.assessable = 0 THEN 'no_evaluable' WHEN v.n > 0 THEN 'no_cumple'
    WHEN c.shown > 0 THEN CASE WHEN cast(substr(p.project_id, 4) AS INT) % 2 = 0 THEN 'cumple' ELSE 'observado' END
    WHEN c.violated > 0 THEN 'cumple'
    WHEN c.control_id = 'D11-LINEA-BASE' THEN CASE l.global_level WHEN 'crítico' THEN 'no_cumple' WHEN 'bajo' THEN 'cumple' ELSE 'observado' END
    ELSE 'observado' END AS state, c.severity AS raw_severity
FROM (SELECT DISTINCT project_id FROM v_findings) p CROSS JOIN v_controls c JOIN v_levels l ON l.project_id = p.project_id
LEFT JOIN v_violations v ON v.project_id = p.project_id AND v.control_id = c.control_id""",
)
COUNTS = ", ".join(f"count(*) FILTER (WHERE state = '{s}') AS {s}" for s in ctl.STATES)


def project_number():
    return F.substring("project_id", 4, 10).cast("int")


def project_findings(t):
    names = F.array(*[F.lit(r.id) for r in RULES])
    position = F.array_position(names, F.col("rule_id")).cast("int") - 1
    own_rule = F.when(position.bitwiseAND(project_number()) == 0, F.col("rule_id")).otherwise("OTHER")
    own = t.findings.select("project_id", own_rule.alias("rule_id"), "path", "line", "title")
    malware = conformity.malware_findings(t.entries)
    moved = malware.withColumn("project_id", F.concat(F.lit("src"), F.col("project_id") % 20))
    return own.unionByName(moved)


def evaluated(t):
    projects = t.findings.select("project_id").distinct()
    number = project_number()
    levels = projects.select(
        "project_id",
        F.get(F.array(*[F.lit(v) for v in ("crítico", "alto", "medio", "bajo")]), number % 4).alias("global_level"),
    )
    flags = projects.select("project_id", (number % 2 == 0).alias("has_oidc"))
    return conformity.evaluate(
        projects, project_findings(t), conformity.oidc_evidence(flags), levels, ctl.controls(t.spark)
    )


@query("j_15_control_violations", "SELECT project_id, control_id, n AS n_findings FROM v_violations")
def j_15(t):
    return conformity.violations(conformity.rule_counts(project_findings(t)), ctl.controls(t.spark))


@query(
    "j_16_presence",
    "SELECT DISTINCT project_id, 'D9-A6-OIDC-OAUTH' AS control_id FROM v_findings WHERE cast(substr(project_id, 4) AS INT) % 2 = 0",
)
def j_16(t):
    flags = t.findings.select("project_id").distinct().select("project_id", (project_number() % 2 == 0).alias("has_oidc"))
    counts = conformity.rule_counts(t.findings)
    return conformity.presence(counts, conformity.oidc_evidence(flags), ctl.controls(t.spark))


view("v_cwe", f"SELECT * FROM ({values((k, ','.join(v)) for k, v in ctl.CWE_CONTROLS.items())}) t(cwe, controls)")


@query(
    "j_17_cwe_controls",
    "SELECT e.ord, e.cwe, coalesce(c.controls, '') AS controls FROM v_external e LEFT JOIN v_cwe c USING (cwe)",
)
def j_17(t):
    return scanners.with_controls(t.external).select("ord", "cwe", F.array_join("controls", ",").alias("controls"))


@query(
    "j_28_malware_evidence",
    """
SELECT project_id, count(*) AS findings FROM v_all_findings WHERE rule_id = 'DEP-MALWARE' GROUP BY 1""",
)
def j_28(t):
    return (
        project_findings(t)
        .where(F.col("rule_id") == "DEP-MALWARE")
        .groupBy("project_id")
        .agg(F.count("*").alias("findings"))
    )


@query(
    "a_11_control_states",
    "SELECT project_id, control_id, state, n_findings, CASE WHEN state = 'no_cumple' THEN raw_severity END AS severity FROM v_evaluated",
)
def a_11(t):
    return evaluated(t).select("project_id", "control_id", "state", "n_findings", "severity")


@query("a_12_state_counts", f"SELECT project_id, {COUNTS} FROM v_evaluated GROUP BY 1")
def a_12(t):
    return conformity.state_counts(evaluated(t))


@query("a_13_instrument_matrix", f"SELECT project_id, instrument, {COUNTS} FROM v_evaluated GROUP BY 1, 2")
def a_13(t):
    return conformity.instrument_matrix(evaluated(t))


FUNCTION_SQL = f"""
SELECT p.project_id, f.domain, count(*) FILTER (WHERE state = 'cumple') AS cumple, count(*) FILTER (WHERE state = 'no_cumple') AS no_cumple,
  count(*) FILTER (WHERE state = 'observado') AS observado, count(*) FILTER (WHERE state = 'no_evaluable') AS no_evaluable
FROM (SELECT DISTINCT project_id FROM v_findings) p CROSS JOIN (SELECT unnest([{", ".join(f"'{f}'" for f in ctl.FUNCTIONS)}]) AS domain) f
LEFT JOIN v_evaluated e ON e.project_id = p.project_id AND e.domain = f.domain GROUP BY 1, 2"""


@query("a_14_function_matrix", FUNCTION_SQL)
def a_14(t):
    return conformity.function_matrix(evaluated(t))


@query("j_26_zero_functions", f"SELECT project_id, domain FROM ({FUNCTION_SQL}) WHERE cumple + no_cumple + observado + no_evaluable = 0")
def j_26(t):
    total = sum((F.col(s) for s in ctl.STATES), F.lit(0))
    return conformity.function_matrix(evaluated(t)).where(total == 0).select("project_id", "domain")


view(
    "v_verdict",
    f"""
SELECT *, CASE WHEN cumple + no_cumple + observado > 0 THEN round(100.0 * cumple / (cumple + no_cumple + observado), 1) ELSE 0 END AS conformity_pct,
  CASE WHEN no_cumple = 0 AND observado = 0 THEN 'CONFORME' WHEN grave THEN 'NO CONFORME' ELSE 'CONFORME CON OBSERVACIONES' END AS verdict
FROM (SELECT project_id, {COUNTS}, bool_or(state = 'no_cumple' AND raw_severity IN ('crítico', 'alto')) AS grave FROM v_evaluated GROUP BY 1)""",
)


@query("a_15_conformity_pct", "SELECT project_id, conformity_pct FROM v_verdict")
def a_15(t):
    return conformity.verdict(evaluated(t)).select("project_id", "conformity_pct")


@query("a_16_verdict", "SELECT project_id, verdict FROM v_verdict")
def a_16(t):
    return conformity.verdict(evaluated(t)).select("project_id", "verdict")


view(
    "v_evidence",
    """
SELECT *, row_number() OVER (PARTITION BY project_id, control_id ORDER BY rule_pos, path, line NULLS FIRST, title) AS pos
FROM v_all_findings JOIN v_pairs USING (rule_id)""",
)


@query("w_08_evidence", "SELECT project_id, control_id, pos, rule_id, path, line FROM v_evidence WHERE pos <= 8")
def w_08(t):
    return conformity.evidence_rows(project_findings(t), ctl.controls(t.spark), 8).select(
        "project_id", "control_id", "pos", "rule_id", "path", "line"
    )


@query(
    "s_51_evidence_labels",
    """
SELECT project_id, control_id, string_agg(concat('`', rule_id, '` en ', regexp_extract(path, '[^/]*$'), CASE WHEN line IS NULL THEN '' ELSE ':' || line END), '; ' ORDER BY pos) AS evidence
FROM v_evidence WHERE pos <= 5 GROUP BY 1, 2""",
)
def s_51(t):
    return conformity.evidence_text(conformity.evidence_rows(project_findings(t), ctl.controls(t.spark), 8))


@query(
    "o_04_control_order",
    """
SELECT project_id, control_id, state, row_number() OVER (PARTITION BY project_id ORDER BY CASE state WHEN 'no_cumple' THEN 3 WHEN 'observado' THEN 2 WHEN 'no_evaluable' THEN 1 ELSE 0 END DESC,
  instrument, reference, control_id) AS n FROM v_evaluated""",
)
def o_04(t):
    rows = evaluated(t).select("project_id", "control_id", "state", "instrument", "reference")
    return placed(rows, ["project_id"], conformity.control_order()).drop("instrument", "reference")


@query(
    "f_14_controls_by_state",
    """
SELECT project_id, control_id, state FROM v_evaluated WHERE state IN ('no_cumple', 'no_evaluable')""",
)
def f_14(t):
    e = evaluated(t)
    return (
        conformity.not_met(e).unionByName(conformity.not_assessable(e)).select("project_id", "control_id", "state")
    )
