"""Impact x probability of findings, their texts and the project view (S-24..S-31, A-17..A-20, O-03, O-07)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import source_text as st
from ..functions.common import lookup, sentences
from ..narratives import NEGLECT, NEGLECT_DEFAULT, PLAIN, PLAIN_DEFAULT, WHAT
from ..plans.skew import lookup_join, running_totals, top_per_group
from ..rules import SEVERITY_RANK

# Fixed values.
SEVERITY_WEIGHT = {"crítico": 100.0, "alto": 70.0, "medio": 40.0, "bajo": 15.0, "info": 5.0}
BASE_IMPACT = {"crítico": 5, "alto": 4, "medio": 3, "bajo": 2, "info": 1}
SCALE = {1: "Muy bajo", 2: "Bajo", 3: "Medio", 4: "Alto", 5: "Muy alto"}
RISK_RANK = {"Crítico": 5, "Alto": 4, "Medio": 3, "Bajo": 2, "Informativo": 1}
EXTERNALLY_REACHABLE = (
    "NET-CLEARTEXT",
    "NET-TRUST-ALL",
    "COMP-EXPORTED",
    "WEB-JS-BRIDGE",
    "DATA-BACKUP-ON",
    "SQL-CONCAT",
    "SEC-GOOGLE-KEY",
)
SECRETS = "COMPARTIMENTAJE"
PRODUCTION = "producción"


def exposure_factor(path: Column) -> Column:
    """Weight of a file: tests, samples and documents count less than production code."""
    p = F.lower(F.coalesce(path, F.lit("")))
    return (
        F.when(p.contains("/test/") | F.substring_index(p, "/", -1).contains("test") | p.contains("/androidtest/"), 0.5)
        .when(p.contains("example") | p.contains("sample") | p.contains("mock"), 0.4)
        .when(p.endswith(".md") | p.contains("/docs/"), 0.3)
        .otherwise(1.0)
    )


def risk_level(value: Column) -> Column:
    return (
        F.when(value >= 15, "Crítico")
        .when(value >= 9, "Alto")
        .when(value >= 5, "Medio")
        .when(value >= 3, "Bajo")
        .otherwise("Informativo")
    )


def impact(severity: Column, exposure: Column) -> Column:
    base = F.coalesce(lookup(severity, BASE_IMPACT), F.lit(2))
    return F.greatest(F.when(exposure == PRODUCTION, base).otherwise(base - 1), F.lit(1))


def impact_reasons(rule: Column, category: Column, severity: Column, role: Column, exposure: Column) -> Column:
    secret_role = role.contains("credenciales") | role.contains("servicios externos") | role.contains("manifiesto")
    reasons = sentences(
        F.concat(F.lit("severidad intrínseca de la regla: "), severity),
        F.when(
            (category == SECRETS) & secret_role,
            F.format_string(
                "el archivo cumple un rol de %s, donde exponer un secreto compromete directamente el acceso a la "
                "plataforma",
                role,
            ),
        ),
        F.when(
            (rule == "SQL-CONCAT") & role.contains("persistencia"),
            "se ubica en la capa de acceso a datos, por lo que una inyección alcanzaría directamente el repositorio de "
            "información",
        ),
        F.when(
            rule.isin("NET-CLEARTEXT", "NET-TRUST-ALL") & role.contains("red"),
            "afecta la capa de comunicación con servicios remotos, exponiendo los datos en tránsito",
        ),
        F.when(
            exposure != PRODUCTION,
            "al residir en código de prueba/ejemplo, el impacto sobre el sistema productivo es menor",
        ),
    )
    return F.concat(reasons, F.lit("."))


def probability(rule, category, exposure, entropy, reachable, secret_probability) -> Column:
    """1..5. A classifier, where there is one, replaces the entropy test."""
    secret = category == SECRETS
    one = lambda c: F.when(c, 1).otherwise(0)
    classified = secret & secret_probability.isNotNull()
    raised = (
        F.when(exposure == PRODUCTION, 3).otherwise(1)
        + one(classified & (secret_probability >= 0.75))
        - one(classified & (secret_probability < 0.2))
        + one(secret & secret_probability.isNull() & (entropy >= 4.0))
        + one(reachable)
        + one(rule.isin(*EXTERNALLY_REACHABLE))
    )
    cap = F.when(rule == "LIC-MISSING", 1).when(rule == "PII-RUT", 2).otherwise(5)
    return F.greatest(F.least(raised, cap), F.lit(1))


def probability_reasons(rule, category, exposure, entropy, reachable, flow, hotspot, secret_probability) -> Column:
    secret = category == SECRETS
    percent = F.concat(F.round(secret_probability * 100).cast("int"), F.lit("%"))
    part = lambda name, default: F.coalesce(flow[name].cast("string"), F.lit(default))
    reasons = sentences(
        F.when(
            exposure == PRODUCTION, "el hallazgo reside en código de producción, alcanzable en operación real"
        ).otherwise(
            "el hallazgo reside en código de prueba/ejemplo, lo que reduce la probabilidad de un impacto real en "
            "producción"
        ),
        F.when(
            secret & (secret_probability >= 0.75),
            F.format_string(
                "el clasificador de secretos estima alta verosimilitud (%s) de que el literal sea un secreto real y "
                "utilizable",
                percent,
            ),
        )
        .when(
            secret & (secret_probability < 0.2),
            F.format_string(
                "el clasificador de secretos estima baja verosimilitud (%s): parece un marcador de posición o valor de "
                "ejemplo (posible falso positivo)",
                percent,
            ),
        )
        .when(
            secret & secret_probability.isNull() & (entropy >= 4.0),
            F.format_string("la alta entropía del literal (%.1f bits) sugiere un secreto real", entropy),
        ),
        F.when(
            reachable,
            F.format_string(
                "el análisis de flujo de datos detectó una ruta explotable: una %s (línea %s) alcanza el sumidero de %s "
                "(línea %s)",
                part("source", "entrada externa"),
                part("source_line", "?"),
                part("sink", "operación sensible"),
                part("sink_line", "?"),
            ),
        ),
        F.when(
            rule.isin(*EXTERNALLY_REACHABLE),
            "el defecto es alcanzable desde fuera de la aplicación o afecta su configuración global, por lo que un "
            "tercero podría desencadenarlo sin acceso privilegiado",
        ),
        F.when(
            hotspot,
            "el archivo concentra múltiples hallazgos (punto caliente), lo que aumenta la probabilidad de que al menos "
            "uno sea explotable y facilita el encadenamiento",
        ),
        F.when(
            rule == "LIC-MISSING",
            "no constituye una vía de explotación activa, sino una brecha de gobernanza del proyecto",
        ),
        F.when(
            rule == "PII-RUT",
            "no es una vulnerabilidad explotable en sí, sino una señal que obliga a revisar el tratamiento del dato",
        ),
    )
    return F.concat(reasons, F.lit("."))


def score(severity, category, exposure_weight, entropy) -> Column:
    bonus = F.when(category == SECRETS, F.least(entropy / 6.0, F.lit(0.6))).otherwise(0.0)
    weight = F.coalesce(lookup(severity, SEVERITY_WEIGHT), F.lit(5.0))
    return F.round(weight * exposure_weight * (1.0 + bonus), 1)


def file_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("project_id", "path").agg(F.count("*").alias("findings_in_file"))


def rate(findings: DataFrame) -> DataFrame:
    """Enriched findings. Optional inputs: ``context``, ``reachable``, ``flow`` and ``secret_probability``."""
    flow_type = "struct<source:string,source_line:int,name:string,sink:string,sink_line:int>"
    optional = {"reachable": "boolean", "flow": flow_type, "secret_probability": "double"}
    missing = [F.lit(None).cast(t).alias(n) for n, t in optional.items() if n not in findings.columns]
    role = F.col("context.role") if "context" in findings.columns else st.file_role(F.col("path"))
    f = findings.select("*", *missing, role.alias("role"))
    f = lookup_join(f, file_counts(findings), ["project_id", "path"])
    reachable = F.coalesce("reachable", F.lit(False))
    weight = exposure_factor(F.col("path"))
    f = (
        f.withColumn("hotspot", F.col("findings_in_file") >= 2)
        .withColumn("exposure_weight", weight)
        .withColumn("raw_entropy", st.entropy(F.coalesce("evidence", F.lit(""))))
        .withColumn("exposure", F.when(F.col("exposure_weight") >= 1, PRODUCTION).otherwise("prueba/ejemplo"))
    )
    c = F.col
    f = f.withColumn("impact", impact(c("severity"), c("exposure"))).withColumn(
        "probability",
        probability(c("rule_id"), c("category"), c("exposure"), c("raw_entropy"), reachable, c("secret_probability")),
    )
    return f.select(
        "*",
        score(c("severity"), c("category"), c("exposure_weight"), c("raw_entropy")).alias("score"),
        F.round("raw_entropy", 2).alias("entropy"),
        (c("impact") * c("probability")).alias("risk_value"),
        risk_level(c("impact") * c("probability")).alias("risk_level"),
        lookup(c("impact"), SCALE).alias("impact_level"),
        lookup(c("probability"), SCALE).alias("probability_level"),
    ).drop("findings_in_file")


def _located(path: Column, line: Column) -> Column:
    return F.concat(path, F.coalesce(F.concat(F.lit(", línea "), line), F.lit("")))


def with_narratives(rated: DataFrame) -> DataFrame:
    """S-31 per finding."""
    c = F.col
    construct = c("context.construct") if "context" in rated.columns else F.lit("")
    what = F.coalesce(lookup(c("rule_id"), WHAT), F.lower("title"))
    neglect = F.coalesce(lookup(c("rule_id"), NEGLECT), F.lit(NEGLECT_DEFAULT))
    inside = F.when(construct != "", F.concat(F.lit(", dentro de "), construct)).otherwise("")
    description = F.format_string(
        "En este artefacto, %s. Se detectó en %s%s, archivo cuyo rol es la %s. La evidencia capturada en contexto "
        "confirma el patrón sobre la línea señalada.",
        what,
        _located(c("path"), c("line")),
        inside,
        c("role"),
    )
    measure = F.concat(
        F.lit("En «"),
        st.file_name(c("path")),
        F.lit("»"),
        F.coalesce(F.concat(F.lit(" (línea "), c("line"), F.lit(")")), F.lit("")),
        F.lit(": "),
        c("mitigation"),
    )
    return rated.select(
        "*",
        description.alias("description"),
        F.coalesce(lookup(c("rule_id"), PLAIN), F.lit(PLAIN_DEFAULT)).alias("plain_explanation"),
        F.format_string("Dado que el archivo participa en la %s, %s", c("role"), neglect).alias("impact_in_context"),
        measure.alias("measure"),
        neglect.alias("neglect"),
        impact_reasons(c("rule_id"), c("category"), c("severity"), c("role"), c("exposure")).alias("impact_reasons"),
        probability_reasons(
            c("rule_id"),
            c("category"),
            c("exposure"),
            c("raw_entropy"),
            F.coalesce("reachable", F.lit(False)),
            c("flow"),
            c("hotspot"),
            c("secret_probability"),
        ).alias("probability_reasons"),
    )


def without_repetition(analysis: Column, guide: Column, neglect: Column) -> Column:
    """S-49: empty when the analysis only repeats guide and risk."""
    a, g, n = (st.strip(F.coalesce(x, F.lit(""))) for x in (analysis, guide, neglect))
    return F.when((g != "") & (n != "") & a.contains(g) & a.contains(n), "").otherwise(a)


def risk_order() -> list[Column]:
    """O-03, with the place of a finding as the last key."""
    rank = F.coalesce(lookup(F.col("risk_level"), RISK_RANK), F.lit(0))
    return [F.desc(rank), F.desc("score"), F.asc("path"), F.asc("line"), F.asc("rule_id")]


def export_order() -> list[Column]:
    """O-11 for findings with a score."""
    return [F.desc("score"), F.asc("path"), F.asc("line"), F.asc("rule_id")]


def severity_order() -> list[Column]:
    """O-11 for findings without one."""
    return [F.desc(F.coalesce(lookup(F.col("severity"), SEVERITY_RANK), F.lit(0))), F.asc("category"), F.asc("path")]


def numbered(rated: DataFrame, order: list[Column] | None = None, totals: dict[str, Column] | None = None, written: bool = False) -> DataFrame:
    """W-10: number the findings of each project; a large project is numbered by many tasks. ``totals`` are summed up along the way."""
    keys = order or export_order()
    return running_totals(rated, ["project_id"], keys, {"number": F.lit(1).cast("bigint"), **(totals or {})}, written)


def hotspots(findings: DataFrame, n: int) -> DataFrame:
    """A-19 and O-07: the files with most findings per project, and how often each rule occurs in them."""
    counts = file_counts(findings).where(F.col("findings_in_file") >= 2)
    top = top_per_group(counts, ["project_id"], [F.desc("findings_in_file"), F.asc("path")], n, "rank")
    rules = findings.groupBy("project_id", "path", "rule_id").agg(F.count("*").alias("times"))
    return top.join(rules, ["project_id", "path"])


def project_risk(rated: DataFrame) -> DataFrame:
    """A-17, A-18 and the counts behind them, per project."""
    rank = F.max(lookup(F.col("risk_level"), RISK_RANK))
    return rated.groupBy("project_id").agg(
        F.when(rank == 5, "crítico").when(rank == 4, "alto").when(rank == 3, "medio").otherwise("bajo").alias("global_level"),
        F.sum(F.col("score").cast("decimal(20,1)")).cast("double").alias("total_risk"),
        F.count("*").alias("findings"),
    )


def level_counts(rated: DataFrame) -> DataFrame:
    """A-20."""
    return (
        rated.groupBy("project_id", "risk_level")
        .agg(F.count("*").alias("findings"))
        .orderBy("project_id", F.desc(lookup(F.col("risk_level"), RISK_RANK)))
    )


def executive_summary(rated: DataFrame) -> DataFrame:
    """S-31 per project: counts, the finding of highest priority and the number of hotspots."""
    c = F.col
    place = F.struct(
        (-F.coalesce(lookup(c("risk_level"), RISK_RANK), F.lit(0))).alias("r"),
        (-c("score")).alias("s"),
        "path",
        "line",
        "rule_id",
    )
    top = F.struct("title", "path", "risk_level", "impact_level", "probability_level")
    severities = list(SEVERITY_RANK)
    levels = list(RISK_RANK)
    totals = rated.groupBy("project_id").agg(
        F.count("*").alias("total"),
        F.min_by(top, place).alias("top"),
        *[F.count_if(c("severity") == s).alias(f"s{i}") for i, s in enumerate(severities)],
        *[F.count_if(c("risk_level") == v).alias(f"l{i}") for i, v in enumerate(levels)],
    )
    hot = (
        file_counts(rated)
        .where(c("findings_in_file") >= 2)
        .groupBy("project_id")
        .agg(F.count("*").alias("hot"))
    )
    joined = totals.join(project_risk(rated).select("project_id", "global_level"), "project_id").join(hot, "project_id", "left")
    listed = lambda names, prefix: sentences(
        *[F.when(c(f"{prefix}{i}") > 0, F.concat(F.lit(f"{n}: "), c(f"{prefix}{i}"))) for i, n in enumerate(names)], sep=", "
    )
    focus = F.format_string(
        " La observación de mayor prioridad es «%s» en %s, con nivel de riesgo %s (impacto %s × probabilidad %s).",
        c("top.title"),
        st.file_name(c("top.path")),
        F.lower("top.risk_level"),
        F.lower("top.impact_level"),
        F.lower("top.probability_level"),
    )
    hot_text = F.when(
        c("hot") > 0,
        F.concat(
            F.lit(" Se identificaron "),
            c("hot"),
            F.lit(
                " punto(s) caliente(s) (archivos que concentran varios hallazgos), que deben revisarse de forma integral."
            ),
        ),
    ).otherwise("")
    text = F.concat(
        F.lit("El análisis estático identificó "),
        c("total"),
        F.lit(" observaciones ("),
        listed(severities, "s"),
        F.lit("). Ponderadas por contexto (impacto × probabilidad), el riesgo se distribuye en "),
        listed([v.lower() for v in levels], "l"),
        F.lit(". El nivel de riesgo agregado de la plataforma es "),
        c("global_level"),
        F.lit("."),
        focus,
        hot_text,
        F.lit(
            " Se recomienda remediar primero las observaciones de nivel crítico y alto antes de promover la plataforma a "
            "producción. Este es un insumo técnico de aseguramiento de calidad; el detalle de impacto, probabilidad y "
            "justificación de cada punto se presenta en la sección de análisis técnico."
        ),
    )
    return joined.select("project_id", text.alias("summary"))
