"""Findings against a control catalogue: state per control, matrices and verdict.

Findings are first counted per project and rule. Everything after that works on those counts, whose number does not
grow with the findings; only the evidence lists go back to the findings, with a limit per group before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..controls import FUNCTIONS, STATE_RANK, STATES
from ..functions.common import lookup
from ..plans.skew import durable, top_per_group

# Fixed values.
BASELINE = "D11-LINEA-BASE"
MALWARE_RULE = "DEP-MALWARE"
OIDC_EVIDENCE = "AUTH-OIDC-PRESENTE"
VERDICT_DETAIL = {
    "CONFORME": "No se detectaron incumplimientos verificables por análisis estático. Persisten controles organizacionales por acreditar documentalmente.",
    "NO CONFORME": "Existen incumplimientos de severidad alta o crítica que deben remediarse antes de promover la plataforma a producción.",
    "MENOR": "Hay incumplimientos de severidad media o baja a subsanar dentro del Plan de Mejora Continua (Decreto 11).",
    "OBSERVADO": "Sin incumplimientos directos, pero existen controles observados que requieren verificación humana.",
}


def malware_findings(entries: DataFrame) -> DataFrame:
    """J-28: malicious dependencies as findings of the rule the malware controls list."""
    return entries.where(F.col("legal_category") == "paquete_malicioso").select(
        "project_id",
        F.lit(MALWARE_RULE).alias("rule_id"),
        F.lit("(manifiesto de dependencias)").alias("path"),
        F.lit(None).cast("int").alias("line"),
        F.concat(F.lit("Dependencia con aviso de malware: "), "package").alias("title"),
    )


def oidc_evidence(flags: DataFrame) -> DataFrame:
    """Projects with an OIDC hint as presence evidence (``flags`` as in ``project_flags``)."""
    return flags.where("has_oidc").select("project_id", F.lit(OIDC_EVIDENCE).alias("rule_id"))


def rule_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("project_id", "rule_id").agg(F.count("*").alias("n"))


def violations(counts: DataFrame, controls: DataFrame) -> DataFrame:
    """J-15: findings per project and control. The exploded catalogue joins by rule id."""
    pairs = controls.where("assessable").select("control_id", F.explode("violated_by").alias("rule_id"))
    return counts.join(pairs, "rule_id").groupBy("project_id", "control_id").agg(F.sum("n").alias("n_findings"))


def presence(counts: DataFrame, evidence: DataFrame, controls: DataFrame) -> DataFrame:
    """J-16: projects that show the presence a control asks for."""
    pairs = controls.select("control_id", F.explode("shown_by").alias("rule_id"))
    present = counts.select("project_id", "rule_id").unionByName(evidence.select("project_id", "rule_id"))
    return present.join(pairs, "rule_id").select("project_id", "control_id").distinct()


def evaluate(
    projects: DataFrame, findings: DataFrame, evidence: DataFrame, global_levels: DataFrame, controls: DataFrame
) -> DataFrame:
    """A-11: state of every control in every project.

    ``projects(project_id)`` are distinct, ``global_levels(project_id, global_level)`` has one row per project. The counts per
    rule, which both the violations and the presence are read from, are written down once.
    """
    counts = durable(rule_counts(findings))
    hits = violations(counts, controls)
    shown = presence(counts, evidence, controls).withColumn("shown", F.lit(True))
    rows = with_controls(projects, controls)
    joined = (
        rows.join(global_levels, "project_id", "left")
        .join(hits, ["project_id", "control_id"], "left")
        .join(shown, ["project_id", "control_id"], "left")
    )
    level = F.coalesce("global_level", F.lit("—"))
    state = (
        F.when(~F.col("assessable"), "no_evaluable")
        .when(F.col("n_findings") > 0, "no_cumple")
        .when(F.size("shown_by") > 0, F.when(F.col("shown"), "cumple").otherwise("observado"))
        .when(F.size("violated_by") > 0, "cumple")
        .when(
            F.col("control_id") == BASELINE,
            F.when(level == "crítico", "no_cumple").when(level.isin("alto", "medio"), "observado").otherwise("cumple"),
        )
        .otherwise("observado")
    )
    return joined.withColumn("state", state).select(
        "project_id",
        "control_id",
        "instrument",
        "reference",
        "domain",
        "title",
        "demand",
        "documents",
        "state",
        F.when(F.col("state") == "no_cumple", F.col("severity")).alias("severity"),
        F.coalesce("n_findings", F.lit(0).cast("bigint")).alias("n_findings"),
    )


CHUNK = 1_000


def with_controls(projects: DataFrame, controls: DataFrame) -> DataFrame:
    """One row per project and control, for a catalogue of any size.

    The catalogue is a table of chunks, each a list of about ``CHUNK`` controls; every project asks for every chunk by its number, so
    this is a join by key, of a broadcast table if the catalogue is small.
    """
    n = max(1, -(-controls.count() // CHUNK))
    dealt = controls.withColumn("_chunk", F.pmod(F.xxhash64("control_id"), F.lit(n)).cast("int"))
    chunks = dealt.groupBy("_chunk").agg(F.collect_list(F.struct(*controls.columns)).alias("_controls"))
    asked = projects.select("project_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_chunk"))
    return asked.join(chunks, "_chunk").select("project_id", F.explode("_controls").alias("c")).select("project_id", "c.*")


def control_order() -> list[Column]:
    """O-04."""
    return [F.desc(lookup(F.col("state"), STATE_RANK)), F.asc("instrument"), F.asc("reference"), F.asc("control_id")]


def evidence_rows(findings: DataFrame, controls: DataFrame, n: int) -> DataFrame:
    """W-08: the first ``n`` findings behind each control, in the order its rules are listed."""
    pairs = controls.where("assessable").select("control_id", F.posexplode("violated_by").alias("rule_pos", "rule_id"))
    joined = findings.select("project_id", "rule_id", "path", "line", "title").join(pairs, "rule_id")
    order = [F.asc("rule_pos"), F.asc("path"), F.asc("line"), F.asc("title")]
    return top_per_group(joined, ["project_id", "control_id"], order, n, "pos")


def evidence_label(rule: Column, path: Column, line: Column) -> Column:
    """S-51: ``rule`` in file:line."""
    name = F.substring_index(F.coalesce(path, F.lit("")), "/", -1)
    return F.concat(
        F.lit("`"), rule, F.lit("` en "), name, F.coalesce(F.concat(F.lit(":"), line), F.lit(""))
    )


def evidence_text(evidence: DataFrame, n: int = 5) -> DataFrame:
    """S-51: the first labels of each control on one line. At most ``n`` rows per group are collected."""
    rows = evidence.where(F.col("pos") <= n)
    label = evidence_label(F.col("rule_id"), F.col("path"), F.col("line"))
    listed = F.array_sort(F.collect_list(F.struct("pos", label.alias("label"))))
    return rows.groupBy("project_id", "control_id").agg(
        F.array_join(F.transform(listed, lambda r: r["label"]), "; ").alias("evidence")
    )


def state_counts(evaluated: DataFrame) -> DataFrame:
    """A-12: controls per state, with zeros, as columns."""
    return evaluated.groupBy("project_id").agg(*[F.count_if(F.col("state") == s).alias(s) for s in STATES])


def instrument_matrix(evaluated: DataFrame) -> DataFrame:
    """A-13."""
    return evaluated.groupBy("project_id", "instrument").pivot("state", list(STATES)).count().na.fill(0)


def function_matrix(evaluated: DataFrame) -> DataFrame:
    """A-14 and J-26: all five functions, those without a control as zeros."""
    counted = (
        evaluated.where(F.col("domain").isin(*FUNCTIONS)).groupBy("project_id", "domain").pivot("state", list(STATES)).count()
    )
    frame = evaluated.select("project_id").distinct().select(
        "project_id", F.explode(F.array(*[F.lit(f) for f in FUNCTIONS])).alias("domain")
    )
    return frame.join(counted, ["project_id", "domain"], "left").na.fill(0)


def verdict(evaluated: DataFrame) -> DataFrame:
    """A-15 and A-16 per project."""
    grave = (F.col("state") == "no_cumple") & F.col("severity").isin("crítico", "alto")
    counts = evaluated.groupBy("project_id").agg(
        *[F.count_if(F.col("state") == s).alias(s) for s in STATES], F.bool_or(F.coalesce(grave, F.lit(False))).alias("_grave")
    )
    assessed = F.col("cumple") + F.col("no_cumple") + F.col("observado")
    kind = (
        F.when((F.col("no_cumple") == 0) & (F.col("observado") == 0), "CONFORME")
        .when(F.col("_grave"), "NO CONFORME")
        .when(F.col("no_cumple") > 0, "MENOR")
        .otherwise("OBSERVADO")
    )
    return counts.withColumn("_kind", kind).select(
        "project_id",
        *STATES,
        F.when(assessed > 0, F.round(100.0 * F.col("cumple") / assessed, 1)).otherwise(0.0).alias("conformity_pct"),
        F.when(F.col("_kind").isin("MENOR", "OBSERVADO"), "CONFORME CON OBSERVACIONES").otherwise(F.col("_kind")).alias("verdict"),
        lookup(F.col("_kind"), VERDICT_DETAIL).alias("verdict_detail"),
    )


def not_met(evaluated: DataFrame) -> DataFrame:
    """F-14."""
    return evaluated.where(F.col("state") == "no_cumple")


def not_assessable(evaluated: DataFrame) -> DataFrame:
    return evaluated.where(F.col("state") == "no_evaluable")
