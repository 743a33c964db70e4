"""Dependency audit: newest version, gap, vulnerabilities, compliance, risk and recommendation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.advisories import DETAIL_TYPE, band_of_rank, band_rank, cvss_band, detail_stub, marks_malware
from ..functions.common import lookup
from ..functions.compliance import compliance_category, compliance_level, compliance_record
from ..functions.dependency_risk import (
    dependency_risk,
    known_risks,
    level_rank,
    mitigations,
    severity_label,
    technical_precision,
)
from ..functions.versions import npm_gap
from ..plans.skew import lookup_join, top_per_group

# Fixed values. The first limits what a report lists, not what is judged.
MAX_LISTED_ADVISORIES = 8
NPM_EOL_PAGES = {
    "bootstrap": "bootstrap",
    "@angular/core": "angular",
    "@angular/cli": "angular",
    "vue": "vue",
    "react": "react",
    "next": "nextjs",
    "nuxt": "nuxt",
    "express": "express",
    "electron": "electron",
    "typescript": "typescript",
    "node": "nodejs",
}
VERDICTS = (
    ("legal_crítico", "NO RECOMENDADO — RIESGO LEGAL GRAVÍSIMO", "crítico"),
    ("crítico", "NO RECOMENDADO — riesgo técnico crítico", "crítico"),
    ("legal_alto", "NO RECOMENDADO — RIESGO LEGAL GRAVE", "alto"),
    ("alto", "NO RECOMENDADO — riesgo técnico alto", "alto"),
    ("medio", "RECOMENDADO CON OBSERVACIONES", "medio"),
    ("bajo", "RECOMENDADO CON OBSERVACIONES MENORES", "bajo"),
)
ENTRY_FIELDS = {
    "note": "string",
    "vuln_status": "string",
    "vuln_count": "bigint",
    "vuln_ids": "array<string>",
    "vuln_details": f"array<{DETAIL_TYPE}>",
    "severity": "string",
    "malicious": "boolean",
    "malware_id": "string",
    "ecosystem": "string",
    "latest": "string",
    "latest_label": "string",
    "description": "string",
    "platform_kind": "string",
    "platform_level": "string",
    "platform_note": "string",
    "platform_reco": "string",
}


def with_entry_fields(deps: DataFrame) -> DataFrame:
    """Add the optional columns of an entry that are not there yet, as nulls."""
    missing = [
        F.lit(None).cast(t).alias(name) for name, t in ENTRY_FIELDS.items() if name not in deps.columns
    ]
    return deps.select("*", *missing)


def lookup_keys(deps: DataFrame) -> DataFrame:
    """Distinct packages to look up (A-23)."""
    return deps.select("package").distinct()


def limit_dependencies(deps: DataFrame, n: int) -> DataFrame:
    """At most ``n`` dependencies per project in document order, with a flag on cut projects (O-12)."""
    totals = deps.groupBy("project_id").agg((F.count("*") > n).alias("truncated"))
    kept = top_per_group(deps, ["project_id"], [F.col("ord")], n, "_rank").drop("_rank")
    return kept.join(totals, "project_id")


def with_newest(deps: DataFrame, newest: DataFrame) -> DataFrame:
    """J-05 and S-05. ``newest(package, lookup, latest, homepage, repository, description)``, one row per package;
    ``lookup`` is found, not-found or neterror, and a package without a row was not found."""
    joined = lookup_join(deps, newest, ["package"])
    failed = F.col("lookup").eqNullSafe("neterror")
    found = F.col("lookup").eqNullSafe("found")
    note = F.when(failed, "neterror").when(
        ~found,
        F.when(F.col("installed").isNull(), "spec no resoluble (git/url/alias)").otherwise("no encontrado en npm"),
    )
    return (
        joined.withColumn("note", note)
        .withColumn("latest", F.when(found, F.col("latest")))
        .withColumn("_gap", npm_gap(F.col("installed"), F.col("latest")))
        .withColumn("outdated", F.col("_gap.outdated"))
        .withColumn("gap", F.col("_gap.gap"))
        .drop("_gap", "lookup")
    )


def resolvable(deps: DataFrame) -> DataFrame:
    """Entries whose advisories can be looked up (F-08)."""
    return deps.where(F.col("installed").isNotNull() & ~F.col("note").eqNullSafe("neterror"))


JUDGED = ("severity", "malicious", "malware_id")
LISTED = ("vuln_ids", "vuln_details")
VERSION_KEY = ["ecosystem", "package", "version"]


def advisory_details_of(affected: DataFrame, details: DataFrame) -> DataFrame:
    """J-07: each advisory of a version with its detail, or a stub where the detail is missing."""
    joined = lookup_join(affected.select(*VERSION_KEY, "osv_id"), details.select("osv_id", "detail"), ["osv_id"])
    return joined.withColumn("detail", F.coalesce(F.col("detail"), detail_stub(F.col("osv_id"))))


def advisories_by_version(affected: DataFrame, details: DataFrame) -> DataFrame:
    """A-30, A-31: per (ecosystem, package, version) the number of advisories and what all of them say together.

    Severity, malware flag and the first malware id in order of advisory ids are aggregates over every advisory, combined
    before the shuffle. ``with_listed`` adds what reports show.
    """
    detail = F.col("detail")
    malware = marks_malware(detail)
    judged = advisory_details_of(affected, details).select(
        *VERSION_KEY,
        "osv_id",
        band_rank(cvss_band(detail["severity"])).alias("_band"),
        F.when(malware, F.coalesce(detail["id"], detail["osv_id"])).alias("_malware"),
    )
    return judged.groupBy(*VERSION_KEY).agg(
        F.count("*").alias("vuln_count"),
        band_of_rank(F.max("_band")).alias("severity"),
        F.bool_or(F.col("_malware").isNotNull()).alias("malicious"),
        F.min_by("_malware", F.when(F.col("_malware").isNotNull(), F.col("osv_id"))).alias("malware_id"),
    )


def with_listed(by_version: DataFrame, affected: DataFrame, details: DataFrame, n: int = MAX_LISTED_ADVISORIES) -> DataFrame:
    """The ids and details of the first ``n`` advisories of each version, for reports; the counts stay full."""
    first = top_per_group(affected.select(*VERSION_KEY, "osv_id"), VERSION_KEY, [F.col("osv_id")], n, "pos")
    joined = lookup_join(first, details.select("osv_id", "detail"), ["osv_id"])
    detail = F.coalesce(F.col("detail"), detail_stub(F.col("osv_id")))
    lists = joined.groupBy(*VERSION_KEY).agg(F.array_sort(F.collect_list(F.struct("pos", detail.alias("detail")))).alias("_rows"))
    return by_version.join(lists, VERSION_KEY, "left").select(
        *by_version.columns,
        F.array_compact(F.transform("_rows", lambda r: r["detail"]["id"])).alias("vuln_ids"),
        F.transform("_rows", lambda r: r["detail"]).alias("vuln_details"),
    )


def with_vulnerabilities(
    deps: DataFrame, by_version: DataFrame, ecosystem: str = "npm", failed: DataFrame | None = None
) -> DataFrame:
    """J-06. Entries that are not looked up keep null columns; no match is clean with count 0.

    ``failed(ecosystem, package, version)`` are advisory lookups that failed: ``neterror``, not clean.
    """
    right = by_version.where(F.col("ecosystem") == ecosystem).drop("ecosystem").withColumnRenamed("version", "installed")
    joined = lookup_join(deps, right, ["package", "installed"])
    if failed is None:
        joined = joined.withColumn("_failed", F.lit(False))
    else:
        lost = failed.where(F.col("ecosystem") == ecosystem).select("package", F.col("version").alias("installed"), F.lit(True).alias("_failed"))
        joined = lookup_join(joined, lost.distinct(), ["package", "installed"])
    lost = F.coalesce("_failed", F.lit(False))
    looked_up = F.col("installed").isNotNull() & ~F.col("note").eqNullSafe("neterror")
    known = looked_up & ~lost
    count = F.coalesce("vuln_count", F.lit(0).cast("bigint"))
    status = F.when(known, F.when(count > 0, "vulnerable").otherwise("clean")).when(looked_up, "neterror")
    columns = {"vuln_count": count, **{c: F.col(c) for c in JUDGED + LISTED if c in by_version.columns}}
    return joined.select(*deps.columns, status.alias("vuln_status"), *[F.when(known, c).alias(name) for name, c in columns.items()])


def advisory_status(queries: DataFrame, by_version: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """J-06 for queries of any ecosystem: ``ecosystem, package, version`` with ``vuln_status`` and ``vuln_count``.

    A query that lacks one of the three cannot be asked: ``no-version`` without a count. The others are ``vulnerable`` or ``clean``, or
    ``neterror`` without a count where the lookup ``failed``.
    """
    asked = F.lit(True)
    for c in VERSION_KEY:
        asked = asked & (F.coalesce(c, F.lit("")) != "")
    joined = lookup_join(queries, by_version.select(*VERSION_KEY, "vuln_count"), VERSION_KEY)
    lost = F.lit(False)
    if failed is not None:
        joined = lookup_join(joined, failed.select(*VERSION_KEY, F.lit(True).alias("_failed")).distinct(), VERSION_KEY)
        lost = F.coalesce("_failed", F.lit(False))
    count = F.coalesce("vuln_count", F.lit(0).cast("bigint"))
    status = F.when(~asked, "no-version").when(lost, "neterror").when(count > 0, "vulnerable").otherwise("clean")
    return joined.select(*queries.columns, status.alias("vuln_status"), F.when(asked & ~lost, count).alias("vuln_count"))


def with_compliance(deps: DataFrame) -> DataFrame:
    """S-14 as columns ``legal_category`` and ``legal_level`` (the record itself is built late, for reports)."""
    category = compliance_category(F.col("package"), F.col("description"), F.col("malicious"))
    if "_category" in deps.columns:
        category = F.when(F.col("malicious") | ~F.coalesce("_judged", F.lit(False)), category).otherwise(F.col("_category"))
    judged = deps.withColumn("legal_category", category).drop("_judged", "_category")
    return judged.withColumn("legal_level", compliance_level(F.col("legal_category")))


def with_category(newest: DataFrame) -> DataFrame:
    """What name and description of a package alone say, once per package and not once per dependency; ``with_compliance`` reads it."""
    category = compliance_category(F.col("package"), F.col("description"), F.lit(False))
    return newest.select("*", category.alias("_category"), F.lit(True).alias("_judged"))


def with_compliance_record(deps: DataFrame) -> DataFrame:
    """S-15: the full finding as a nullable struct."""
    return deps.withColumn(
        "compliance", compliance_record(F.col("package"), F.col("legal_category"), F.col("malware_id"))
    )


def with_eol_page(deps: DataFrame) -> DataFrame:
    """J-04."""
    page = lookup(F.col("package"), NPM_EOL_PAGES)
    return deps.withColumn(
        "eol_url", F.concat(F.lit("https://endoflife.date/"), page)
    ).withColumn(
        "eol_info",
        F.when(page.isNotNull(), "Ver ciclo de vida en endoflife.date").otherwise(
            "Librería JS: sin EOL formal publicado (regir por releases del proyecto)."
        ),
    )


def audit_npm(deps: DataFrame, newest: DataFrame, by_version: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Declared dependencies to audited entries."""
    out = with_newest(deps, with_category(newest))
    out = with_vulnerabilities(out, by_version, failed=failed).withColumn("ecosystem", F.lit(None).cast("string"))
    return with_compliance(out)


def _sum_if(c) -> F.Column:
    return F.count_if(F.coalesce(c, F.lit(False)))


def summary_measures() -> dict[str, Column]:
    """A-01: the aggregates of a project's entries."""
    return {
        "total": F.count("*"),
        "outdated": _sum_if(F.col("outdated")),
        "major_behind": _sum_if(F.col("gap") == "major"),
        "vulnerable": _sum_if(F.col("vuln_count") > 0),
        "neterror": _sum_if(F.col("note") == "neterror"),
        "unresolved": _sum_if(F.col("note") != "neterror"),
        "compliance_flags": F.count("legal_level"),
        "compliance_critico": _sum_if(F.col("legal_level") == "crítico"),
        "compliance_alto": _sum_if(F.col("legal_level") == "alto"),
    }


def npm_summary(entries: DataFrame) -> DataFrame:
    """A-01: ten measures per project in one pass."""
    return entries.groupBy("project_id").agg(*[m.alias(name) for name, m in summary_measures().items()])


def gradle_summary(entries: DataFrame) -> DataFrame:
    """A-02: twelve measures per project; platform and plugin rows are counted apart."""
    section = F.col("section")
    dep = ~section.isin("plataforma", "plugin")
    on_deps = lambda c: _sum_if(dep & c)
    return entries.groupBy("project_id").agg(
        _sum_if(dep).alias("total"),
        on_deps(F.col("outdated")).alias("outdated"),
        on_deps(F.col("gap") == "major").alias("major_behind"),
        on_deps(F.col("vuln_count") > 0).alias("vulnerable"),
        on_deps(F.col("note") == "neterror").alias("neterror"),
        on_deps(F.col("note") != "neterror").alias("unresolved"),
        on_deps(F.col("legal_level").isNotNull()).alias("compliance_flags"),
        on_deps(F.col("legal_level") == "crítico").alias("compliance_critico"),
        on_deps(F.col("legal_level") == "alto").alias("compliance_alto"),
        _sum_if(section == "plataforma").alias("platform_items"),
        _sum_if((section == "plataforma") & F.col("platform_level").isin("alto", "medio")).alias("platform_alerts"),
        _sum_if(section == "plugin").alias("plugin_items"),
    )


def compliance_totals(entries: DataFrame) -> DataFrame:
    """A-03: findings per project by level; the packages behind them are the rows of ``legal_items``."""
    return (
        entries.where(F.col("legal_level").isNotNull())
        .groupBy("project_id")
        .agg(
            F.count("*").alias("total"),
            _sum_if(F.col("legal_level") == "crítico").alias("critico"),
            _sum_if(F.col("legal_level") == "alto").alias("alto"),
            _sum_if(F.col("legal_level") == "medio").alias("medio"),
        )
    )


def with_risk(entries: DataFrame) -> DataFrame:
    """S-18: level, score and severity of each entry."""
    e = with_entry_fields(entries)
    risk = dependency_risk(
        F.col("vuln_count"),
        F.col("severity"),
        F.col("gap"),
        F.col("note"),
        F.col("legal_level"),
        F.col("platform_kind"),
        F.col("platform_level"),
    )
    return (
        e.withColumn("_risk", risk)
        .withColumn("severity", F.col("_risk.severity"))
        .select("*", F.col("_risk.level").alias("level"), F.col("_risk.score").alias("score"))
        .drop("_risk")
    )


def with_report_texts(rated: DataFrame) -> DataFrame:
    """S-19..S-22 on rated entries."""
    e = with_compliance_record(rated)
    return e.select(
        "*",
        severity_label(F.col("level"), F.col("severity"), F.col("legal_level"), F.col("platform_kind")).alias(
            "severity_label"
        ),
        known_risks(F.col).alias("known_risks"),
        technical_precision(F.col).alias("technical_precision"),
        mitigations(F.col).alias("mitigations"),
    )


def risk_order() -> list:
    """O-02 within a project."""
    return [F.desc(level_rank(F.col("level"))), F.desc("score"), F.asc("package")]


def distribution_measures() -> dict[str, Column]:
    """A-04: the aggregates of a project's rated entries."""
    level = lambda name: _sum_if(F.col("level") == name)
    return {
        "entries": F.count("*"),
        "total_score": F.sum("score"),
        "critico": level("crítico"),
        "alto": level("alto"),
        "medio": level("medio"),
        "bajo": level("bajo"),
        "ok": level("ok"),
        "desconocido": level("desconocido"),
        "compliance_critico": _sum_if(F.col("legal_level") == "crítico"),
        "compliance_alto": _sum_if(F.col("legal_level") == "alto"),
    }


def verdict_fields(c=F.col) -> dict[str, Column]:
    """A-05: mean score and recommendation; ``c`` maps the name of a measure to its column."""
    column = {"legal_crítico": "compliance_critico", "legal_alto": "compliance_alto", "crítico": "critico"}
    verdict = verdict_level = None
    for name, text, lvl in VERDICTS:
        condition = c(column.get(name, name)) > 0
        verdict = (F.when if verdict is None else verdict.when)(condition, text)
        verdict_level = (F.when if verdict_level is None else verdict_level.when)(condition, lvl)
    return {
        "avg_score": F.round(c("total_score") / F.greatest(c("entries"), F.lit(1)), 2),
        "verdict": verdict.otherwise("RECOMENDADO"),
        "verdict_level": verdict_level.otherwise("ok"),
    }


def risk_distribution(rated: DataFrame) -> DataFrame:
    """A-04 and A-05: distribution, mean score and recommendation per project."""
    counts = rated.groupBy("project_id").agg(*[m.alias(name) for name, m in distribution_measures().items()])
    return counts.select("*", *[v.alias(name) for name, v in verdict_fields().items()])


def legal_items(rated: DataFrame) -> DataFrame:
    """A-32: one row per legal finding, sorted by risk when read in ``risk_order``."""
    return with_compliance_record(rated.where(F.col("legal_level").isNotNull())).select(
        "project_id", "package", "level", "score", "legal_level", "compliance"
    )


def priority_packages(rated: DataFrame) -> DataFrame:
    """O-08: the first five packages of level alto or worse and the first six legal ones, per project."""
    roles = F.array_compact(
        F.array(
            F.when(level_rank(F.col("level")) >= 3, "priority"),
            F.when(F.col("legal_level").isNotNull(), "legal"),
        )
    )
    listed = rated.select("project_id", "package", "level", "score", "ord", F.explode(roles).alias("role"))
    first = top_per_group(listed, ["project_id", "role"], [*risk_order(), F.asc("ord")], 6, "pos")
    ordered = lambda role, n: F.array_join(
        F.transform(
            F.array_sort(
                F.collect_list(
                    F.when((F.col("role") == role) & (F.col("pos") <= n), F.struct("pos", "package"))
                )
            ),
            lambda r: r["package"],
        ),
        ", ",
    )
    names = first.groupBy("project_id").agg(ordered("priority", 5).alias("priority"), ordered("legal", 6).alias("legal"))
    return names.select("project_id", *[F.when(F.col(c) != "", F.col(c)).alias(c) for c in ("priority", "legal")])
