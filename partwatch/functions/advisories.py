"""Advisory shaping and severity (S-09..S-13)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import let

# Fixed values.
MALWARE_PHRASES = (
    "malicious package",
    "malware",
    "data exfiltration",
    "credential steal",
    "backdoor",
    "supply chain attack",
)
DETAIL_TYPE = (
    "struct<id:string,osv_id:string,aliases:array<string>,summary:string,details:string,"
    "severity:string,published:string,modified:string,references:array<string>>"
)


def no_details() -> Column:
    return F.lit(None).cast(f"array<{DETAIL_TYPE}>")


def cvss_band(score: Column) -> Column:
    """Band of a numeric score, else of a severity word inside the text."""
    return let(F.upper(score), _band)


def _band(s: Column) -> Column:
    number = F.when(
        s.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)(E[+-]?\d+)?\s*$"), s.try_cast("double")
    )
    worded = (
        F.when(s.contains("CRITICAL"), "crítica")
        .when(s.contains("HIGH"), "alta")
        .when(s.contains("MEDIUM") | s.contains("MODERATE"), "media")
        .when(s.contains("LOW"), "baja")
    )
    graded = lambda n: (
        F.when(n >= 9, "crítica").when(n >= 7, "alta").when(n >= 4, "media").when(n > 0, "baja")
    )
    return let(number, lambda n: F.when(n.isNotNull(), graded(n)).otherwise(worded))


def band_rank(band: Column) -> Column:
    return let(
        band,
        lambda b: F.when(b == "crítica", 4).when(b == "alta", 3).when(b == "media", 2).when(b == "baja", 1),
    )


def band_of_rank(rank: Column) -> Column:
    return let(
        rank,
        lambda r: F.when(r == 4, "crítica").when(r == 3, "alta").when(r == 2, "media").when(r == 1, "baja"),
    )


def max_severity(details: Column) -> Column:
    """Highest band in a list of details; elements without one are ignored."""
    return band_of_rank(F.array_max(F.transform(details, lambda d: band_rank(cvss_band(d["severity"])))))


def preferred_id(osv_id: Column, aliases: Column) -> Column:
    return F.coalesce(F.get(F.filter(aliases, lambda a: a.startswith("CVE-")), F.lit(0)), osv_id)


def shape(osv_id, aliases, severities, references, summary, details, published, modified) -> Column:
    """Compact detail of an advisory, with its whole texts; references are cut to five before empty urls are dropped."""
    scores = F.filter(F.transform(severities, lambda s: s["score"]), lambda s: s != "")
    urls = F.filter(
        F.transform(F.slice(references, 1, 5), lambda r: r["url"]), lambda u: u != ""
    )
    return F.struct(
        preferred_id(osv_id, aliases).alias("id"),
        osv_id.alias("osv_id"),
        F.coalesce(aliases, F.array().cast("array<string>")).alias("aliases"),
        F.coalesce(summary, F.lit("")).alias("summary"),
        F.coalesce(details, F.lit("")).alias("details"),
        F.get(scores, F.lit(0)).alias("severity"),
        published.alias("published"),
        modified.alias("modified"),
        F.coalesce(urls, F.array().cast("array<string>")).alias("references"),
    )


def displayed(detail: Column, summary: int = 300, details: int = 1000) -> Column:
    """A detail with its texts cut for display. Nothing is judged on it."""
    return detail.withField("summary", F.left(detail["summary"], F.lit(summary))).withField("details", F.left(detail["details"], F.lit(details)))


def detail_stub(osv_id: Column) -> Column:
    """What is known of an advisory whose detail is missing."""
    return F.struct(
        osv_id.alias("id"),
        osv_id.alias("osv_id"),
        F.array().cast("array<string>").alias("aliases"),
        F.lit("").alias("summary"),
        F.lit("").alias("details"),
        F.lit(None).cast("string").alias("severity"),
        F.lit(None).cast("string").alias("published"),
        F.lit(None).cast("string").alias("modified"),
        F.array().cast("array<string>").alias("references"),
    )


def marks_malware(d: Column) -> Column:
    ids = F.upper(F.concat_ws(" ", d["id"], d["osv_id"], F.array_join(d["aliases"], " ")))
    text = F.lower(F.concat_ws(" ", d["summary"], d["details"]))
    hit = ids.contains("MAL-")
    for phrase in MALWARE_PHRASES:
        hit = hit | text.contains(phrase)
    return hit


def malware_evidence(details: Column) -> Column:
    """Id of the first detail that marks a package as malicious, else null."""
    first = F.get(F.filter(details, marks_malware), F.lit(0))
    return F.coalesce(first["id"], first["osv_id"])


def has_malware(details: Column) -> Column:
    return F.coalesce(F.exists(details, marks_malware), F.lit(False))
