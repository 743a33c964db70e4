"""Guard over archive listings (F-15, W-12)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.skew import running_totals

# Fixed values.
MAX_BYTES = 500 * 1024 * 1024
MAX_FILES = 20_000
MAX_RATIO = 200.0
RATIO_FROM = 1_000_000
ESCAPE = r"(^|/)\.\.(/|$)|^/|^[A-Za-z]:"


def verdicts(entries: DataFrame, max_bytes: int = MAX_BYTES, max_files: int = MAX_FILES) -> DataFrame:
    """F-15: ``entries(archive, entry, path, bytes, packed, is_link)`` to one verdict per archive."""
    ratio = F.when(F.col("packed") > 0, F.col("bytes") / F.col("packed"))
    suspicious = (ratio > MAX_RATIO) & (F.col("bytes") > RATIO_FROM)
    return entries.groupBy("archive").agg(
        F.sum("bytes").alias("bytes"),
        F.count("*").alias("files"),
        (F.sum("bytes") > max_bytes).alias("too_big"),
        (F.count("*") > max_files).alias("too_many"),
        F.bool_or(F.coalesce(suspicious, F.lit(False))).alias("bad_ratio"),
        F.bool_or("is_link").alias("has_link"),
        F.bool_or(F.col("path").rlike(ESCAPE)).alias("escapes"),
    )


def first_breach(entries: DataFrame, max_bytes: int = MAX_BYTES, max_files: int = MAX_FILES) -> DataFrame:
    """W-12: the entry at which each archive first breaks a limit."""
    order = [F.asc("entry"), F.asc("path")]
    measures = {"total_bytes": F.col("bytes"), "total_files": F.lit(1).cast("bigint")}
    totals = running_totals(entries.select("archive", "entry", "path", "bytes"), ["archive"], order, measures)
    over = totals.where((F.col("total_bytes") > max_bytes) | (F.col("total_files") > max_files))
    return over.groupBy("archive").agg(
        F.min_by(F.struct("entry", "path", "total_bytes", "total_files"), F.struct("entry", "path")).alias("b")
    ).select("archive", "b.*")
