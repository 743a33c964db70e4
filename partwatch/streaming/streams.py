"""Streams: quota breaches (T-01), and the other streams under one name (T-02..T-04)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .changes import history_stream, latest_verdict_stream, read_inventory, read_verdicts, upsert_stream
from .lookups import DETAIL_TTL, LOOKUP_TTL, fresh_lookup_stream, fresh_lookups

__all__ = [
    "DETAIL_TTL", "LIMITS", "LOOKUP_TTL", "fresh_lookup_stream", "fresh_lookups", "history_stream", "latest_verdict_stream",
    "quota_breaches", "read_inventory", "read_verdicts", "upsert_stream",
]

# Requests per minute.
LIMITS = {"catalog": 200, "refresh": 3, "audit": 30, "report": 10, "codescan": 5}


def quota_breaches(requests: DataFrame, limit: int, keys=("user_id",), delay: str = "2 minutes") -> DataFrame:
    """T-01: keys over ``limit`` in a one-minute window. Works on a stream or on a batch.

    Partial counts combine before the shuffle, so one busy key costs one row per task and window.
    """
    source = requests.withWatermark("ts", delay) if requests.isStreaming else requests
    counts = source.groupBy(F.window("ts", "1 minute").alias("w"), *keys).agg(F.count("*").alias("requests"))
    return counts.where(F.col("requests") > limit).select(F.col("w.start").alias("minute"), *keys, "requests")
