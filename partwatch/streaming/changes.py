"""Streams that keep a table up to date: the inventory (T-03) and the audit history with its latest verdicts (T-04)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sinks.tables import newest_row, upsert_cycles
from . import buckets

CYCLE_KEY = ["slug", "cycle"]


def _started(rows: DataFrame, apply, mode: str, checkpoint: str) -> StreamingQuery:
    writer = rows.writeStream.foreachBatch(apply).outputMode(mode).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def upsert_stream(items: DataFrame, kind: str, table: str, checkpoint: str, n_buckets: int = 64) -> StreamingQuery:
    """T-03: upsert what has arrived into the inventory under ``table``.

    Of the rows of a key in one batch the newest by ``updated_at`` counts; batches count in order. Buckets are dealt by ``slug``, so all
    cycles of a product are in one, and a batch rewrites only those it touches. A repeated batch changes nothing.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        def combine(old: DataFrame | None, new: DataFrame) -> DataFrame:
            rows = newest_row(new, CYCLE_KEY, "updated_at").select(*new.columns)
            return rows if old is None else upsert_cycles(old.select(*new.columns), rows, kind)

        buckets.apply_batch(batch, batch_id, table, ["slug"], combine, n_buckets)

    return _started(items, apply, "append", checkpoint)


def read_inventory(spark, table: str) -> DataFrame | None:
    """The inventory, or None before its first batch."""
    return buckets.read_table(spark, table)


def history_stream(audits: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """T-04: append-only audit history; ``history.latest_verdicts`` reads it as a batch."""
    return (
        audits.writeStream.format("parquet")
        .option("path", table)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def latest_verdict_stream(audits: DataFrame, table: str, checkpoint: str, n_buckets: int = 64) -> StreamingQuery:
    """T-04: the latest verdict per application, kept up to date under ``table``.

    A running ``max_by`` in update mode gives the applications that changed, whole; they replace their rows in the buckets that they
    are in. State is one row per application. ``read_verdicts`` gives what ``history.latest_verdicts`` gives on all audits so far.
    """
    latest = audits.groupBy("app_name").agg(
        F.max_by("verdict", F.struct("created_at", "id")).alias("verdict"), F.count("*").alias("audits")
    )

    def replace(old: DataFrame | None, new: DataFrame) -> DataFrame:
        if old is None:
            return new
        changed = new.select(F.col("app_name").alias("_changed"))
        return old.join(changed, F.col("app_name").eqNullSafe(F.col("_changed")), "left_anti").unionByName(new)

    def apply(batch: DataFrame, batch_id: int) -> None:
        buckets.apply_batch(batch, batch_id, table, ["app_name"], replace, n_buckets)

    return _started(latest, apply, "update", checkpoint)


def read_verdicts(spark, table: str) -> DataFrame | None:
    return buckets.read_table(spark, table)
