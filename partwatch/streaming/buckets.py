"""Tables that batches of a stream change: Parquet in hash buckets of the key, of which a batch rewrites only those it touches.

Every row holds the number of the last batch that changed its bucket. A batch that is repeated, after a crash or not, finds that
number and leaves the bucket as it is. The new content of all touched buckets is written aside first (over that of the batch before),
so that a batch that stopped while buckets were being exchanged is finished from there and nothing is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET, BUCKETS, BATCH = "bucket", "buckets", "batch"
ADDED = (BUCKETS, BUCKET, BATCH)


def bucket_of(key: Sequence[str], n: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(n)).cast("int")


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of the table, without its own columns; None if no batch has been written."""
    rows = _stored(spark, f"{path}/rows")
    return None if rows is None else rows.drop(*ADDED)


def batches_of(spark: SparkSession, path: str) -> DataFrame | None:
    """The last batch of each bucket that has rows."""
    rows = _stored(spark, f"{path}/rows")
    return None if rows is None else rows.groupBy(BUCKET).agg(F.max(BATCH).alias(BATCH))


def apply_batch(
    new: DataFrame, batch_id: int, path: str, key: Sequence[str], combine: Callable[[DataFrame | None, DataFrame], DataFrame], n_buckets: int = 64
) -> list[int]:
    """Change the table by a batch and return the numbers of the buckets that were rewritten.

    ``combine(old, new)`` gets the old and the new rows of the touched buckets (old is None before the first batch) and returns the
    rows that they hold then; no bucket becomes empty by it. Only bucket numbers, at most ``n_buckets``, come to the driver. A
    table keeps the number of buckets it was made with.
    """
    spark, columns = new.sparkSession, list(new.columns)
    old = _stored(spark, f"{path}/rows")
    done = _stored(spark, f"{path}/written")
    written = set() if done is None else {r[0] for r in done.where(F.col(BATCH) == batch_id).select(BUCKET).collect()}
    if written:
        touched = written - _reached(old, written, batch_id)
    else:
        numbered = new.withColumn(BUCKET, bucket_of(key, n_buckets))
        touched = {r[0] for r in numbered.select(BUCKET).distinct().collect()}
        if old is not None:
            made_with = old.select(BUCKETS).first()[0]
            if made_with != n_buckets:
                raise ValueError(f"the table has {made_with} buckets, not {n_buckets}")
            touched -= _reached(old, touched, batch_id)
        if touched:
            mine = None if old is None else old.where(F.col(BUCKET).isin(*touched)).drop(*ADDED)
            rows = combine(mine, numbered.where(F.col(BUCKET).isin(*touched)).select(*columns))
            numbers = {BUCKETS: F.lit(n_buckets), BUCKET: bucket_of(key, n_buckets), BATCH: F.lit(batch_id).cast("long")}
            rows.withColumns(numbers).write.mode("overwrite").parquet(f"{path}/aside")
            marks = spark.createDataFrame([(batch_id, b) for b in sorted(touched)], f"{BATCH} long, {BUCKET} int")
            marks.coalesce(1).write.mode("overwrite").parquet(f"{path}/written")
    if touched:
        aside = spark.read.parquet(f"{path}/aside").where(F.col(BUCKET).isin(*touched))
        (
            aside.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy(BUCKETS, BUCKET).parquet(f"{path}/rows")
        )
    return sorted(touched)


def _reached(old: DataFrame | None, touched: set[int], batch_id: int) -> set[int]:
    """Buckets that this batch or a later one has changed already."""
    if old is None or not touched:
        return set()
    return {r[0] for r in old.where(F.col(BUCKET).isin(*touched) & (F.col(BATCH) >= batch_id)).select(BUCKET).distinct().collect()}
