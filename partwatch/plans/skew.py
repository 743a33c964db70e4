"""Plan shapes that hold when one key carries a large share of all rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPREAD = 1_024
# Rows of a key beyond which it is worked on by more than one task.
HEAVY = 100_000


def durable(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder of the session, so that lost executors do not lose it."""
    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and (context.master == "local" or context.master.startswith("local[")):  # one machine
        folder = tempfile.mkdtemp(prefix="partwatch-checkpoint-")
    if folder is None:
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    context.setCheckpointDir(folder)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of the session, for tables that a job writes and reads."""
    _ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def lookup_join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join to a table with one row per key, safe for keys that repeat very often on the left.

    A plain join, so that columns nobody reads are pruned from ``right``. The rows of a hot key are in partitions that adaptive
    execution splits (``spark.sql.adaptive.skewJoin``): the right side has one row for such a key, so each part gets a copy of it.
    """
    return left.join(right, list(on), "left")


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str) -> DataFrame:
    """The first ``n`` rows of each group, ranked from 1.

    Spark cuts each task's rows to the first ``n`` of a group before the shuffle, for limits up to its own threshold. Beyond
    it, salted parts of a group are cut first, so that a large group is not sorted in one task.
    """
    keys = list(keys)
    window = Window.partitionBy(*keys).orderBy(*order)
    if n > int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")):
        salted = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = (
            df.withColumn("_salt", F.pmod(F.xxhash64(*order_columns(df, keys)), F.lit(SPREAD)))
            .withColumn("_rank", F.row_number().over(salted))
            .where(F.col("_rank") <= n)
            .drop("_rank", "_salt")
        )
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)


def heavy_keys(df: DataFrame, key: str, most: int | None = None) -> list:
    """Keys with more than ``most`` rows; there are at most as many as rows divided by that."""
    counts = df.groupBy(key).agg(F.count("*").alias("_n"))
    return [r[0] for r in counts.where(F.col("_n") > (HEAVY if most is None else most)).select(key).collect()]


def with_key(df: DataFrame, key: str, keys: list, inside: bool) -> DataFrame:
    """The rows whose key, which may be null, is one of ``keys``, or the others."""
    if not keys:
        return df.where(F.lit(False)) if inside else df
    known = [k for k in keys if k is not None]
    hit = F.coalesce(F.col(key).isin(known), F.lit(False)) if known else F.lit(False)
    hit = hit | F.col(key).isNull() if None in keys else hit
    return df.where(hit if inside else ~hit)


def order_columns(df: DataFrame, keys: Sequence[str]) -> list[str]:
    """Columns a row can be hashed by (maps cannot)."""
    return [f.name for f in df.schema.fields if f.name not in keys and "map<" not in f.dataType.simpleString()]


def running_totals(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], measures: dict[str, Column], written: bool = False
) -> DataFrame:
    """Running sums per group in a total order, without putting one group into one task.

    Rows are written down before they are range-partitioned by group and order, as the borders of the ranges come from a pass of their
    own, which would work the rows out once more; rows that come from a checkpoint are ``written`` already. Each range sums locally; only groups that continue over several ranges need an
    offset, so there are fewer offsets than ranges and they can be broadcast.
    """
    keys = list(keys)
    ranged = df.select("*", *[m.alias(f"_m_{name}") for name, m in measures.items()])
    ranged = ranged if written else durable(ranged)
    ranged = durable(ranged.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    local = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(*keys, "_range").agg(*[F.sum(f"_m_{n}").alias(f"_s_{n}") for n in measures])
    offsets = sums.select(
        *keys, "_range", *[F.sum(f"_s_{n}").over(before).alias(f"_o_{n}") for n in measures]
    ).where(F.col(f"_o_{next(iter(measures))}").isNotNull())
    joined = ranged.join(F.broadcast(offsets), [*keys, "_range"], "left")
    totals = [
        (F.sum(f"_m_{n}").over(local) + F.coalesce(F.col(f"_o_{n}"), F.lit(0))).alias(n) for n in measures
    ]
    return joined.select(*df.columns, *totals)
