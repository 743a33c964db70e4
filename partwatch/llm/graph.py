"""Connected components of links, and intermediate results that survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _folder(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``; one of its own only on a single machine where that is unset."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and (context.master == "local" or context.master.startswith("local[")):
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        if folder is None:
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """The rows as a checkpoint in the shared folder."""
    _folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: for wide rows, of which later steps read some columns."""
    path = f"{_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _lowest(edges: DataFrame, own: bool) -> DataFrame:
    """Each edge's start with the lowest node among its ends (and itself, if ``own``)."""
    low = F.min("v")
    return edges.groupBy("u").agg((F.least(low, F.col("u")) if own else low).alias("m"))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest node reachable from each linked node, by alternating large-star and small-star rounds.

    ``links`` has columns ``u`` and ``v`` (repeats and self-links are allowed). Returns ``node`` and ``component`` for nodes
    that are not the smallest of theirs. Each round is two aggregations and two joins on the current edges, checkpointed; only
    a count and a checksum come to the driver. Raises if ``rounds`` do not suffice (they grow with the square of the log of
    the longest path).
    """
    edges = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    edges, before = durable(edges), None
    for _ in range(rounds):
        both = edges.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        large = (
            both.join(_lowest(both, True), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        low = _lowest(large, False)
        ends = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))
        edges = durable(large.join(low, "u").select(F.inline(ends)).where("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
