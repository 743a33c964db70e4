"""Sharding by a hierarchical weighted hash tree: regions hold racks, racks hold shards, and each row descends by hash draws.

At every level each child draws ``-ln(u) / weight`` from a hash of the row's key and the child's own name, and the smallest draw
wins. A draw depends on no other child, so when a weight grows, rows move only into that subtree; when one shrinks or a child
leaves, only rows of that subtree move; all others stay where they are. New capacity is therefore added as a region of its own.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import durable

# Bytes of a record beside its text.
OVERHEAD = 8


@dataclass(frozen=True)
class Leaf:
    """A shard, the rack and the region it stands in, and its weight, which is above 0."""

    shard: int
    rack: str
    region: str
    weight: float = 1.0


def even_tree(n_shards: int, shards_per_rack: int = 4, racks_per_region: int = 2) -> list[Leaf]:
    """Shards 0 to ``n_shards`` - 1 of equal weight, in racks and regions that are full but for the last ones."""
    places = [(s, s // shards_per_rack) for s in range(n_shards)]
    return [Leaf(s, f"rack{rack}", f"region{rack // racks_per_region}") for s, rack in places]


def grown(tree: Sequence[Leaf], weight: float = 1.0) -> list[Leaf]:
    """One more shard, numbered on, in a rack and a region of its own: rows move into it and nowhere else."""
    n = max((leaf.shard for leaf in tree), default=-1) + 1
    return [*tree, Leaf(n, f"rack-of-{n}", f"region-of-{n}", weight)]


def _checked(tree: Sequence[Leaf]) -> None:
    if not tree:
        raise ValueError("a tree needs a shard")
    if len({leaf.shard for leaf in tree}) < len(tree):
        raise ValueError("shard numbers must differ")
    if any(not 0 < leaf.weight < float("inf") for leaf in tree):
        raise ValueError("weights must be above 0 and finite")


def _children(tree: Sequence[Leaf]) -> Column:
    """The tree as one constant: regions with name, weight and racks, these with name, weight and shards."""
    regions: dict[str, dict[str, list[Leaf]]] = {}
    for leaf in tree:
        regions.setdefault(leaf.region, {}).setdefault(leaf.rack, []).append(leaf)

    def node(name: str, leaves: Sequence[Leaf], *more: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), F.lit(float(sum(x.weight for x in leaves))).alias("weight"), *more)

    def shards(leaves: Sequence[Leaf]) -> Column:
        return F.array(*[node(f"shard/{x.shard}", [x], F.lit(x.shard).alias("shard")) for x in leaves]).alias("shards")

    def racks(region: str, of: dict[str, list[Leaf]]) -> Column:
        return F.array(*[node(f"rack/{region}/{name}", leaves, shards(leaves)) for name, leaves in of.items()]).alias("racks")

    return F.array(*[node(f"region/{name}", [x for leaves in of.values() for x in leaves], racks(name, of)) for name, of in regions.items()])


def _drawn(key: Column, children: Column) -> Column:
    """The child with the smallest draw; of equal draws the first one in the tree."""

    def draw(child: Column, at: Column) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(key, child["name"]), 11)
        uniform = (bits + F.lit(0.5)) / F.lit(float(1 << 53))
        return F.struct((-F.log(uniform) / child["weight"]).alias("draw"), at.alias("at"), child.alias("child"))

    return F.array_min(F.transform(children, draw))["child"]


def shard_of(key: Column, tree: Sequence[Leaf]) -> Column:
    """The shard number of a key, by three draws; a null key is a key like any other."""
    _checked(tree)
    name = F.coalesce(key.cast("string"), F.lit("\u0000null"))
    region = _drawn(name, _children(tree))
    rack = _drawn(name, region["racks"])
    return _drawn(name, rack["shards"])["shard"]


def text_size(text: Column) -> Column:
    """UTF-8 bytes of a text, none for a null, and what a record has beside it."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def placed(
    docs: DataFrame, tree: Sequence[Leaf], id_col: str = "doc_id", grown_tree: Sequence[Leaf] | None = None
) -> DataFrame:
    """``docs`` with ``shard`` and, for a second tree, ``grown_shard``: one narrow pass of built-in functions.

    The id alone decides, so rows that share an id or are repeated whole share a shard, and rows without an id share one, too. Existing columns of
    these names are replaced; an empty table gives no rows.
    """
    key = F.col(f"`{id_col}`")
    out = {"shard": shard_of(key, tree)}
    if grown_tree is not None:
        out["grown_shard"] = shard_of(key, grown_tree)
    return docs.withColumns(out)


def with_slots(rows: DataFrame, shard_col: str = "shard") -> DataFrame:
    """``rows`` with ``slot``: 0, 1, 2, ... without gaps within each shard, in the order of the stored rows; rows without a
    shard count as one shard of their own.

    The rows are written to the shared folder once, which fixes their places. Each stored part numbers its own rows of a shard, and
    the parts before it give the first number: a group is never larger than a part, even if one shard, or one row repeated, holds
    a third of all rows. Keep wide columns out and join them by id, if they are needed.
    """
    others = [F.col(f"`{c}`") for c in rows.columns if c != "slot"]
    # Both numbers are written down with the rows, so they stay whatever reads them.
    stored = durable(
        rows.select(
            F.struct(*others).alias("row"), F.coalesce(F.col(f"`{shard_col}`").cast("string"), F.lit("")).alias("shard"),
            F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"),
        )
    )
    parts = stored.groupBy("shard", "part").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = parts.select("shard", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))
    within = F.row_number().over(Window.partitionBy("shard", "part").orderBy("at"))
    joined = stored.withColumn("number", within).join(firsts, ["shard", "part"])
    return joined.select("row.*", (F.col("first") + F.col("number") - 1).cast("long").alias("slot"))


def write_shards(rows: DataFrame, path: str, shard_col: str = "shard", rows_per_file: int = 1_000_000) -> None:
    """Whole records as Parquet, one folder a shard, in files of a bounded number of rows. Written to a new path by the tasks that hold the rows, without a shuffle."""
    rows.write.option("maxRecordsPerFile", rows_per_file).partitionBy(shard_col).parquet(path)
