"""The hash tree's laws, and the query against a plain descent."""

import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from partwatch.llm import shards
from partwatch.llm.queries import QUERIES
from partwatch.llm.shards import Leaf, even_tree, grown

TREE = [
    Leaf(0, "a", "north"), Leaf(1, "a", "north"), Leaf(2, "b", "north", 2.0), Leaf(3, "a", "south", 3.0), Leaf(4, "c", "south"), Leaf(5, "c", "south", 0.5),
]


def shard_map(spark, tree, n=20_000):
    rows = shards.placed(spark.range(n).select(F.col("id").alias("doc_id")), tree)
    return {r.doc_id: r.shard for r in rows.collect()}


def test_shares_follow_weights(spark):
    n, whole = 20_000, sum(leaf.weight for leaf in TREE)
    seen = Counter(shard_map(spark, TREE, n).values())
    for leaf in TREE:
        expected = n * leaf.weight / whole
        assert abs(seen[leaf.shard] - expected) < 5 * math.sqrt(expected)


@pytest.mark.parametrize("tree", [even_tree(24), even_tree(1), even_tree(7, 2, 2), TREE])
def test_growth_takes_rows_only_into_the_new_shard(spark, tree):
    for _ in range(3):
        larger = grown(tree)
        new = larger[-1].shard
        old_map, new_map = shard_map(spark, tree, 6_000), shard_map(spark, larger, 6_000)
        moved = {d for d in old_map if old_map[d] != new_map[d]}
        assert moved and all(new_map[d] == new for d in moved)
        tree = larger


def test_movement_stays_in_subtrees_whose_weight_changes(spark):
    before = shard_map(spark, TREE)
    region, rack = {x.shard: x.region for x in TREE}, {x.shard: (x.region, x.rack) for x in TREE}
    heavier = [Leaf(x.shard, x.rack, x.region, x.weight * (4 if x.shard == 1 else 1)) for x in TREE]
    for d, s in shard_map(spark, heavier).items():
        if s != before[d]:  # into the region, within it into the rack, within this into the shard
            assert region[s] == "north"
            assert region[before[d]] != "north" or (rack[s] == ("north", "a") and (rack[before[d]] != ("north", "a") or s == 1))
    without = [x for x in TREE if x.shard != 4]
    for d, s in shard_map(spark, without).items():
        if s != before[d]:
            assert region[before[d]] == "south" and (region[s] != "south" or rack[before[d]] == ("south", "c"))


def test_faulty_trees():
    for tree in ([], [Leaf(0, "a", "n"), Leaf(0, "b", "n")], [Leaf(0, "a", "n", 0.0)], [Leaf(0, "a", "n", math.inf)]):
        with pytest.raises(ValueError):
            shards.shard_of(F.lit(1), tree)


def test_query(spark, small, tmp_path):
    docs = [*small, (None, "x"), (None, None), (None, "x"), *[(5, "same text")] * 3_000, (6, "Ünïcode ñ" * 50)]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(7).write.parquet(str(tmp_path / "documents.parquet"))
    rows = QUERIES["op12_hash_tree_sharding"](spark, str(tmp_path)).collect()
    assert rows[0].__fields__ == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    plain = Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in docs)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == plain
    slots, homes = defaultdict(list), defaultdict(set)
    for r in rows:
        slots[r.shard].append(r.slot)
        homes[r.doc_id].add((r.shard, r.grown_shard))
        assert r.law == "key" and 0 <= r.shard < 24 and r.grown_shard in (r.shard, 24)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(h) == 1 for h in homes.values())


def test_odd_tables(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert shards.with_slots(shards.placed(empty, TREE)).count() == 0
    clash = spark.createDataFrame([(1, "a", 9, 8, 7), (None, "b", 9, None, 7), (1, "a", 9, 8, 7)], "doc_id long, row string, shard int, part int, slot int")
    out = shards.with_slots(shards.placed(clash, even_tree(1)))
    assert out.columns == ["doc_id", "row", "shard", "part", "slot"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(
        [(1, "a", 0, 8, s) for s in {r.slot for r in out.where("doc_id = 1").collect()}] + [(None, "b", 0, None, s) for s in {r.slot for r in out.where("doc_id IS NULL").collect()}], key=str
    )
    assert {r.slot for r in out.collect()} == {0, 1, 2}
    given = spark.createDataFrame([(1, None), (2, None), (3, 4)], "doc_id long, shard int")
    assert sorted((str(r.shard), r.slot) for r in shards.with_slots(given).collect()) == [("4", 0), ("None", 0), ("None", 1)]


def test_written_shards(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(500)], "doc_id long, text string").repartition(3)
    tree = even_tree(5)
    shards.write_shards(shards.placed(docs, tree), str(tmp_path / "out"), rows_per_file=20)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.doc_id, r.text, r.shard) for r in back.collect()} == {(r.doc_id, r.text, r.shard) for r in shards.placed(docs, tree).collect()}
