"""Queries that compare the declared slugs with those upstream knows, over parts of their own."""

from collections import Counter

from partwatch import dims
from partwatch.queries import QUERIES


def parts(spark, tmp_path, n=80):
    rows = [(k, f"type{k % 3}") for k in range(n)]
    spark.createDataFrame(rows, "p_partkey bigint, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


def test_every_part_counts(spark, tmp_path):
    folder = parts(spark, tmp_path)
    rows = lambda name: sorted(tuple(r) for r in QUERIES[name](spark, folder).collect())
    declared = dims.PRODUCT_CATEGORIES
    assert rows("j_02_live_slugs") == sorted(declared.items())
    assert rows("u_05_slug_intersection") == sorted((s,) for s in declared)
    assert rows("src_12_dimensions") == sorted(Counter(declared.values()).items())
    own = [(f"other-{k}", f"type{k % 3}") for k in range(len(declared), 80)]
    assert rows("x_01_extended_dimension") == sorted([*declared.items(), *own])
