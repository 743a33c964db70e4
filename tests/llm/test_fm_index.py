import numpy as np
from pyspark.sql import functions as F

from partwatch.llm import fm_index
from partwatch.llm.queries import op3_benchmark_decontamination

from . import brute

SF = "/root/testdata/sf0.001"


def test_suffix_array():
    rng = np.random.default_rng(0)
    texts = [rng.integers(0, k, n) for k, n in ((2, 300), (5, 400), (90, 700), (1, 40))] + [np.tile(rng.integers(0, 9, 50), 8), np.zeros(1, int)]
    for text in texts:
        assert fm_index.suffix_array(text).tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    got = {tuple(r) for r in op3_benchmark_decontamination(spark, SF).collect()}
    assert got == set(brute.decontaminate(docs, items))
    assert any(r[5] for r in got)


def test_short_items_slices_and_odd_rows(spark, small):
    items = [(1, "of the"), (2, "the"), (2, None), (3, ""), (4, "x y z w v u x y z w v u x y z"), (5, small[7][1]), (6, "é ñ ß"), (7, "the of the")]
    docs = list(dict(small).items()) + [(-1, "é, Ñ é ñ ß of"), (-2, "the the")]
    frame = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, items string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (1 << 20, 10):
        rows = fm_index.find_contamination(frame, bench, slice_chars=size)
        rows = rows.select("doc_id", "n_words", "n_hit", F.size("items"), F.sha2(F.array_join("items", ","), 256), "contaminated")
        assert {tuple(r) for r in rows.collect()} == set(brute.decontaminate(docs, items))
    none = fm_index.find_contamination(frame, bench.where("false"))
    assert none.where("n_hit > 0 OR size(items) > 0 OR contaminated").count() == 0 and none.count() == len(docs)
    assert fm_index.find_contamination(frame.where("false"), bench).count() == 0
