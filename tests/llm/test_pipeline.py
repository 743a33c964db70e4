"""The stages of the pipeline, one after the other, against brute force on each stage's own input."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from partwatch.llm.queries import QUERIES

from . import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(-1, None, "en", "s", 0), (-2, "", None, "s", 0), (-3, "123 !!! 456", "en", "s", 11), (-4, "tzkeit ölichau loweient", None, None, None)]
    now, out = docs.unionAll(spark.createDataFrame(odd, docs.schema)), []
    out.append(now)
    for name, stage in pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, now, SF).write.parquet(path)
        now = spark.read.parquet(path)
        out.append(now)
    return out


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_columns_stay(stages):
    for df in stages[1:-1]:
        assert df.schema == stages[0].schema


def test_language(stages):
    gone = {d for d, _ in pairs(stages[0])} - {d for d, _ in pairs(stages[1])}
    assert gone == {-1, -2, -3}


def test_near_copies(stages):
    kept = {d for d, _, root in brute.jaccard_components(pairs(stages[1])) if d == root}
    assert {d for d, _ in pairs(stages[2])} == kept and len(kept) < stages[1].count()


def test_repeats(stages):
    expected = {(d, n - gone) for d, n, gone, _ in brute.substring_dedup(pairs(stages[2]))}
    assert {(d, len(brute.BLANK.findall(t))) for d, t in pairs(stages[3])} == expected
    assert stages[3].where(F.length("text") != F.col("n_chars")).count() == 0


def test_rows_that_occur_twice(spark):
    """One of each id and text stays, whole; other texts of the id are judged by themselves, rows without an id stay."""
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    words = [" ".join(f"{name}{i}" for i in range(60)) for name in "abcdef"]
    near = words[1] + " more"
    rows = [(1, words[0]), (1, words[0]), (2, words[1]), (5, near), (5, words[2]), (5, words[2]), (7, near), (8, words[3]), (9, None), (9, None)]
    rows += [(0, words[5]), (0, words[5] + " x"), (None, words[4])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], schema).repartition(3)
    kept = pipeline.drop_near_copies(spark, docs, SF)
    assert kept.schema == docs.schema
    got = sorted(pairs(kept), key=str)
    least = min((words[5], words[5] + " x"), key=lambda t: hashlib.sha256(t.encode()).hexdigest())
    assert got == sorted([(0, least), (1, words[0]), (2, words[1]), (5, words[2]), (8, words[3]), (9, None), (None, words[4])], key=str)
    assert sorted(pairs(pipeline.remove_repeats(spark, kept, SF)), key=str) == got


def test_contamination(spark, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    kept = {r[0] for r in brute.decontaminate(pairs(stages[3]), items) if not r[-1]}
    assert {d for d, _ in pairs(stages[4])} == kept and len(kept) < stages[3].count()


def test_encoding(stages):
    assert stages[5].count() == stages[4].count() and stages[5].where("NOT exact OR n_ids <> size(ids)").count() == 0


def test_run(spark, stages):
    rows = pipeline.run(spark, SF).select("doc_id", "n_ids").collect()
    assert {tuple(r) for r in rows} == {(r.doc_id, r.n_ids) for r in stages[5].where("doc_id >= 0").collect()}


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op8_language_id"](spark, "/root/testdata/sf0.01").join(docs, "doc_id").where("held_out")
    assert rows.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98


def test_quality_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    rows = QUERIES["op2_quality_classifier"](spark, sf).join(labels, "doc_id").where("held_out").select("score", "quality", "predicted").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    above = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert above > 0.97
    assert all(r.predicted == int(r.score >= 0.3) for r in rows)
