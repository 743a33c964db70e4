"""Windows, suffixes and shingle joins against brute force."""

from partwatch.llm.repeats import without_repeats

from . import brute

SCHEMA = "doc_id long, text string"


def test_windows(spark, small):
    for width in (35, 4):
        got = without_repeats(spark.createDataFrame(small, SCHEMA).repartition(5), width=width)
        got = {tuple(r) for r in got.select("id", "n_words", "n_removed", "kept_sha256").collect()}
        assert got == set(brute.substring_dedup(small, width))


def test_windows_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert without_repeats(empty).count() == 0
    rows = [(None, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (2, None)]
    docs = spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA + ", n_words int, kept string")
    got = without_repeats(docs, width=3, carry=["doc_id", "kept"]).collect()
    assert sorted((str(r.id), r.n_words, r.n_removed, r.kept) for r in got) == [
        ("1", 5, 5, ""), ("1", 5, 5, ""), ("2", 0, 0, None), ("None", 5, 5, ""),
    ]
