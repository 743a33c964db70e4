from partwatch.llm import suffixes

from . import brute

SCHEMA = "doc_id long, text string"


def test_covers_hold_every_difference():
    for v, cover in suffixes.COVERS.items():
        assert {(a - b) % v for a in cover for b in cover} == set(range(v))


def test_bytes(spark, small):
    docs = [r for r in small if len(r[1] or "") < 20_000][:150] + small[-30:]
    docs = list(dict(docs).items())
    for width in (200, 12):
        got = suffixes.without_repeats(spark.createDataFrame(docs, SCHEMA).repartition(4), width=width)
        got = {tuple(r) for r in got.drop("kept").collect()}
        assert got == set(brute.byte_dedup(docs, width))


def test_odd_tables(spark):
    assert suffixes.without_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, "b" * 500), (1, None), (1, ""), (2, "short")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", kept string")
    got = suffixes.without_repeats(docs).select("id", "n_bytes", "n_removed", "n_spans").collect()
    assert sorted(map(str, map(tuple, got))) == ["(1, 0, 0, 0)", "(1, 0, 0, 0)", "(2, 5, 0, 0)", "(None, 500, 500, 1)"]
