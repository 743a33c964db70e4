"""Periodic runs against the plain search for each period."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from partwatch.llm import tandems
from partwatch.llm.queries import QUERIES

from . import brute


def found(texts, **args):
    symbols, bounds = tandems._numbered([[w.encode() for w in t] for t in texts])
    start, end, period = tandems.runs_of(symbols, bounds, **args)
    row = np.searchsorted(bounds, start, side="right") - 1
    out = [[] for _ in texts]
    for r, s, e, q in zip(row, start, end, period, strict=True):
        out[r].append((s - bounds[r], e - s, q))
    return out


@given(st.lists(st.lists(st.sampled_from("ab"), max_size=40) | st.lists(st.sampled_from("abc"), max_size=60), max_size=5), st.sampled_from([2, 3, 4]))
@settings(max_examples=400, deadline=None)
def test_small_alphabets(texts, exponent):
    expected = [brute.word_runs(t, 6, exponent) for t in texts]
    assert found(texts, min_length=6, min_exponent=exponent) == expected


def test_structured_texts(monkeypatch):
    a, b = "a", "b"
    fibonacci = [[a], [a, b]]
    while len(fibonacci[-1]) < 900:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    nested = (([a] * 6 + [b]) * 5 + ["c"]) * 6
    unlike = [str(i) for i in range(500)]
    texts = [fibonacci[-1], nested, [a] * 700, unlike, [], unlike * 4, unlike * 3, [a, b] * 3, [a] * 5, [a] * 6]
    for exponent in (2, 4):
        assert found(texts, min_exponent=exponent) == [brute.word_runs(t, 6, exponent) for t in texts]
    whole = found(texts)
    monkeypatch.setattr(tandems, "STEP", 5)
    assert found(texts) == whole


def test_query(spark, small, tmp_path):
    docs = [*small[:150], *small[-27:], (None, "a " * 50), (None, None), (0, ""), (0, "x y " * 9), (0, "x y " * 9)]
    docs += [(1_000_000 + i, " ".join("abcdefg"[(i * j) % 7] for j in range(90 + i))) for i in range(200)]
    docs = [(d, t if len(t or "") < 40_000 else t[:9_000]) for d, t in docs]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op13_periodic_runs"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {t for n, t in got.dtypes if n not in ("runs_sha256", "collapsed_sha256")} == {"bigint"}
    key = str
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(brute.planted_runs(docs), key=key)


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert tandems.periodic_runs(empty).count() == 0
    rows = [(None, "a b " * 5 + "\n c", 1, "x"), (None, None, 2, "x"), (3, " \t", 3, None), (3, " \t", 3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int, _text string").withColumnRenamed("_text", "collapsed")
    out = tandems.periodic_runs(docs)
    assert out.columns == ["doc_id", "text", "n_words", "runs", "collapsed"]
    assert sorted((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in out.collect()) == [
        ("3", 0, [], ""), ("3", 0, [], ""), ("None", 0, [], ""), ("None", 11, [(0, 10, 2)], "a b c"),
    ]
    with pytest.raises(ValueError):
        tandems.periodic_runs(docs, min_exponent=1)
