"""Spelling variants against the comparison of all pairs of words."""

import random

import pytest

from partwatch.llm import spelling
from partwatch.llm.queries import QUERIES

from . import brute

WORDS = "word string, n long"
COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def groups(spark, words, **args):
    return sorted((tuple(r) for r in spelling.spelling_groups(spark.createDataFrame(words, WORDS), **args).select(*COLUMNS).collect()), key=str)


def made_up(seed, size=400):
    """Random words, edits of them, edits of those, and words of repeated letters."""
    draw, letters = random.Random(seed), "abcdeé×zß"
    out = {"".join(draw.choices(letters, k=draw.randint(1, 9))): draw.randint(1, 9) for _ in range(size)}
    for w in list(out)[: size // 2]:
        for power in (1, 2):
            i = draw.randrange(len(w) + 1)
            w = draw.choice([w[:i] + w[i + 1 :], w[:i] + draw.choice(letters) + w[i:], w[:i] + draw.choice(letters) + w[i + 1 :]])
            out[w] = draw.randint(1, 3) * 10 ** (3 * power)
    for n in (1, 2, 30, 63, 64, 65, 66, 300, 301):
        out["a" * n] = n
        out["ab" * n] = 40 * n
        out["ab" * n + "é"] = 2
    return out


@pytest.mark.parametrize("n_symbols", [None, 2, 5])
def test_all_pairs(spark, n_symbols):
    words = made_up(n_symbols or 1)
    assert groups(spark, list(words.items()), n_symbols=n_symbols) == sorted(brute.spelling_groups(words), key=str)


def test_long_words_in_parts(spark, monkeypatch):
    base = "".join(random.Random(3).choices("abcdefgh", k=20_000))
    words = {base: 50, base[:7_000] + base[7_001:]: 5, base + "x": 4, "y" + base: 3, base[:19_999] + "q" + "y": 2}
    assert groups(spark, list(words.items())) == sorted(brute.spelling_groups(words), key=str)


def test_ties_and_chains(spark):
    words = {"kangaroo": 5_000, "kangaro": 300, "kangar": 2, "wallaby": 2, "wallabies": 40, "wallabz": 20, "wallabx": 20}
    got = {r[0]: r for r in groups(spark, list(words.items()))}
    assert got["kangar"] == ("kangar", "kangaro", "kangaroo", 2, 1, 300)
    assert got["wallaby"] == ("wallaby", "wallabx", "wallabx", 2, 2, 20)
    assert got["wallabies"] == ("wallabies", None, "wallabies", 40, 0, None)


def test_odd_tables(spark):
    assert groups(spark, []) == []
    assert groups(spark, [(None, 3), ("", 1), ("a", 10)]) == [("", "a", "a", 1, 1, 10), ("a", None, "a", 10, 1, None)]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.letter_runs(empty).count() == 0
    rows = [(None, "Ab,c Éa", "x"), (1, "Ab", "y"), (1, "Ab", "y"), (2, None, None), (3, "", None)]
    got = spelling.letter_runs(spark.createDataFrame(rows, "doc_id long, text string, run string")).collect()
    assert sorted(map(tuple, got)) == [("", "ab"), ("", "c"), ("", "Éa"), ("1", "ab"), ("1", "ab")]


def test_query(spark, small, tmp_path):
    docs = [*small[:120], (None, small[0][1]), (None, "Déconstruction déconstruction " * 30), *small[-30:]]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op11_spelling_variants"](spark, str(tmp_path))
    assert got.columns == list(COLUMNS)
    assert {tuple(r) for r in got.collect()} == set(brute.spelling_groups(brute.spelled_words(docs)))
