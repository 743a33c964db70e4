import numpy as np
import pytest
from pyspark.sql import functions as F

from partwatch.llm import pieces as sp
from partwatch.llm.queries import PIECE_MODEL

MODEL = sp.Pieces(PIECE_MODEL)
MACHINE = sp.Automaton(MODEL)


def best_score(text: str) -> float:
    """Plain dynamic programme over the dictionary."""
    data = (" " + text).encode()
    scores = {}
    for t, s in zip(MODEL.texts, MODEL.scores, strict=True):
        scores[t] = max(s, scores.get(t, -np.inf))
    low = min(MODEL.scores) - 10
    longest = max(map(len, scores))
    best = [0.0] + [-np.inf] * len(data)
    starts = [i for i in range(len(data)) if data[i] & 0xC0 != 0x80] + [len(data)]
    for i, j in zip(starts, starts[1:], strict=False):
        best[j] = max(best[j], best[i] + low)
        for k in starts:
            if i < k <= i + longest and data[i:k] in scores:
                best[k] = max(best[k], best[i] + scores[data[i:k]])
    return best[-1]


def score_of(ids: list[int], text: str) -> float:
    by_id, of_byte = dict(zip(MODEL.ids, MODEL.scores, strict=True)), set(MODEL.byte_ids)
    characters = sum(1 for c in text if c not in KNOWN)
    return sum(by_id[i] for i in ids if i not in of_byte) + characters * (min(MODEL.scores) - 10)


KNOWN = {t.decode() for t in MODEL.texts if len(t.decode()) == 1}
TEXTS = [
    "Hello  world, été\n\tfoo", "a", " ", "   x", "\n\n", "emoji \U0001f600\U0001f9ff end", "literal ▁ mark", "tzkeit ölichau loweient", "x" * 300, "日本語 と中文", "\x00\x7f", "end ",
]


def test_scores_are_best(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "n int, text string")
    for r in sp.encode(rows, MODEL).collect():
        assert score_of(r.ids, r.text) == pytest.approx(best_score(r.text), rel=1e-12), r.text


def test_round_trip(spark, small):
    rows = [*small, *((10_000 + i, t) for i, t in enumerate(TEXTS))]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, decoded string").repartition(3)
    out = sp.decode(sp.encode(frame, MODEL, exact_col="exact"), MODEL)
    assert out.where("NOT exact OR exact IS NULL AND text IS NOT NULL").count() == 0
    assert out.where(~F.col("decoded").eqNullSafe(F.col("text"))).count() == 0
    assert out.where("text IS NULL AND ids IS NULL").count() == 1 and out.where("text = '' AND size(ids) = 0").count() == 1
    assert sp.encode(frame.where("false"), MODEL).count() == 0


def test_library_reads_the_ids(spark):
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=PIECE_MODEL)
    rows = spark.createDataFrame([(t,) for t in TEXTS if "▁" not in t and "\x00" not in t], "text string")
    for r in sp.encode(rows, MODEL).collect():
        assert model.decode(r.ids) == r.text
