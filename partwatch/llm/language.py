"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import rolling
from .rolling import U64

UNDETERMINED = "und"
ORDERS = (1, 2, 3)
# The model has at most so many cells (languages x buckets), whatever the number of languages.
MAX_CELLS = 1 << 23
PART = 1 << 12
# Characters worked on at once.
PIECE = 1 << 19


@cache
def _letters() -> np.ndarray:
    """Per code point: the lower-case letter, or 0 for what is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if (s := chr(c)).isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def bucket_count(n_languages: int) -> int:
    """Buckets of n-grams: 65 536, or less where many languages would make the model too large."""
    return max(PART, min(1 << 16, 1 << ((MAX_CELLS // max(n_languages, 1)).bit_length() - 1)))


def grams(data: np.ndarray, offsets: np.ndarray, n_buckets: int):
    """Pieces of a batch of texts: (row of each n-gram, bucket of each n-gram), and the letters per row at the end.

    Runs of anything but letters count as one blank. Yields tuples; the last is (None, letters).
    """
    letters_of = np.zeros(len(offsets) - 1, np.int64)
    for a, b in rolling.row_groups(offsets):
        raw = data[offsets[a] : offsets[b]]
        codes = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))[offsets[a : b + 1] - offsets[a]]
        codes = _letters()[codes]
        row = np.repeat(np.arange(a, b), np.diff(ends))
        letters_of += np.bincount(row[codes > 0], minlength=len(letters_of))
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] > 0) | (codes[:-1] > 0) | (row[1:] != row[:-1])
        codes, row = codes[keep].astype(U64) + U64(1), row[keep]
        for at in range(0, len(codes), PIECE):
            for order in ORDERS:
                now = codes[at : at + PIECE + order - 1]
                n = len(now) - order + 1
                if n <= 0:
                    continue
                key = np.full(n, order, U64)
                for k in range(order):
                    key = key * U64(rolling.BASE) + now[k : k + n]
                one_row = row[at : at + n] == row[at + order - 1 : at + order - 1 + n]
                yield row[at : at + n][one_row], (rolling.mix(key)[one_row] % U64(n_buckets)).astype(np.int64)
    yield None, letters_of


class Model:
    """Languages in order, their log priors and log probabilities per bucket. Without languages nothing is determined."""

    def __init__(self, counts: dict[str, np.ndarray], rows: dict[str, int], n_buckets: int):
        self.languages, self.n_buckets = sorted(counts), n_buckets
        table = np.array([counts[x] for x in self.languages], np.float64).reshape(-1, n_buckets) + 0.5
        self.log_p = np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)
        number = np.array([rows.get(x, 0) for x in self.languages], np.float64) + 1
        self.prior = np.log(number / number.sum())

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        n = len(offsets) - 1
        total = np.tile(self.prior, (n, 1))
        letters = np.zeros(n, np.int64)
        for row, value in grams(data, offsets, self.n_buckets):
            if row is None:
                letters = value
            elif len(row):
                first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
                for k in range(len(self.languages)):
                    total[row[first], k] += np.add.reduceat(self.log_p[k][value], first, dtype=np.float64)
        if not self.languages:
            return [UNDETERMINED] * n, np.zeros(n)
        best = total.argmax(axis=1)
        score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        score[letters == 0] = 0
        return [self.languages[k] if some else UNDETERMINED for k, some in zip(best, letters, strict=True)], score


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from all rows whose text and language are not null.

    Each task counts its rows' n-grams per language and sends one packed vector per language and range of buckets; these are added up in Spark.
    The driver gets the summed vectors only: ``MAX_CELLS`` numbers at most. No rows give a model without languages.
    """
    rows = labelled.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    rows = rows.where("text IS NOT NULL AND lang IS NOT NULL")
    n_buckets = bucket_count(rows.agg(F.count_distinct("lang")).first()[0])

    def count(batches):
        counts, number = {}, {}
        for batch in batches:
            names = batch["lang"].to_pylist()
            data, offsets = rolling.text_bytes(batch["text"])
            known = {x: k for k, x in enumerate(dict.fromkeys(names))}
            of_row = np.array([known[x] for x in names], np.int64)
            found = np.zeros((len(known), n_buckets), np.int64)
            for row, value in grams(data, offsets, n_buckets):
                if row is not None:
                    flat = np.bincount(of_row[row] * n_buckets + value, minlength=found.size)
                    found += flat.reshape(found.shape)
            for name, k in known.items():
                counts[name] = counts.get(name, 0) + found[k]
                number[name] = number.get(name, 0) + int((of_row == k).sum())
        for name, vector in counts.items():
            parts = vector.reshape(-1, PART).astype("<i8")
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": [name] * len(parts),
                    "part": pa.array(range(len(parts)), pa.int32()),
                    "rows": pa.array([number[name] if k == 0 else 0 for k in range(len(parts))], pa.int64()),
                    "counts": pa.array([p.tobytes() for p in parts], pa.binary()),
                }
            )

    def add(table):
        total = np.zeros(PART, np.int64)
        for data in table["counts"]:
            total += np.frombuffer(data.as_buffer(), "<i8")
        number = int(np.sum(table["rows"].to_numpy()))
        return pa.table({"lang": table["lang"][:1], "part": table["part"][:1], "rows": pa.array([number], pa.int64()), "counts": pa.array([total.tobytes()], pa.binary())})

    schema = "lang string, part int, rows long, counts binary"
    sums = rows.mapInArrow(count, schema).groupBy("lang", "part").applyInArrow(add, schema).collect()
    parts: dict[str, dict[int, np.ndarray]] = {}
    for r in sums:
        parts.setdefault(r.lang, {})[r.part] = np.frombuffer(bytes(r.counts), "<i8")
    vectors = {lang: np.concatenate([own[k] for k in sorted(own)]) for lang, own in parts.items()}
    return Model(vectors, {r.lang: r.rows for r in sums if r.part == 0}, n_buckets)


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``lang_pred`` and ``score``, the posterior of that language (columns of these names are replaced).

    ``und`` with score 0 where the text is null, empty or without a letter, or the model knows no language. Equal posteriors
    go to the language first in order. Whole texts are read; rows are independent; the model is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")])
    schema = T.StructType(kept.schema.fields + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def predict(batches):
        for batch in batches:
            names, scores = shared.value.predict(*rolling.text_bytes(batch[text_col]))
            added = [pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "lang_pred", "score"])

    return kept.mapInArrow(predict, schema)
