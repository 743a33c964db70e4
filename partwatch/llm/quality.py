"""Quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import rolling
from .rolling import U64

BITS = 18
ORDERS = (1, 2)
SHARDS = 8
WORD = rolling.byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
SPACE = rolling.byte_class((0x00, 0x20))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words (runs of letters and digits) and of other single characters, and how many lie before each row."""
    n = len(data)
    if n == 0:
        return np.empty(0, U64), np.zeros(len(offsets), np.int64)
    word, space = WORD[data], SPACE[data]
    cuts = np.zeros(n + 1, bool)
    cuts[offsets] = True
    begins = ~space
    begins[1:] &= ~(word[1:] & word[:-1]) | cuts[1:n]
    ends = np.zeros(n + 1, bool)
    ends[1:n] = ~space[:-1] & (~(word[1:] & word[:-1]) | cuts[1:n])
    ends[n] = not space[-1]
    starts = np.flatnonzero(begins)
    return rolling.word_hashes(data, starts, np.flatnonzero(ends)), np.searchsorted(starts, offsets)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: distinct features with their values, and where each row begins.

    Values are the logs of counts, scaled to a unit vector, so that long and short texts weigh alike.
    """
    index, value, sizes = [], [], [0]
    for a, b in rolling.row_groups(offsets):
        hashes, bounds = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        rows, keys = [], []
        for order in ORDERS:
            within = rolling.inside_windows(bounds, order)
            row = np.searchsorted(bounds, np.flatnonzero(within), side="right") - 1
            rows.append(row)
            key = rolling.windows(hashes, order)
            if order == 2:  # a word that follows itself is one feature, whatever the word
                key = np.where(hashes[1:] == hashes[:-1], U64(0), key)
            keys.append(key[within] >> U64(64 - BITS))
        flat = (np.concatenate(rows) << BITS) | np.concatenate(keys).astype(np.int64)
        flat, count = np.unique(flat, return_counts=True)
        row, weight = flat >> BITS, 1 + np.log(count)
        norm = np.sqrt(np.bincount(row, weight * weight, minlength=b - a))
        index.append((flat & ((1 << BITS) - 1)).astype(np.int32))
        value.append((weight / norm[row]).astype(np.float32))
        sizes += np.bincount(row, minlength=b - a).tolist()
    if not index:
        return np.empty(0, np.int32), np.empty(0, np.float32), np.zeros(1, np.int64)
    return np.concatenate(index), np.concatenate(value), np.cumsum(sizes)


class Leader:
    """Per-coordinate FTRL-proximal state; the last place is the bias."""

    def __init__(self, alpha: float = 1.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z = self.z[at]
        small = np.abs(z) <= self.l1
        return np.where(small, 0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-float(np.clip(w @ x, -35, 35)))) - label) * x
        n = self.n[at]
        more = n + g * g
        self.z[at] += g - (np.sqrt(more) - np.sqrt(n)) / self.alpha * w
        self.n[at] = more


def train(examples: DataFrame, text_col: str = "text", label_col: str = "label", epochs: int = 3) -> np.ndarray:
    """Weights learned from a bounded table of texts and labels 0 or 1 (rows with a null in either are left out).

    Rows are dealt to ``SHARDS`` leaders by a hash of the text; each passes over its own rows ``epochs`` times in an order fixed by
    that hash, and the driver averages their weights, vectors of fixed size. No rows give weights 0, so every score is 0.5.
    """
    rows = examples.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{label_col}`").cast("int").alias("label"))
    rows = rows.where("text IS NOT NULL AND label IS NOT NULL").withColumn("key", F.xxhash64("text", "label"))
    rows = rows.withColumn("shard", F.pmod("key", F.lit(SHARDS)).cast("int"))

    def learn(table):
        table = table.take(pa.array(np.argsort(rolling.mix(table["key"].to_numpy().view(U64)), kind="stable")))
        index, value, bounds = features(*rolling.text_bytes(table["text"]))
        labels, leader = table["label"].to_numpy(), Leader()
        for _ in range(epochs):
            for row in range(len(labels)):
                at, x = index[bounds[row] : bounds[row + 1]], value[bounds[row] : bounds[row + 1]]
                leader.learn(np.append(at, 1 << BITS), np.append(x, 1.0), int(labels[row]))
        weights = leader.weights().astype("<f4").tobytes()
        return pa.table({"rows": pa.array([len(labels)], pa.int64()), "weights": pa.array([weights], pa.binary())})

    found = rows.groupBy("shard").applyInArrow(learn, "rows long, weights binary").collect()
    total = sum(r.rows for r in found)
    out = np.zeros((1 << BITS) + 1)
    for r in found:
        out += np.frombuffer(bytes(r.weights), "<f4") * (r.rows / total)
    return out.astype(np.float32)


def score(docs: DataFrame, weights: np.ndarray, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``score``, the probability of label 1 (a column of that name is replaced).

    A sparse dot product per whole text with the broadcast weights; a null or empty text gets the score of the bias alone.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != "score"])
    schema = T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType())])

    def apply(batches):
        for batch in batches:
            w = shared.value.astype(np.float64)
            index, value, bounds = features(*rolling.text_bytes(batch[text_col]))
            row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            margin = np.bincount(row, w[index] * value, minlength=len(bounds) - 1) + w[-1]
            added = pa.array(1 / (1 + np.exp(-np.clip(margin, -35, 35))), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, added], names=[*batch.schema.names, "score"])

    return kept.mapInArrow(apply, schema)


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", max_rows: int = 20_000) -> DataFrame:
    """Texts with labels, for ``train``: all, or about ``max_rows`` chosen by a hash of the id (the bound of what is learned from).

    Ids and labels that are null are left out; an id labelled twice counts once, with its greater label. The labels chosen are broadcast: their
    number is the bound.
    """
    chosen = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("label"))
    share = min(1.0, max_rows / max(1, chosen.count()))
    picked = chosen.where(F.pmod(F.xxhash64(id_col, F.lit("sample")), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    return docs.join(F.broadcast(picked), id_col)
