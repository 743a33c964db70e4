"""Counting of very many keys with few, packed rows.

Documents are dealt to blocks by a hash of the row. A block sends each of its distinct keys once, sorted and packed into
one row per key range (bucket). A bucket counts its keys over all blocks and answers with one small code per key, in the
order sent. The block computes its keys again (they follow from its texts alone) and reads the codes. So a key costs its
packed bytes once, hot keys cost one entry per block, and a lost executor only repeats blocks or buckets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .rolling import U64

MESSAGE = "_bucket int, _block int, _n int, _keys binary, _weights binary"
REPLY = "_block int, _bucket int, _round int, _codes binary"
MESSAGE_ARROW = pa.schema([("_bucket", pa.int32()), ("_block", pa.int32()), ("_n", pa.int32()), ("_keys", pa.binary()), ("_weights", pa.binary())])
REPLY_ARROW = pa.schema([("_block", pa.int32()), ("_bucket", pa.int32()), ("_round", pa.int32()), ("_codes", pa.binary())])
Keys = tuple[np.ndarray, np.ndarray]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucket_number(docs: DataFrame, n_buckets: int | None) -> int:
    """Buckets unless told: one per shuffle partition. There is a row per block and bucket, so both stay near that number."""
    return n_buckets or partitions(docs.sparkSession)


def in_blocks(docs: DataFrame, id_col: str, text_col: str, carry: Sequence[str] = (), n_blocks: int | None = None) -> DataFrame:
    """Rows with their block, and a key by which every task puts a block's rows in one order.

    Columns: ``_block``, ``_key``, ``_id``, ``_text`` and the carried ones under ``_c0``, ``_c1``, ...
    """
    n = n_blocks or 2 * partitions(docs.sparkSession)
    key = F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    return docs.select(
        F.pmod(key, F.lit(n)).cast("int").alias("_block"),
        key.alias("_key"),
        F.col(f"`{id_col}`").alias("_id"),
        F.col(f"`{text_col}`").cast("string").alias("_text"),
        *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(carry)],
    )


def ordered(table: pa.Table) -> pa.Table:
    """A block's rows in the order of their key; rows with equal keys are alike."""
    return table.take(pa.array(np.argsort(table["_key"].to_numpy(), kind="stable")))


def pack(keys: np.ndarray) -> bytes:
    """Sorted keys as byte planes of their differences: the high planes are zeros, which the shuffle compresses away."""
    steps = np.diff(keys, prepend=U64(0))
    return steps.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=U64)


def distinct(keys: np.ndarray) -> Keys:
    """Sorted distinct keys and how often each occurs, up to 255."""
    if not len(keys):
        return keys, np.empty(0, np.uint8)
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.minimum(np.diff(first, append=len(keys)), 255).astype(np.uint8)


def bucket_of(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    """Ranges of equal width, so that sorted keys are sorted by bucket."""
    return ((keys >> U64(32)) * U64(n_buckets)) >> U64(32)


def messages(block: int, keys: Keys, n_buckets: int) -> Iterator[pa.RecordBatch]:
    values, weights = keys
    edges = np.searchsorted(bucket_of(values, n_buckets), np.arange(n_buckets + 1, dtype=U64))
    rows = [
        (b, block, int(j - i), pack(values[i:j]), weights[i:j].tobytes())
        for b, (i, j) in enumerate(zip(edges[:-1], edges[1:], strict=True))
        if j > i
    ]
    for at in range(0, len(rows), 256):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 256], strict=True), MESSAGE_ARROW.types, strict=True)], schema=MESSAGE_ARROW)


def together(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys and weights of all messages of a bucket, and where each message starts."""
    sizes = table["_n"].to_numpy().astype(np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    keys, weights = np.empty(starts[-1], U64), np.empty(starts[-1], np.uint8)
    at = 0
    for batch in table.to_batches():
        for data, weight, n in zip(batch["_keys"], batch["_weights"], batch["_n"].to_numpy(), strict=True):
            keys[starts[at] : starts[at + 1]] = unpack(data.as_buffer(), int(n))
            weights[starts[at] : starts[at + 1]] = np.frombuffer(weight.as_buffer(), np.uint8)
            at += 1
    return keys, weights, starts


def counted(keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each key, the sum of the weights of all equal keys."""
    order = np.argsort(keys)
    ranked = keys[order]
    first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    sums = np.add.reduceat(weights[order].astype(np.int64), first)
    out = np.empty(len(keys), np.int64)
    out[order] = np.repeat(sums, np.diff(first, append=len(keys)))
    return out


def answers(table: pa.Table, codes: np.ndarray, starts: np.ndarray, round_: int, bits: bool) -> pa.Table:
    """One reply per message; with ``bits`` the codes are 0 or 1."""
    blocks, bucket = table["_block"].to_numpy(), table["_bucket"].to_numpy()
    parts = [codes[i:j] for i, j in zip(starts[:-1], starts[1:], strict=True)]
    data = [np.packbits(p).tobytes() if bits else p.astype(np.uint8).tobytes() for p in parts]
    return pa.table([pa.array(blocks, pa.int32()), pa.array(bucket, pa.int32()), pa.array([round_] * len(data), pa.int32()), pa.array(data, pa.binary())], schema=REPLY_ARROW)


def repeated(sent: DataFrame, round_: int = 0) -> DataFrame:
    """Replies with a bit per key: whether the key occurs more than once over all blocks."""

    def answer(table):
        keys, weights, starts = together(table)
        return answers(table, counted(keys, weights) > 1, starts, round_, True)

    return sent.groupBy("_bucket").applyInArrow(answer, REPLY)


def replied(table: pa.Table, sizes: np.ndarray, round_: int, bits: bool) -> np.ndarray:
    """Codes of a block's sorted distinct keys: its replies of one round, by bucket. ``sizes`` are the keys per bucket."""
    out = []
    rows = sorted(
        (r["_bucket"], r["_codes"]) for r in table.select(["_bucket", "_round", "_codes"]).to_pylist() if r["_round"] == round_
    )
    for bucket, codes in rows:
        codes = np.frombuffer(codes, np.uint8)
        out.append(np.unpackbits(codes, count=int(sizes[bucket])) if bits else codes)
    return np.concatenate(out) if out else np.empty(0, np.uint8)


def codes_of(keys: np.ndarray, table: pa.Table, n_buckets: int, round_: int = 0, bits: bool = True) -> np.ndarray:
    """The code of each of a block's keys, in the keys' own order."""
    if not len(keys):
        return np.empty(0, np.uint8)
    order = np.argsort(keys)
    ranked = keys[order]
    new = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    edges = np.searchsorted(bucket_of(ranked[new], n_buckets), np.arange(n_buckets + 1, dtype=U64))
    codes = replied(table, np.diff(edges), round_, bits)
    out = np.empty(len(keys), np.uint8)
    out[order] = codes[np.cumsum(new) - 1]
    return out


def send(blocks: DataFrame, keys_of: Callable[[pa.Table], Keys], n_buckets: int) -> DataFrame:
    def send_block(table):
        block = table["_block"][0].as_py()
        return pa.Table.from_batches(list(messages(block, keys_of(ordered(table)), n_buckets)), MESSAGE_ARROW)

    return blocks.groupBy("_block").applyInArrow(send_block, MESSAGE)
