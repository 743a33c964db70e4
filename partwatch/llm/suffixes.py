"""Suffix-array dedup of bytes: blockwise suffix sorting with a difference cover.

Only the order of suffixes down to depth ``width`` matters, and of that order only which suffixes are equal, so a suffix is
represented by the hash of its first bytes and a bucket is sorted by hashes. No task ever holds more than one bucket.

1. *Cover sample.* In each text the positions whose offset modulo ``v`` lies in a difference cover are sampled. For any two
   offsets some shift below ``v`` puts both into the cover, so equal strings of ``width`` bytes share, at one such shift,
   equal sampled strings of ``width - v + 1`` bytes. The sampled suffixes are sorted bucket by bucket to this depth; those
   alone in their rank prove that the up to ``v`` suffixes before them are alone, too.
2. *Long ties.* Sampled suffixes that tie are ranked again, now with the ``v - 1`` bytes before and ``v - 1`` bytes behind them.
   A sample that still ties resolves all ``v`` suffixes that lead to it at once: they are repeated.
3. *Suffix buckets.* Only around samples whose rank holds one that does not tie that far (the borders of what is common)
   the suffixes themselves are dealt to buckets and sorted, one bucket at a time, to depth ``width``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import exchange, rolling
from .rolling import U64

# Perfect difference sets, each with its modulus.
COVERS = {
    7: (0, 1, 3),
    13: (0, 1, 3, 9),
    31: (0, 1, 3, 8, 12, 18),
    57: (0, 1, 3, 13, 32, 36, 43, 52),
    133: (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109),
}


def cover_for(width: int) -> tuple[int, tuple[int, ...]]:
    """The largest cover that leaves sampled strings at least a third of the width long."""
    modulus = max(v for v in COVERS if 3 * v <= 2 * width + 1)
    return modulus, COVERS[modulus]


def pieces(offsets: np.ndarray, overlap: int, size: int = rolling.CHUNK) -> Iterator[tuple[int, int]]:
    """Byte ranges of about ``size`` new bytes, each reaching ``overlap`` bytes into the next."""
    end, at = int(offsets[-1]), 0
    while at < end:
        yield at, min(at + size + overlap, end)
        at += size


def hashes_at(data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` bytes from each of the ascending positions."""
    out, first = np.empty(len(at), U64), 0
    while first < len(at):
        low = at[first]
        last = max(first + 1, int(np.searchsorted(at, low + rolling.CHUNK, side="right")))
        high = at[last - 1] + width
        sums = rolling.prefix_sums(rolling.BYTE_VALUES[data[low:high]])
        start = at[first:last] - low
        out[first:last] = rolling.span_hashes(sums, start, start + width)
        first = last
    return out


class Block:
    """Texts of one block as bytes, with the samples that matter at a width."""

    def __init__(self, table: pa.Table, width: int):
        self.width = width
        self.v, cover = cover_for(width)
        self.depth = width - self.v + 1
        self.table = exchange.ordered(table)
        self.data, self.offsets = rolling.text_bytes(self.table["_text"])
        inside = np.zeros(self.v, bool)
        inside[list(cover)] = True
        spans = [
            low + np.flatnonzero(np.resize(inside, max(0, high - low - self.depth + 1)))
            for low, high in zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist(), strict=True)
            if high - low >= width
        ]
        self.samples = np.concatenate(spans).astype(np.int64) if spans else np.empty(0, np.int64)
        row = np.searchsorted(self.offsets, self.samples, side="right")
        self.low, self.high = self.offsets[row - 1], self.offsets[row]

    def names(self) -> np.ndarray:
        return hashes_at(self.data, self.samples, self.depth)

    def tied(self, replies: pa.Table, n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Samples that share their rank, their names, and the hash of their wide context (0: it leaves the text)."""
        names = self.names()
        keep = exchange.codes_of(names, replies, n_buckets, 1) > 0
        at, names = self.samples[keep], names[keep]
        wide = np.zeros(len(at), U64)
        whole = (at - self.v + 1 >= self.low[keep]) & (at + self.width <= self.high[keep])
        wide[whole] = hashes_at(self.data, at[whole] - self.v + 1, self.width + self.v - 1) | U64(1)
        return keep, names, wide

    def leading(self, keep: np.ndarray) -> np.ndarray:
        """Which positions start one of the suffixes that lead to the samples kept, and have ``width`` bytes left."""
        change = np.zeros(len(self.data) + 1, np.int32)
        at, low, high = self.samples[keep], self.low[keep], self.high[keep]
        first, last = np.maximum(at - self.v + 1, low), np.minimum(at, high - self.width) + 1
        good = last > first
        np.add.at(change, first[good], 1)
        np.add.at(change, last[good], -1)
        return np.cumsum(change[:-1]) > 0


def _pairs(names: np.ndarray, wide: np.ndarray):
    """Distinct (name, context) pairs, sorted, with their number up to 255, and the pair of each sample."""
    order = np.lexsort((wide, names))
    a, b = names[order], wide[order]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    inverse = np.empty(len(a), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return a[first], b[first], np.minimum(np.diff(first, append=len(a)), 255).astype(np.uint8), inverse


SETTLED, SORT = 1, 2


def _tie_codes(names: np.ndarray, wide: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Per pair: SETTLED if its wide context repeats; SORT if its rank holds one whose context does not."""
    order = np.lexsort((wide, names))
    a, b = names[order], wide[order]
    rank_starts = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
    pair_starts = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
    total = np.add.reduceat(weights[order].astype(np.int64), pair_starts)
    settled = np.repeat(total > 1, np.diff(pair_starts, append=len(a))) & (b != 0)
    open_rank = np.repeat(np.logical_or.reduceat(~settled, rank_starts), np.diff(rank_starts, append=len(a)))
    out = np.empty(len(a), np.uint8)
    out[order] = settled * SETTLED + open_rank * SORT
    return out


def without_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 200,
    n_blocks: int | None = None,
    n_buckets: int | None = None,
) -> DataFrame:
    """Remove every byte covered by a string of ``width`` bytes that also starts anywhere else.

    Texts are taken as UTF-8 bytes; matches never cross texts, may overlap themselves, and are judged on the input. ``width``
    is at least 10. Returns ``id``, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs), ``kept`` (binary: a cut may
    fall inside a character) and ``kept_sha256``. A null text has no bytes; rows repeated whole, or sharing an id, count as
    rows of their own; an empty table gives no rows; other columns are ignored.
    """
    n_buckets = exchange.bucket_number(docs, n_buckets)
    id_type = docs.schema[id_col].dataType
    blocks = exchange.in_blocks(docs, id_col, text_col, (), n_blocks)
    by_block = blocks.groupBy("_block")

    def sample_keys(table):
        return exchange.distinct(Block(table, width).names())

    def send_ties(table, replies):
        block = Block(table, width)
        _, names, wide = block.tied(replies, n_buckets)
        a, b, weights, _ = _pairs(names, wide)
        edges = np.searchsorted(exchange.bucket_of(a, n_buckets), np.arange(n_buckets + 1, dtype=U64))
        rows = [
            (bucket, table["_block"][0].as_py(), int(j - i), exchange.pack(a[i:j]) + b[i:j].tobytes(), weights[i:j].tobytes())
            for bucket, (i, j) in enumerate(zip(edges[:-1], edges[1:], strict=True))
            if j > i
        ]
        return pa.Table.from_pylist([dict(zip(exchange.MESSAGE_ARROW.names, r, strict=True)) for r in rows], exchange.MESSAGE_ARROW)

    def rank_ties(table):
        sizes = table["_n"].to_numpy().astype(np.int64)
        starts = np.concatenate(([0], np.cumsum(sizes)))
        blobs, weights = table["_keys"].to_pylist(), table["_weights"].to_pylist()
        names = np.concatenate([exchange.unpack(d[: 8 * n], n) for d, n in zip(blobs, sizes.tolist(), strict=True)])
        wide = np.concatenate([np.frombuffer(d[8 * n :], U64) for d, n in zip(blobs, sizes.tolist(), strict=True)])
        codes = _tie_codes(names, wide, np.frombuffer(b"".join(weights), np.uint8))
        return exchange.answers(table, codes, starts, 2, False)

    def tie_codes(block, replies):
        """Samples that are settled, and samples around which suffixes are sorted."""
        keep, names, wide = block.tied(replies, n_buckets)
        a, _, _, inverse = _pairs(names, wide)
        edges = np.searchsorted(exchange.bucket_of(a, n_buckets), np.arange(n_buckets + 1, dtype=U64))
        codes = exchange.replied(replies, np.diff(edges), 2, False)
        of_sample = np.zeros(len(keep), np.uint8)
        of_sample[keep] = codes[inverse] if len(codes) else 0
        return block.leading(of_sample & SETTLED > 0), np.flatnonzero(block.leading(of_sample & SORT > 0))

    def send_suffixes(table, replies):
        number = table["_block"][0].as_py()
        block = Block(table, width)
        _, at = tie_codes(block, replies)
        keys = exchange.distinct(hashes_at(block.data, at, width))
        return pa.Table.from_batches(list(exchange.messages(number, keys, n_buckets)), exchange.MESSAGE_ARROW)

    schema = T.StructType(
        [T.StructField("id", id_type)]
        + [T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")]
        + [T.StructField("kept", T.BinaryType()), T.StructField("kept_sha256", T.StringType())]
    )

    def remove(table, replies):
        block = Block(table, width)
        starts, at = tie_codes(block, replies)
        codes = exchange.codes_of(hashes_at(block.data, at, width), replies, n_buckets, 3)
        starts[at[codes > 0]] = True
        gone = rolling.spread(starts, width, len(block.data))
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        first = block.offsets[:-1][block.offsets[:-1] < len(gone)]
        opens[first] = gone[first]
        removed = np.concatenate(([0], np.cumsum(gone)))[block.offsets]
        spans = np.concatenate(([0], np.cumsum(opens)))[block.offsets]
        left = block.data[~gone].tobytes()
        cuts = block.offsets - removed
        kept = [left[i:j] for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        digests = [hashlib.sha256(k).hexdigest() for k in kept]
        columns = [block.table["_id"], np.diff(block.offsets), np.diff(removed), np.diff(spans), pa.array(kept, pa.binary()), pa.array(digests, pa.string())]
        return pa.table(columns, names=schema.names)

    # Later rounds read the replies of earlier ones. Dealt out once, they are reused and not counted again.
    sampled = exchange.repeated(exchange.send(blocks, sample_keys, n_buckets), 1).repartition("_block")
    ties = by_block.cogroup(sampled.groupBy("_block")).applyInArrow(send_ties, exchange.MESSAGE)
    ranked = sampled.unionAll(ties.groupBy("_bucket").applyInArrow(rank_ties, exchange.REPLY).repartition("_block"))
    suffixes = by_block.cogroup(ranked.groupBy("_block")).applyInArrow(send_suffixes, exchange.MESSAGE)
    sorted_ = ranked.unionAll(exchange.repeated(suffixes, 3))
    return by_block.cogroup(sorted_.groupBy("_block")).applyInArrow(remove, schema)
