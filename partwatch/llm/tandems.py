"""Periodic runs of words, by the branching-tandem test on enhanced suffix arrays.

The texts of a group of rows share arrays, but a word of one row is another symbol than the same word of the next, so every match
lies within one row and the rows' suffix arrays stand one after the other. Prefix doubling sorts the suffixes and leaves, per
level, the ranks of all blocks of 2, 4, 8, ... words. For each interval of the LCP array, of depth d, the suffixes i of all
children but the largest are tested: if i + d or i - d is in the interval too, but in another child, there is a square of
period d whose next word breaks it. Rotating it to the left gives all squares before it, and all of them are one run. No tree
is built; previous and next smaller values stand for it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import rolling

# Suffixes of smaller children tested at once.
STEP = 1 << 20
RUNS = T.ArrayType(
    T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("period", T.LongType())])
)
RUN_ARROW = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


@dataclass
class SuffixArray:
    """Suffixes in order, their ranks, the ranks by the first 2**k symbols for each k, and the LCP with the suffix before."""

    order: np.ndarray
    rank: np.ndarray
    levels: list[np.ndarray]
    lcp: np.ndarray


def suffix_array(symbols: np.ndarray, ends: np.ndarray) -> SuffixArray:
    """``ends`` is the end of the row of each place. Only suffixes that are still tied are sorted again."""
    n = len(symbols)
    tied = np.argsort(symbols, kind="stable")
    first = _firsts(symbols[tied])
    # The rank of a suffix is the place of the first one that it is tied with; one more place ends every row.
    rank = np.full(n + 1, -1, np.int32)
    rank[tied] = first
    levels, width = [rank], 1
    tied = tied[_tied(first)]
    while len(tied):
        own, after = rank[tied].astype(np.int64), tied + width
        keys = own * (n + 1) + np.where(after < ends[tied], rank[np.minimum(after, n)] + 1, 0)
        by = np.argsort(keys, kind="stable")
        tied, keys, own = tied[by], keys[by], own[by]
        group, part = _firsts(own), _firsts(keys)
        rank = rank.copy()
        rank[tied] = own + part - group
        levels.append(rank)
        tied = tied[_tied(part)]
        width *= 2
    order = np.empty(n, np.int64)
    order[rank[:n]] = np.arange(n)
    return SuffixArray(order, rank, levels, _lcp(order, levels))


def _firsts(values: np.ndarray) -> np.ndarray:
    """For sorted values, the place of the first equal one."""
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(values)), 0))


def _tied(first: np.ndarray) -> np.ndarray:
    """Which places share their first one with another."""
    return np.bincount(first, minlength=len(first))[first] > 1


def _lcp(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Common symbols of neighbours in the order, block by block from the largest; 0 at both ends."""
    n = len(order)
    lcp = np.zeros(n + 1, np.int64)
    a, b = order[:-1], order[1:]
    same = np.flatnonzero(levels[0][a] == levels[0][b])
    a, b = a[same].copy(), b[same].copy()
    start = b.copy()
    for k in range(len(levels) - 1, -1, -1):
        step = (levels[k][a] == levels[k][b]).astype(np.int64) << k
        a += step
        b += step
    lcp[same + 1] = b - start
    return lcp


def _smaller(lcp: np.ndarray, step: int, or_equal: bool) -> np.ndarray:
    """The nearest place before (``step`` -1) or after (1) with a smaller value, for values above 0, by doubled pointers."""
    stop = np.less_equal if or_equal else np.less
    near = np.arange(len(lcp)) + step
    open_ = np.flatnonzero(lcp > 0)
    while len(open_):
        open_ = open_[~stop(lcp[near[open_]], lcp[open_])]
        near[open_] = near[near[open_]]
    return near


def _small_children(lcp: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, ...]:
    """Depth, interval (first and last rank) and child (likewise) of all children but the largest of each allowed interval."""
    at = np.flatnonzero(allowed)
    left, right = _smaller(lcp, -1, False)[at], _smaller(lcp, 1, False)[at]
    opens = _smaller(lcp, -1, True)[at] == left
    first = np.concatenate((at, left[opens]))
    last = np.concatenate((_smaller(lcp, 1, True)[at], at[opens])) - 1
    depth = np.concatenate((lcp[at], lcp[at[opens]]))
    low, high = np.concatenate((left, left[opens])), np.concatenate((right, right[opens])) - 1
    interval = low * len(lcp) + high
    by = np.lexsort((first - last, interval))
    small = by[_firsts(interval[by]) != np.arange(len(by))]
    return depth[small], low[small], high[small], first[small], last[small]


def _branching(array: SuffixArray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends and periods of all branching squares."""
    n = len(array.order)
    depth, low, high, first, last = _small_children(array.lcp, allowed)
    sizes = last - first + 1
    upto = np.cumsum(sizes)
    ends, periods, done = [], [], 0
    while done < len(sizes):
        stop = max(done + 1, int(np.searchsorted(upto, (upto[done - 1] if done else 0) + STEP, side="right")))
        size = sizes[done:stop]
        child = np.repeat(np.arange(done, stop), size)
        within = np.arange(len(child)) - np.repeat(np.cumsum(size) - size, size)
        suffix, d = array.order[first[child] + within], depth[child]
        for other, end in ((suffix + d, suffix + 2 * d), (suffix - d, suffix + d)):
            rank = np.where((other >= 0) & (other < n), array.rank[np.clip(other, 0, n - 1)], -1)
            good = (rank >= low[child]) & (rank <= high[child]) & ((rank < first[child]) | (rank > last[child]))
            ends.append(end[good])
            periods.append(d[good])
        done = stop
    return (np.concatenate(ends), np.concatenate(periods)) if ends else (np.empty(0, np.int64), np.empty(0, np.int64))


def runs_of(symbols: np.ndarray, bounds: np.ndarray, min_length: int = 6, min_exponent: int = 4) -> tuple[np.ndarray, ...]:
    """Start, end and smallest period of every run, in order of start and period.

    ``symbols`` are the words of all rows as numbers, no number in two rows and none smaller than one of the row before;
    ``bounds`` are the rows' first places and the end.
    """
    n = len(symbols)
    if n == 0:
        return (np.empty(0, np.int64),) * 3
    lengths = np.diff(bounds)
    array = suffix_array(symbols, np.repeat(bounds[1:], lengths))
    # Deeper intervals cannot hold a square that is part of a run long enough.
    most = np.repeat(lengths, lengths)[array.order] // min_exponent
    allowed = (array.lcp > 0) & (array.lcp <= np.append(most, 0))
    end, period = _branching(array, allowed)
    start = end - 2 * period
    for k in range(len(array.levels) - 1, -1, -1):
        before = start - (1 << k)
        level = array.levels[k]
        same = (before >= 0) & (level[np.maximum(before, 0)] == level[np.maximum(before, 0) + period])
        start = np.where(same, before, start)
    by = np.lexsort((period, end, start))
    start, end, period = start[by], end[by], period[by]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    good = new & (end - start >= np.maximum(min_length, min_exponent * period))
    start, end, period = start[good], end[good], period[good]
    by = np.lexsort((period, start))
    return start[by], end[by], period[by]


def _numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Words as numbers that follow the rows, and the rows' first words and the end."""
    numbers, seen = [], 0
    for words in texts:
        known: dict[bytes, int] = {}
        numbers += [known.setdefault(w, seen + len(known)) for w in words]
        seen += len(known)
    bounds = np.concatenate(([0], np.cumsum([len(words) for words in texts], dtype=np.int64)))
    return np.array(numbers, np.int64), bounds


def _judged(rows: pa.RecordBatch, text_at: int, min_length: int, min_exponent: int) -> list[pa.Array]:
    """The result columns of a group of rows."""
    texts = [(t or "").encode().split() for t in rows.column(text_at).to_pylist()]
    symbols, bounds = _numbered(texts)
    start, end, period = runs_of(symbols, bounds, min_length, min_exponent)
    gone = np.zeros(len(symbols) + 1, np.int64)
    np.add.at(gone, start + period, 1)
    np.add.at(gone, end, -1)
    kept = np.cumsum(gone[:-1]) == 0
    row = np.searchsorted(bounds, start, side="right") - 1
    edges = np.searchsorted(row, np.arange(len(texts) + 1))
    values = pa.StructArray.from_arrays([pa.array(start - bounds[row]), pa.array(end - start), pa.array(period)], fields=list(RUN_ARROW))
    collapsed = []
    for i, words in enumerate(texts):
        if edges[i] != edges[i + 1]:
            words = [w for w, k in zip(words, kept[bounds[i] : bounds[i + 1]].tolist(), strict=True) if k]
        collapsed.append(b" ".join(words).decode())
    return [pa.array(np.diff(bounds)), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), values), pa.array(collapsed, pa.string())]


def periodic_runs(docs: DataFrame, text_col: str = "text", min_length: int = 6, min_exponent: int = 4) -> DataFrame:
    """``docs`` with the periodic runs of each whole text and the text without their repeats; one narrow pass.

    Words are runs of other than ASCII white space. A run is a stretch of words with smallest period q (words q apart are equal)
    of at least ``min_length`` words and ``min_exponent`` (2 or more) periods that no neighbouring word extends.

    Adds ``n_words``, ``runs`` (start and length in words, period; by start, then period) and ``collapsed``, the words that no
    run contains after its first q words, joined by one space; columns of these names are replaced. Null and empty texts have no
    words, no runs and an empty ``collapsed``. Rows are judged alone, so repeated rows and ids and null ids make no difference; an
    empty table gives no rows. Memory is bounded by a group of rows of about 1 MB, or by one longer text (4 bytes a word and
    doubling of its longest repeat, and some vectors).
    """
    if min_exponent < 2:
        raise ValueError("a run has at least two periods")
    added = [T.StructField("n_words", T.LongType()), T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())]
    names = [f.name for f in added]
    kept = [f for f in docs.schema.fields if f.name not in names]
    schema = T.StructType(kept + added)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text_at = batch.schema.get_field_index("_text")
            _, offsets = rolling.text_bytes(batch.column(text_at))
            for first, last in rolling.row_groups(offsets):
                rows = batch.slice(first, last - first)
                columns = rows.columns[:text_at] + _judged(rows, text_at, min_length, min_exponent)
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    sent = docs.select(*[f"`{f.name}`" for f in kept], docs[f"`{text_col}`"].cast("string").alias("_text"))
    return sent.mapInArrow(judge, schema)
