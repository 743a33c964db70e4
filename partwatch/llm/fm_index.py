"""Benchmark decontamination with an FM-index over the words of each training shard."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import rolling
from .rolling import U64

# Digits, lower-case letters and every byte of a character beyond ASCII.
WORD = rolling.byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
# Bytes of text in one shard, and the distance of sampled suffix positions.
SHARD = 4 << 20
SAMPLE = 8


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the words before each row."""
    low = rolling.LOWER[data]
    starts, ends, bounds = rolling.word_spans(low, offsets, WORD)
    return rolling.word_hashes(low, starts, ends), bounds


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes of a vector of small integers in order, by prefix tripling; later rounds sort only what still ties."""
    n = len(text)
    bits = max(1, int(max(n, int(text.max()) + 1 if n else 0) + 1).bit_length())
    step = 3 if 3 * bits <= 64 else 2

    def ahead(rank: np.ndarray, at: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        inside = at + by < n
        out[inside] = rank[at[inside] + by] + 1
        return out.astype(U64)

    rank, at, depth = text.astype(np.int64), np.arange(n), 1
    order, starts = np.empty(n, np.int64), np.zeros(n, np.int64)
    while len(at):
        key = rank[at].astype(U64)
        for k in range(1, step):
            key = (key << U64(bits)) | ahead(rank, at, k * depth)
        sort = np.argsort(key)
        at, key = at[sort], key[sort]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        first = np.flatnonzero(new)
        size = np.diff(first, append=len(at))
        # A tie keeps the places it had: its members follow the place of the first of them.
        if depth == 1:
            place = np.arange(n)
            starts = np.repeat(first, size)
        else:
            group = rank[at]
            head = np.concatenate(([True], group[1:] != group[:-1]))
            base = np.flatnonzero(head)
            inner = np.arange(len(at)) - np.repeat(base, np.diff(base, append=len(at)))
            place = group + inner
            starts = np.repeat(place[first], size)
        order[place] = at
        if depth == 1:
            rank = np.empty(n, np.int64)
        rank[at] = starts
        tied = np.repeat(size > 1, size)
        at = at[tied]
        depth *= step
    return order


class WaveletTree:
    """Ranks of symbols in a sequence, as a wavelet matrix: one vector of running counts of ones per bit of a symbol."""

    def __init__(self, symbols: np.ndarray, largest: int):
        self.bits = max(1, int(largest).bit_length())
        self.ones, self.zeros = [], []
        now = symbols.astype(np.int32)
        for level in range(self.bits - 1, -1, -1):
            bit = (now >> level) & 1
            count = np.zeros(len(now) + 1, np.int32)
            np.cumsum(bit, out=count[1:])
            bit = bit.astype(bool)
            self.ones.append(count)
            self.zeros.append(len(now) - int(count[-1]))
            now = np.concatenate((now[~bit], now[bit]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        start = np.zeros(len(at), np.int64)
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = (symbol >> (self.bits - 1 - k)) & 1 == 1
            start = np.where(bit, zeros + ones[start], start - ones[start])
            at = np.where(bit, zeros + ones[at], at - ones[at])
        return at - start

    def symbol(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            bit = ones[at + 1] - ones[at]
            out = (out << 1) | bit
            at = np.where(bit == 1, zeros + ones[at], at - ones[at])
        return out


class FMIndex:
    """Index of the words of a shard; every row's words end with the symbol 0."""

    def __init__(self, words: np.ndarray, bounds: np.ndarray):
        self.vocabulary, ids = np.unique(words, return_inverse=True)
        rows = len(bounds) - 1
        row = np.repeat(np.arange(rows), np.diff(bounds))
        text = np.zeros(len(words) + rows, np.int64)
        text[np.arange(len(words)) + row] = ids + 1
        # Where each row's words start in the text with its end symbols.
        self.row_starts = bounds[:-1] + np.arange(rows)
        order = suffix_array(text)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=len(self.vocabulary) + 1))))
        before = np.where(order > 0, text[order - 1], 0)
        self.tree = WaveletTree(before, len(self.vocabulary))
        # Row starts are sampled too, so that no walk leaves a row.
        sampled = (order % SAMPLE == 0) | (before == 0)
        self.sampled = np.concatenate(([0], np.cumsum(sampled)))
        self.positions = order[sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases (rows of word hashes) that occur, with their ranges of suffixes: backward search, all phrases at once."""
        ids = np.searchsorted(self.vocabulary, phrases)
        known = ids < len(self.vocabulary)
        known[known] = self.vocabulary[ids[known]] == phrases[known]
        which = np.flatnonzero(known.all(axis=1))
        ids = ids[which] + 1
        low, high = np.zeros(len(which), np.int64), np.full(len(which), self.first[-1])
        for k in range(phrases.shape[1] - 1, -1, -1):
            symbol = ids[:, k]
            low = self.first[symbol] + self.tree.rank(symbol, low)
            high = self.first[symbol] + self.tree.rank(symbol, high)
            some = high > low
            which, ids, low, high = which[some], ids[some], low[some], high[some]
        return which, low, high

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, by steps back to the nearest sampled position."""
        out, todo, steps = np.empty(len(at), np.int64), np.arange(len(at)), 0
        while len(todo):
            hit = self.sampled[at + 1] > self.sampled[at]
            out[todo[hit]] = self.positions[self.sampled[at[hit]]] + steps
            todo, at = todo[~hit], at[~hit]
            symbol = self.tree.symbol(at)
            at = self.first[symbol] + self.tree.rank(symbol, at)
            steps += 1
        return out


class Phrases:
    """Windows of benchmark items by length: word hashes of the distinct windows, and the items each belongs to."""

    def __init__(self, items: list[tuple[str, str]], width: int):
        self.items = sorted({i for i, _ in items})
        place = {name: k for k, name in enumerate(self.items)}
        data, offsets = rolling.text_bytes(pa.array([t for _, t in items], pa.string()))
        words, bounds = tokens(data, offsets)
        of_length: dict[int, dict[bytes, set[int]]] = {}
        for k, (name, _) in enumerate(items):
            own = words[bounds[k] : bounds[k + 1]]
            size = min(width, len(own))
            for i in range(len(own) - size + 1 if size else 0):
                of_length.setdefault(size, {}).setdefault(own[i : i + size].tobytes(), set()).add(place[name])
        self.by_length = []
        for size, windows in sorted(of_length.items()):
            owners = [sorted(x) for x in windows.values()]
            self.by_length.append(
                (
                    size,
                    np.frombuffer(b"".join(windows), U64).reshape(-1, size),
                    np.concatenate(([0], np.cumsum([len(x) for x in owners]))),
                    np.array([x for y in owners for x in y], np.int64),
                )
            )


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All integers of the ranges, one range after the other."""
    before = np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(sizes) else np.empty(0, np.int64)
    return np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)


def search_shard(index: FMIndex, bounds: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which words are hit, and the distinct pairs of row and item place."""
    change = np.zeros(int(bounds[-1]) + 1, np.int32)
    pairs = [np.empty((2, 0), np.int64)]
    for size, windows, first, owners in phrases.by_length:
        which, low, high = index.search(windows)
        count = high - low
        at = index.locate(_ranges(low, count))
        which = np.repeat(which, count)
        row = np.searchsorted(index.row_starts, at, side="right") - 1
        np.add.at(change, at - row, 1)
        np.add.at(change, at - row + size, -1)
        row, which = np.unique(np.stack((row, which)), axis=1) if len(row) else (row, which)
        sizes = (first[1:] - first[:-1])[which]
        pairs.append(np.stack((np.repeat(row, sizes), owners[_ranges(first[which], sizes)])))
    pairs = np.unique(np.concatenate(pairs, axis=1), axis=1)
    return np.cumsum(change[:-1]) > 0, pairs[0], pairs[1]


def slices(items: Iterable[Row], limit: int) -> Iterator[list[tuple[str, str]]]:
    """Benchmark items in lists of a bounded number of bytes; one longer than the bound is alone."""
    now, size = [], 0
    for row in items:
        if now and size + len(row.text) > limit:
            yield now
            now, size = [], 0
        now.append((row.item, row.text))
        size += len(row.text)
    if now:
        yield now


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    width: int = 13,
    slice_chars: int = 8 << 20,
) -> DataFrame:
    """All columns of ``docs`` and what of each text occurs in the benchmark.

    A-Z is lower-cased; words are runs of digits, letters and characters beyond ASCII. An item's windows are its runs of
    ``width`` words, or all its words if it has fewer. Added: ``n_words``; ``hits``, bit k (most significant first) telling
    whether word k lies inside an occurrence of a window; ``n_hit``; ``items``, the ids of items with an occurring window, as
    strings; ``contaminated``: at least one word, and a twentieth of the words, are hit. Columns of these names are replaced.

    A shard is up to ``SHARD`` bytes of consecutive rows (a longer text is one of its own), so nothing is shuffled; the
    benchmark is broadcast in slices of at most ``slice_chars`` characters, each searched in a step of its own. Null and empty texts have
    no words; items with null or empty texts have no windows; a null item id is the empty string; items that share an
    id are one; rows may repeat; empty tables give no rows or no hits.
    """
    spark = docs.sparkSession
    results = T.StructType(
        [
            T.StructField("n_words", T.LongType()),
            T.StructField("hits", T.BinaryType()),
            T.StructField("n_hit", T.LongType()),
            T.StructField("items", T.ArrayType(T.StringType())),
        ]
    )
    rows = benchmark.select(
        F.coalesce(F.col(f"`{item_id_col}`").cast("string"), F.lit("")).alias("item"), F.col(f"`{item_text_col}`").cast("string").alias("text")
    ).where("text <> ''")
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in (*results.names, "contaminated")])
    schema = T.StructType(kept.schema.fields + results.fields)
    found = kept
    for number, items in enumerate(slices(rows.toLocalIterator(), slice_chars) if not rows.isEmpty() else [[]]):
        found = found.mapInArrow(_searcher(spark.sparkContext.broadcast(Phrases(items, width)), text_col, number == 0), schema)
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))


def _searcher(phrases, text_col: str, first: bool):
    """A step that searches one slice; the first adds the result columns, later ones add to them."""

    def search(batches):
        names = phrases.value.items
        for batch in batches:
            data, offsets = rolling.text_bytes(batch[text_col])
            counts, hits, numbers, items = [], [], [], []
            for a, b in rolling.row_groups(offsets, SHARD):
                words, bounds = tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                hit, row, item = np.zeros(len(words), bool), np.empty(0, np.int64), np.empty(0, np.int64)
                if len(words) and phrases.value.by_length:
                    hit, row, item = search_shard(FMIndex(words, bounds), bounds, phrases.value)
                edges = np.searchsorted(row, np.arange(b - a + 1))
                for k in range(b - a):
                    own = hit[bounds[k] : bounds[k + 1]]
                    ids = {names[i] for i in item[edges[k] : edges[k + 1]]}
                    if not first:
                        own = own | np.unpackbits(np.frombuffer(batch["hits"][a + k].as_py(), np.uint8), count=len(own)).astype(bool)
                        ids |= set(batch["items"][a + k].as_py())
                    counts.append(len(own))
                    hits.append(np.packbits(own).tobytes())
                    numbers.append(int(own.sum()))
                    items.append(sorted(ids))
            added = [pa.array(counts, pa.int64()), pa.array(hits, pa.binary()), pa.array(numbers, pa.int64()), pa.array(items, pa.list_(pa.string()))]
            base = batch if first else batch.drop_columns(["n_words", "hits", "n_hit", "items"])
            yield pa.RecordBatch.from_arrays([*base.columns, *added], names=[*base.schema.names, "n_words", "hits", "n_hit", "items"])

    return search
