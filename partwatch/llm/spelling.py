"""Spelling variants: words one edit apart, found through the edit neighbourhoods of words over a reduced alphabet.

Letters are hashed to a few symbols. One edit of a word is at most one edit of its reduced form, so every word one edit away
has its reduced form in the full one-edit neighbourhood (itself, deletions, replacements, insertions) of this one. The
neighbourhoods, as 64-bit keys, are joined to the keys of the reduced vocabulary, and the join condition verifies each
candidate on the original strings: an unlucky key costs time, never a wrong or a lost pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import partitions
from .graph import durable
from .rolling import U64, Powers, mix

LETTERS = "[a-zÀ-ÿ]+"
# Positions whose neighbours are made at once, and code points of a word that is sent along with its keys.
STEP = 1 << 14
SHORT = 64
# The map of taken keys has 2 ** MAX_BITS bits at most: 32 MB, whatever the vocabulary.
MAX_BITS = 28
LENGTH = U64(0x9FB21C651E98DF25)


def letter_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every maximal run of letters of every whole text, with A-Z in lower case: columns ``id`` (text, a null is empty) and ``run``.

    Null and empty texts have no runs; rows that share an id or are repeated whole count each; other columns are ignored.
    """
    lower = F.translate(F.col(f"`{text_col}`").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    name = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id")
    return docs.select(name, F.explode(F.regexp_extract_all(lower, F.lit(LETTERS), F.lit(0))).alias("run"))


def vocabulary(words: DataFrame, min_length: int = 7, min_count: int = 2) -> DataFrame:
    """Distinct ``word`` with its number ``n``; short ones go before they are counted, rare ones after."""
    counts = words.where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= min_count)


class Reduced:
    """Words of a batch over the reduced alphabet, one array of symbols for all of them."""

    def __init__(self, words: list[str], n_symbols: int):
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        self.values = mix(np.arange(1, n_symbols + 1, dtype=U64))
        self.symbols = (points % n_symbols).astype(np.int64)
        self.lengths = np.array([len(w) for w in words], np.int64)
        self.bounds = np.concatenate(([0], np.cumsum(self.lengths)))
        self.word = np.repeat(np.arange(len(words)), self.lengths)
        self.place = np.arange(len(points)) - self.bounds[self.word]
        self.up, self.down = Powers.upto(int(self.lengths.max(initial=0)) + 2)
        sums = np.concatenate((np.zeros(1, U64), np.cumsum(self.values[self.symbols] * self.up[self.place], dtype=U64)))
        self.total = sums[self.bounds[1:]] - sums[self.bounds[:-1]]
        self.before = sums[:-1] - sums[self.bounds[self.word]]
        # Whether the symbol before is another one: equal neighbours of a word are made once.
        self.new = np.ones(len(points), bool)
        self.new[1:] = (self.symbols[1:] != self.symbols[:-1]) | (self.place[1:] == 0)

    @staticmethod
    def key(sums: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return mix(sums + lengths.astype(U64) * LENGTH)

    def own(self) -> np.ndarray:
        return self.key(self.total, self.lengths)

    def neighbours(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the neighbours edited at the places ``first`` to ``last`` of all symbols, and the word of each."""
        place, word, symbol = self.place[first:last], self.word[first:last], self.symbols[first:last]
        before, total, length = self.before[first:last], self.total[word], self.lengths[word]
        value, every = self.values[symbol], np.arange(len(self.values))
        after = total - before - value * self.up[place]
        new = self.new[first:last]
        keys = [self.key((before + after * self.down[1])[new], (length - 1)[new])]
        words = [word[new]]
        other = every != symbol[:, None]
        sums = total[:, None] + (self.values - value[:, None]) * self.up[place][:, None]
        keys.append(self.key(sums[other], np.repeat(length, len(every) - 1)))
        words.append(np.repeat(word, len(every) - 1))
        # Insertion after this place; insertion in front of a word is made with its first place.
        upto = before + value * self.up[place]
        sums = upto[:, None] + self.values * self.up[place + 1][:, None] + (after * self.up[1])[:, None]
        keys.append(self.key(sums[other], np.repeat(length + 1, len(every) - 1)))
        words.append(np.repeat(word, len(every) - 1))
        head = np.flatnonzero(place == 0)
        sums = self.values + (total[head] * self.up[1])[:, None]
        keys.append(self.key(sums.ravel(), np.repeat(length[head] + 1, len(every))))
        words.append(np.repeat(word[head], len(every)))
        keys.append(self.key(total[head], length[head]))
        words.append(word[head])
        # The empty word has no place; its neighbours are made with the first step.
        empty = np.flatnonzero(self.lengths == 0) if first == 0 else np.empty(0, np.int64)
        keys.append(np.tile(self.key(self.values, np.ones(1, np.int64)), len(empty)))
        words.append(np.repeat(empty, len(every)))
        return np.concatenate(keys), np.concatenate(words)


def _with_keys(words: DataFrame, n_symbols: int) -> DataFrame:
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = Reduced(batch["word"].to_pylist(), n_symbols).own()
            yield pa.RecordBatch.from_arrays([batch["word"], batch["n"], pa.array(own.view(np.int64))], names=["word", "n", "key"])

    return words.select("word", "n").mapInArrow(keys, "word string, n long, key long")


def _taken(keyed: DataFrame, n_bits: int) -> np.ndarray:
    """A bit for every value of the first ``n_bits`` bits of a key that some word has; as bytes."""
    bit = F.shiftrightunsigned("key", 64 - n_bits)
    maps = keyed.groupBy(F.shiftright(bit, 15).alias("part")).agg(F.bitmap_construct_agg(bit.bitwiseAND(F.lit(32_767))).alias("bits"))
    out = np.zeros(1 << (n_bits - 3), np.uint8)
    for part, bits in maps.toLocalIterator():  # a fixed number of parts of 4 KB
        out[part * 4_096 : (part + 1) * 4_096] = np.frombuffer(bits, np.uint8)
    return out


def _neighbourhoods(words: DataFrame, taken, n_symbols: int, n_bits: int) -> DataFrame:
    """``id``, ``word`` (null if it is long) and ``near``: each key of the word's neighbourhood that some word may have."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = taken.value
        for batch in batches:
            words, ids = batch["word"].to_pylist(), batch["id"]
            short = pa.array([w if len(w) <= SHORT else None for w in words], pa.string())
            reduced = Reduced(words, n_symbols)
            for first in range(0, max(1, len(reduced.word)), STEP):
                keys, word = reduced.neighbours(first, min(first + STEP, len(reduced.word)))
                at = keys >> U64(64 - n_bits)
                there = (bits[(at >> U64(3)).astype(np.int64)] >> (at & U64(7)).astype(np.uint8)) & 1 == 1
                keys, word = keys[there], word[there]
                order = np.lexsort((keys, word))
                keys, word = keys[order], word[order]
                new = np.ones(len(keys), bool)
                new[1:] = (keys[1:] != keys[:-1]) | (word[1:] != word[:-1])
                keys, word = keys[new], word[new]
                rows, starts = np.unique(word, return_index=True)
                lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(keys)), pa.int32()), pa.array(keys.view(np.int64)))
                rows = pa.array(rows)
                yield pa.RecordBatch.from_arrays([ids.take(rows), short.take(rows), lists], names=["id", "word", "keys"])

    lists = words.select("id", "word").mapInArrow(expand, "id long, word string, keys array<long>")
    return lists.select("id", "word", F.explode("keys").alias("near"))


def near_words(keyed: DataFrame, n_symbols: int, n_bits: int) -> DataFrame:
    """Ordered pairs of words exactly one edit apart: ``id`` of one, ``other`` and ``other_n`` of the other word.

    ``keyed`` is stored and has the columns word, n, key and id. The check is part of the join, so a candidate that fails it is no
    row; a key of very many words lies in partitions that adaptive execution splits. The keys of long words travel without the
    word, which is joined again to their candidates.
    """
    taken = keyed.sparkSession.sparkContext.broadcast(_taken(keyed, n_bits))
    right = keyed.select("key", F.col("word").alias("other"), F.col("n").alias("other_n"))
    long = F.length("word") > SHORT
    pairs = _neighbourhoods(keyed.where(~long), taken, n_symbols, n_bits).join(
        right, (F.col("near") == F.col("key")) & (F.levenshtein("word", "other", 1) == 1)
    )
    candidates = _neighbourhoods(keyed.where(long), taken, n_symbols, n_bits).drop("word").join(
        right.where(F.length("other") >= SHORT), F.col("near") == F.col("key")
    )
    checked = candidates.join(keyed.where(long).select("id", "word"), "id").where(F.levenshtein("word", "other", 1) == 1)
    columns = ("id", "other", "other_n")
    return pairs.select(*columns).unionByName(checked.select(*columns).distinct())


def _roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root``, the last word reached by following ``form``, by pointer doubling.

    A form is ``ratio`` times as frequent as its word, so paths are short: a count of 64 bits allows 63 steps even for a ratio of 2.
    """
    now = durable(forms.select("word", F.col("form").alias("root")))
    for _ in range(6):
        further = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = durable(now.join(further, "root", "left").select("word", "root", "further"))
        now = step.select("word", F.coalesce("further", "root").alias("root"))
        if step.where("further IS NOT NULL").isEmpty():
            break
    return now


def spelling_groups(words: DataFrame, ratio: int = 10, n_symbols: int | None = None) -> DataFrame:
    """Each word with its more frequent near word and the root of its group.

    ``words`` has ``word`` (distinct, not null) and ``n``. Two words are near if they differ by exactly one inserted, deleted or
    replaced code point. ``form`` is the near word of largest ``n`` (ties: the smallest in code-point order) if that is at least
    ``ratio`` (2 or more) times the word's; ``root`` is reached by following forms. The symbols of the reduced alphabet are 2 to 32, more for a larger
    vocabulary, so that words sharing a key stay few; their number changes no result.

    Returns word, form, root, n, n_near, form_n. Words of any length are compared whole, empty ones too; other columns are ignored; an empty table gives
    no rows. A word given twice counts as two.
    """
    spark = words.sparkSession
    if ratio < 2:
        raise ValueError("ratio must be 2 or more, so that forms end")
    # Stored once in many parts: each word costs some hundred keys later.
    plain = durable(words.select("word", F.col("n").cast("long").alias("n")).where("word IS NOT NULL").repartition(partitions(spark), "word"))
    size = max(2, plain.count())
    n_symbols = n_symbols or min(32, 1 << max(1, round(math.log2(size) / 5)))
    n_bits = min(MAX_BITS, max(18, math.ceil(math.log2(size)) + 6))
    keyed = durable(_with_keys(plain, n_symbols).withColumn("id", F.monotonically_increasing_id()))
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("other")))
    near = near_words(keyed, n_symbols, n_bits).groupBy("id").agg(F.count("*").alias("n_near"), best.alias("best"))
    enough = -F.col("best.less") >= ratio * F.col("n")
    rows = keyed.join(near, "id", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(enough, F.col("best.other")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"),
    )
    rows = durable(rows)
    roots = _roots(rows.where("form IS NOT NULL"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
