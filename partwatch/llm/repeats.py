"""Substring dedup: words covered by a window of words that occurs more than once are removed."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import exchange, rolling

WORD = rolling.blank_separated()


def _words(table: pa.Table):
    """Data, row offsets, word starts and ends, words before each row and word hashes of a block."""
    data, offsets = rolling.text_bytes(table["_text"])
    starts, ends, bounds = rolling.word_spans(data, offsets, WORD)
    return data, offsets, starts, ends, bounds, rolling.word_hashes(data, starts, ends)


def window_keys(hashes: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the windows that lie within one row, and which of all windows these are."""
    within = rolling.inside_windows(bounds, width)
    return rolling.windows(hashes, width)[within], within


def without_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 35,
    carry: Sequence[str] = (),
    n_blocks: int | None = None,
    n_buckets: int | None = None,
) -> DataFrame:
    """Remove every word covered by a window of ``width`` words whose word sequence also starts anywhere else.

    Words are runs of bytes other than ASCII white space. Each window of each whole text gets a Rabin-Karp hash of 64 bits
    (``rolling``), the hashes are counted over all blocks (``exchange``), and windows counted more than once merge into
    maximal intervals. Windows are judged on the input, not on what is left, and never cross rows.

    Returns the carried columns, then ``id``, ``n_words``, ``n_removed``, ``n_spans`` (maximal removed intervals), ``kept``
    (the text itself if nothing is removed, else the kept words joined by one space; null stays null) and ``kept_sha256`` (of
    the kept words joined by one space). A result replaces a carried column of its name. A null or empty text has no words; rows that are
    repeated whole, or share an id, are rows of their own and remove each other's windows; an empty table gives no rows;
    columns that are not carried are ignored.
    """
    n_buckets = exchange.bucket_number(docs, n_buckets)
    results = T.StructType(
        [
            T.StructField("id", docs.schema[id_col].dataType),
            T.StructField("n_words", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("n_spans", T.LongType()),
            T.StructField("kept", T.StringType()),
            T.StructField("kept_sha256", T.StringType()),
        ]
    )
    carry = [c for c in carry if c not in results.names]
    schema = T.StructType([T.StructField(c, docs.schema[c].dataType) for c in carry] + results.fields)
    blocks = exchange.in_blocks(docs, id_col, text_col, carry, n_blocks)

    def keys_of(table: pa.Table):
        *_, bounds, hashes = _words(table)
        return exchange.distinct(window_keys(hashes, bounds, width)[0])

    def remove(table, replies):
        table = exchange.ordered(table)
        data, offsets, starts, ends, bounds, hashes = _words(table)
        keys, within = window_keys(hashes, bounds, width)
        marked = np.zeros(len(within), bool)
        marked[within] = exchange.codes_of(keys, replies, n_buckets) > 0
        gone = rolling.spread(marked, width, len(hashes))
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        first = bounds[:-1][bounds[:-1] < len(gone)]
        opens[first] = gone[first]
        removed = np.concatenate(([0], np.cumsum(gone)))[bounds]
        spans = np.concatenate(([0], np.cumsum(opens)))[bounds]
        text, digests = [], []
        raw = data.tobytes()
        null = table["_text"].is_null().to_pylist()
        for row in range(len(table)):
            a, b = bounds[row], bounds[row + 1]
            left = np.flatnonzero(~gone[a:b]) + a
            words = b" ".join([raw[s:e] for s, e in zip(starts[left].tolist(), ends[left].tolist(), strict=True)])
            digests.append(hashlib.sha256(words).hexdigest())
            whole = raw[offsets[row] : offsets[row + 1]] if removed[row + 1] == removed[row] else words
            text.append(None if null[row] else whole.decode("utf-8"))
        columns = [table[f"_c{i}"] for i in range(len(carry))]
        columns += [table["_id"], np.diff(bounds), np.diff(removed), np.diff(spans), pa.array(text, pa.string()), pa.array(digests, pa.string())]
        return pa.table(columns, names=[f.name for f in schema.fields])

    replies = exchange.repeated(exchange.send(blocks, keys_of, n_buckets))
    return blocks.groupBy("_block").cogroup(replies.groupBy("_block")).applyInArrow(remove, schema)
