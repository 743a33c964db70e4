"""Rabin-Karp hashes of words and windows over the raw UTF-8 bytes of a batch of texts, as numpy vectors.

A text is never decoded: words are runs of bytes of a given class, and every hash is a difference of prefix sums
``sum(value[j] * BASE**j)`` modulo 2**64, scaled back to position 0 and mixed. 64 bits leave about n**2 / 2**65 expected
false equalities among n different values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
# Bytes of text worked on at once: each needs a few vectors of eight bytes.
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit over all others."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=U64) * U64(0xD1B54A32D192ED03))


class Powers:
    """Powers of the base and of its inverse, grown on demand and kept per worker."""

    up = np.ones(1, dtype=U64)
    down = np.ones(1, dtype=U64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 1 << 16)
            up, down = np.full(size, BASE, dtype=U64), np.full(size, INVERSE, dtype=U64)
            up[0] = down[0] = 1
            cls.up, cls.down = np.cumprod(up), np.cumprod(down)
        return cls.up[:n], cls.down[:n]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """One more than the values: sums of ``values[j] * BASE**j`` over the values before each place."""
    up, _ = Powers.upto(len(values) + 1)
    sums = np.empty(len(values) + 1, dtype=U64)
    sums[0] = 0
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = Powers.upto(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts])


def windows(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of each window of ``width`` consecutive values (none if there are fewer)."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, dtype=U64)
    sums = prefix_sums(values)
    _, down = Powers.upto(len(sums))
    return mix((sums[width:] - sums[:n]) * down[:n])


def byte_class(*inside: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    for low, high in inside:
        table[low : high + 1] = True
    return table


def blank_separated() -> np.ndarray:
    """Bytes of words ``[^\\x20\\x09-\\x0D]+``."""
    return ~byte_class((0x20, 0x20), (0x09, 0x0D))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, and where each row starts (one more than the rows). A null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], pa.large_string())
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, where, data = column.buffers()
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_groups(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``size`` bytes; a longer row is alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the number of words before each row (one more than the rows)."""
    n = len(data)
    if n == 0:
        empty = np.empty(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    word = inside[data]
    cuts = np.zeros(n + 1, dtype=bool)
    cuts[offsets] = True
    begins, ends = word.copy(), np.zeros(n + 1, dtype=bool)
    begins[1:] &= ~word[:-1] | cuts[1:n]
    ends[1:n] = word[:-1] & (~word[1:] | cuts[1:n])
    ends[n] = word[-1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends), np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each word. Works through ``CHUNK`` bytes at a time, so that a long text takes no more memory."""
    out, first = np.empty(len(starts), U64), 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + CHUNK, side="right")))
        low, high = starts[first], ends[last - 1]
        sums = prefix_sums(BYTE_VALUES[data[low:high]])
        out[first:last] = span_hashes(sums, starts[first:last] - low, ends[first:last] - low)
        first = last
    return out


def inside_windows(bounds: np.ndarray, width: int) -> np.ndarray:
    """Which windows over all values of a batch lie within one row; ``bounds`` are the rows' first values and the end."""
    n = int(bounds[-1]) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=bool)
    change = np.zeros(n + 1, dtype=np.int32)
    good = bounds[1:] - width + 1 > bounds[:-1]
    np.add.at(change, bounds[:-1][good], 1)
    np.add.at(change, (bounds[1:] - width + 1)[good], -1)
    return np.cumsum(change[:n]) > 0


def spread(marked: np.ndarray, width: int, length: int) -> np.ndarray:
    """Which of ``length`` values are inside a marked window of ``width`` values."""
    change = np.zeros(length + 1, dtype=np.int32)
    at = np.flatnonzero(marked)
    np.add.at(change, at, 1)
    np.add.at(change, np.minimum(at + width, length), -1)
    return np.cumsum(change[:length]) > 0
