"""SentencePiece encoding and decoding with the best-scoring segmentation of a text.

All pieces are in one Aho-Corasick automaton over bytes. A single pass follows the automaton; at each position the output links
give every piece that ends there, and each relaxes the best score of that position. The segments of a batch advance together, one
byte at a time, as numpy vectors. Blanks are written as in the pieces' model (one before the text, U+2581 for a space); a
character without a piece becomes its bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import rolling

BLANK = "▁"
SPACE = 0x20
# Cells (segments x bytes) of the score table of one group of segments.
CELLS = 1 << 19
# Ids decoded at once.
TOKENS = 1 << 18


class Pieces:
    """What a model file says: text, score and id of the pieces, and the ids of single bytes."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.texts: list[bytes] = []
        self.ids: list[int] = []
        self.scores: list[float] = []
        self.byte_ids = [-1] * 256
        self.size = model.get_piece_size()
        for i in range(self.size):
            if model.is_byte(i):
                self.byte_ids[int(model.id_to_piece(i)[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.texts.append(model.id_to_piece(i).replace(BLANK, " ").encode())
                self.ids.append(i)
                self.scores.append(model.get_score(i))
        if min(self.byte_ids) < 0:
            raise ValueError("the model has no pieces for single bytes, so not every text can be encoded")


class Automaton:
    """Transitions of all states over classes of bytes, the piece that ends at a state, and output links."""

    def __init__(self, pieces: Pieces):
        self.byte_ids = np.array(pieces.byte_ids, np.int32)
        used = np.zeros(256, bool)
        used[np.frombuffer(b"".join(pieces.texts), np.uint8)] = True
        self.classes = np.where(used, np.cumsum(used), 0).astype(np.int32)
        width = int(used.sum()) + 1
        children: list[dict[int, int]] = [{}]
        piece_of, depth = [-1], [0]
        for k, text in enumerate(pieces.texts):
            node = 0
            for byte in text:
                c = int(self.classes[byte])
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    piece_of.append(-1)
                    depth.append(depth[node] + 1)
                node = children[node][c]
            if piece_of[node] < 0 or pieces.scores[k] > pieces.scores[piece_of[node]]:
                piece_of[node] = k
        n = len(children)
        parent = np.repeat(np.arange(n), [len(c) for c in children])
        child = np.array([x for c in children for x in c.values()], np.int64)
        by = np.array([x for c in children for x in c], np.int64)
        depth = np.array(depth)
        self.go = np.zeros((n, width), np.int32)
        fail = np.zeros(n, np.int64)
        piece_of = np.array(piece_of)
        link = np.zeros(n, np.int32)
        self.go[0, by[parent == 0]] = child[parent == 0]
        for d in range(1, depth.max() + 1):
            level = np.flatnonzero(depth == d)
            self.go[level] = self.go[fail[level]]
            link[level] = np.where(piece_of[fail[level]] >= 0, fail[level], link[fail[level]])
            own = depth[parent] == d
            fail[child[own]] = self.go[fail[parent[own]], by[own]]
            self.go[parent[own], by[own]] = child[own]
        ends = piece_of >= 0
        lengths = np.array([len(t) for t in pieces.texts] + [0], np.int32)
        self.link, self.ends = link, ends
        self.length = lengths[piece_of]
        self.score = np.array(pieces.scores + [0.0])[piece_of]
        self.id = np.array(pieces.ids + [-1], np.int32)[piece_of]
        self.fallback = min(pieces.scores) - 10
        # Between two segments that are cut apart no piece can lie: before a space that follows another byte, and
        # around single bytes without a piece.
        self.cut_at_spaces = not any(b" " in t.lstrip(b" ") for t in pieces.texts)
        self.alone = ~used
        self.alone[0x80:] = False

    def segments(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of the parts of the rows that are encoded on their own, and the number before each row."""
        n = len(data)
        cut = np.zeros(n + 1, bool)
        cut[offsets] = True
        alone = self.alone[data]
        cut[:n] |= alone
        cut[1:] |= alone
        if self.cut_at_spaces:
            cut[1:n] |= (data[1:] == SPACE) & (data[:-1] != SPACE)
        at = np.flatnonzero(cut)
        return at[:-1], at[1:], np.searchsorted(at[:-1], offsets)

    def encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all segments, one after the other, and the number of ids of each."""
        sizes = ends - starts
        first = np.concatenate(([0], np.cumsum(sizes)))
        token_at = np.full(first[-1], -1, np.int32)
        order = np.argsort(-sizes, kind="stable")
        at = 0
        while at < len(order):
            longest = int(sizes[order[at]])
            # Segments of half the longest size or more, as many as the table holds; short ones go together.
            stop = np.searchsorted(-sizes[order], -(longest // 2) if longest > 16 else 0, side="right")
            stop = min(max(at + 1, int(stop)), at + max(1, CELLS // longest))
            self._viterbi(data, starts[order[at:stop]], sizes[order[at:stop]], first[order[at:stop]], token_at)
            at = stop
        there = token_at >= 0
        return token_at[there], np.diff(np.concatenate(([0], np.cumsum(there)))[first])

    def _viterbi(self, data, starts, sizes, first, token_at) -> None:
        """Best segmentation of segments of descending sizes; sets the id at the place where each token starts."""
        n, longest = len(starts), int(sizes[0])
        best = np.full((n, longest + 1), -np.inf)
        best[:, 0] = 0
        length = np.zeros((n, longest + 1), np.int32)
        token = np.full((n, longest + 1), -1, np.int32)
        state, began = np.zeros(n, np.int32), np.zeros(n, np.int64)
        # How many segments reach each position.
        active = np.searchsorted(-sizes, -np.arange(1, longest + 1), side="right")
        for pos in range(longest):
            m = active[pos]
            byte = data[starts[:m] + pos]
            began[:m] = np.where((byte & 0xC0) != 0x80, pos, began[:m])
            state[:m] = self.go[state[:m], self.classes[byte]]
            node = np.where(self.ends[state[:m]], state[:m], self.link[state[:m]])
            rows = np.flatnonzero(node)
            node = node[rows]
            while len(rows):
                size = self.length[node]
                score = best[rows, pos + 1 - size] + self.score[node]
                better = score > best[rows, pos + 1]
                hit = rows[better]
                best[hit, pos + 1], length[hit, pos + 1], token[hit, pos + 1] = score[better], size[better], self.id[node[better]]
                node = self.link[node]
                rows, node = rows[node > 0], node[node > 0]
            # A whole character may always become its bytes.
            after = starts[:m] + pos + 1
            whole = pos + 1 == sizes[:m]
            whole[~whole] = (data[after[~whole]] & 0xC0) != 0x80
            rows = np.flatnonzero(whole)
            score = best[rows, began[rows]] + self.fallback
            better = score > best[rows, pos + 1]
            rows = rows[better]
            best[rows, pos + 1], length[rows, pos + 1], token[rows, pos + 1] = score[better], pos + 1 - began[rows], -1
        rows, pos = np.arange(n), sizes.copy()
        while len(rows):
            size, ids = length[rows, pos], token[rows, pos]
            pos = pos - size
            known = ids >= 0
            token_at[first[rows[known]] + pos[known]] = ids[known]
            for r, p, s in zip(rows[~known], pos[~known], size[~known], strict=True):
                token_at[first[r] + p : first[r] + p + s] = self.byte_ids[data[starts[r] + p : starts[r] + p + s]]
            rows, pos = rows[pos > 0], pos[pos > 0]


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)


# The automaton of a worker, with the pieces it was built from.
_built: list[tuple[Pieces, Automaton]] = []


def automaton(pieces: Pieces) -> Automaton:
    """Built once in each worker from the broadcast pieces."""
    if not _built or _built[0][0] is not pieces:
        _built[:] = [(pieces, Automaton(pieces))]
    return _built[0][1]


def encode_rows(machine: Automaton, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the rows of a group, and the number of ids of each row."""
    some = np.diff(bounds) > 0
    shift = np.concatenate(([0], np.cumsum(some)))
    spaced = np.full(len(raw) + shift[-1], SPACE, np.uint8)
    spaced[np.arange(len(raw)) + np.repeat(shift[1:], np.diff(bounds))] = raw
    bounds = bounds + shift
    starts, ends, before = machine.segments(spaced, bounds)
    # Equal segments are encoded once.
    _, one, which = np.unique(rolling.word_hashes(spaced, starts, ends), return_index=True, return_inverse=True)
    ids, counts = machine.encode(spaced, starts[one], ends[one])
    sizes = counts[which]
    out = ids[ranges((np.cumsum(counts) - counts)[which], sizes)]
    return out, np.diff(np.concatenate(([0], np.cumsum(sizes)))[before])


class Decoder:
    """Texts of ids. Ids outside the model and control pieces have none."""

    def __init__(self, pieces: Pieces):
        texts = [b""] * (pieces.size + 1)
        for i, text in zip(pieces.ids, pieces.texts, strict=True):
            texts[i] = text
        for byte, i in enumerate(pieces.byte_ids):
            texts[i] = bytes([byte])
        self.none = pieces.size
        self.size = np.array([len(t) for t in texts], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(texts), np.uint8)

    def rows(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """Bytes of each row's ids, without the blank that was put before the text."""
        ids = np.where((ids >= 0) & (ids < self.none), ids, self.none).astype(np.int64)
        raw = self.data[ranges(self.start[ids], self.size[ids])].tobytes()
        cuts = np.concatenate(([0], np.cumsum(self.size[ids])))[bounds - bounds[0]].tolist()
        return [raw[i:j].removeprefix(b" ") for i, j in zip(cuts[:-1], cuts[1:], strict=True)]


def encode(docs: DataFrame, pieces: Pieces, text_col: str = "text", out_col: str = "ids", exact_col: str | None = None) -> DataFrame:
    """All columns of ``docs`` with ``out_col``, the ids of the whole text (replacing a column of that name).

    The ids are those of the segmentation with the greatest sum of scores; of equal sums, the one whose last piece is longest,
    and so on backwards. A null text has null, an empty one no ids. Rows are independent of each other and may repeat.
    With ``exact_col``, the ids are decoded at once and that column tells whether they give the text back (null for a null text).
    """
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    added = [T.StructField(out_col, T.ArrayType(T.IntegerType(), False))]
    if exact_col:
        added.append(T.StructField(exact_col, T.BooleanType()))
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in (out_col, exact_col)])
    schema = T.StructType(kept.schema.fields + added)

    def apply(batches):
        machine, decoder = automaton(shared.value), Decoder(shared.value)
        for batch in batches:
            data, offsets = rolling.text_bytes(batch[text_col])
            for a, b in rolling.row_groups(offsets):
                rows = batch.slice(a, b - a)
                raw, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                ids, counts = encode_rows(machine, raw, own)
                where = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                null = rows[text_col].is_null()
                new = [pa.ListArray.from_arrays(pa.array(where), pa.array(ids.astype(np.int32)), mask=null if null.true_count else None)]
                if exact_col:
                    texts = raw.tobytes()
                    same = [texts[i:j] == t for i, j, t in zip(own[:-1], own[1:], decoder.rows(ids, where), strict=True)]
                    new.append(pa.array(same, pa.bool_(), mask=null.to_numpy(zero_copy_only=False)))
                yield pa.RecordBatch.from_arrays([*rows.columns, *new], names=schema.names)

    return kept.mapInArrow(apply, schema)


def decode(tokens: DataFrame, pieces: Pieces, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """All columns of ``tokens`` with ``out_col``, the text of the ids (replacing a column of that name).

    The inverse of ``encode``: the blank put before the text goes, bytes join to characters. Ids outside the model and control pieces
    have no text; bytes that form no character become U+FFFD. Null ids have null.
    """
    shared = tokens.sparkSession.sparkContext.broadcast(pieces)
    kept = tokens.select(*[F.col(f"`{c}`") for c in tokens.columns if c != out_col])
    schema = T.StructType([*kept.schema.fields, T.StructField(out_col, T.StringType())])

    def apply(batches):
        decoder = Decoder(shared.value)
        for batch in batches:
            where = batch[ids_col].offsets.to_numpy().astype(np.int64)
            for a, b in rolling.row_groups(where - where[0], TOKENS):
                rows, bounds = batch.slice(a, b - a), where[a : b + 1]
                ids = batch[ids_col].values.slice(bounds[0], bounds[-1] - bounds[0]).to_numpy(zero_copy_only=False)
                nulls = rows[ids_col].is_null().to_pylist()
                out = [None if null else t.decode("utf-8", "replace") for null, t in zip(nulls, decoder.rows(ids, bounds), strict=True)]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(out, pa.string())], names=schema.names)

    return kept.mapInArrow(apply, schema)
