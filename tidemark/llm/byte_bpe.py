"""Byte-level BPE: pieces are encoded together as padded matrices, and ids are decoded by table."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NONE = np.int32(2**31 - 1)
#: Pieces of more bytes are rows by themselves, which make several merges a round.
LONGEST_ROW = 256
#: Pieces that a worker remembers; beyond, it forgets all and starts anew.
REMEMBERED = 60_000


class Vocabulary:
    """Ranks of a byte-level BPE as arrays: token bytes by id, and a hash table from pairs of ids to the merged id."""

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.tokens[i] = token
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for token, i in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = i
        self.bits = max(4, (4 * len(pairs)).bit_length())
        self.keys, self.ids = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        key, value = np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs))
        at, self.probes = self._slot(key), 0
        while len(key):  # each round places one key in each free slot; the others move on by one
            self.probes += 1
            free = self.keys[at] == -1
            _, first = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            put = np.zeros(len(at), bool)
            put[first] = True
            put &= free
            self.keys[at[put]], self.ids[at[put]] = key[put], value[put]
            key, value, at = key[~put], value[~put], (at[~put] + 1) & ((1 << self.bits) - 1)
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.begins = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The id that each pair merges to, NONE where there is none (or an id is padding, below 0)."""
        key = a.astype(np.int64) << 32 | b.astype(np.int64)
        key = np.where((a < 0) | (b < 0), np.int64(-2), key)
        at = self._slot(key)
        out = np.where(self.keys[at] == key, self.ids[at], NONE)
        open_ = np.flatnonzero((out == NONE) & (self.keys[at] != -1) & (key >= 0))
        for step in range(1, self.probes):
            if not len(open_):
                break
            at_ = (at[open_] + step) & ((1 << self.bits) - 1)
            hit = self.keys[at_] == key[open_]
            out[open_[hit]] = self.ids[at_[hit]]
            open_ = open_[~hit & (self.keys[at_] != -1)]
        return out

    def merge_rows(self, rows: np.ndarray) -> np.ndarray:
        """Ids of pieces, padded with -1, after all merges.

        In each round each row merges its leftmost pair of minimum rank. The rest of the row moves
        up by one, only the two pairs beside the merge are looked up again, and rows without a pair leave.
        """
        done, live = rows.copy(), np.arange(len(rows))
        if rows.shape[1] < 2:
            return done
        rank = self.pair(rows[:, :-1].ravel(), rows[:, 1:].ravel()).reshape(len(rows), -1)
        while len(live):
            at = rank.argmin(1)
            i = np.arange(len(live))
            best = rank[i, at]
            go = best != NONE
            if not go.all():
                done[live[~go]] = rows[~go]
                rows, rank, live, at, best = rows[go], rank[go], live[go], at[go], best[go]
                i = np.arange(len(live))
            if not len(live):
                break
            width = rows.shape[1]
            from_ = np.arange(width)[None, :] + (np.arange(width)[None, :] > at[:, None])
            rows = np.concatenate([rows, np.full((len(rows), 1), -1, np.int32)], 1)[i[:, None], from_]
            rows[i, at] = best
            gap = from_[:, :-1]
            rank = np.concatenate([rank, np.full((len(rank), 1), NONE, np.int32)], 1)[i[:, None], gap]
            last = width - 2
            right = np.minimum(at, last)
            rank[i, right] = np.where(at <= last, self.pair(rows[i, right], rows[i, right + 1]), rank[i, right])
            left = np.maximum(at - 1, 0)
            rank[i, left] = np.where(at > 0, self.pair(rows[i, left], rows[i, left + 1]), rank[i, left])
        return done

    def merge_wide(self, row: np.ndarray) -> np.ndarray:
        """The same merges of one long row, several a round: a row by itself is a matrix of one row, and one merge a round would be quadratic.

        All pairs of minimum rank that don't overlap are merged from the left on, up to and including the first whose merge makes a
        pair of the same or a lower rank, as that pair comes before the rest. So the result is that of one merge a round.
        """
        rank = self.pair(row[:-1], row[1:])
        while len(rank):
            best = rank.min()
            if best == NONE:
                break
            at = np.flatnonzero(rank == best)
            begins = np.concatenate([[True], np.diff(at) > 1])
            at = at[(at - at[begins][np.cumsum(begins) - 1]) % 2 == 0]
            beside = np.concatenate([[False], np.diff(at) == 2])
            left = np.where(at > 0, row[at - 1], -1)
            left[beside] = best
            right = np.concatenate([row, [-1, -1]])[at + 2]
            merged = np.full(len(at), best, np.int32)
            sooner = (self.pair(left, merged) <= best) | (self.pair(merged, right) <= best)
            if sooner.any():
                at = at[: int(sooner.argmax()) + 1]
            row[at] = best
            row, rank = np.delete(row, at + 1), np.delete(rank, at)
            place = at - np.arange(len(at))
            for p in (place[place > 0] - 1, place[place < len(rank)]):
                rank[p] = self.pair(row[p], row[p + 1])
        return row

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, as the bytes of an int32 array."""
        out: list[bytes] = [b""] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for k, p in enumerate(pieces):
            if len(p) > LONGEST_ROW:
                out[k] = self.merge_wide(self.byte_id[np.frombuffer(p, np.uint8)]).tobytes()
            elif p:
                buckets.setdefault((len(p) - 1).bit_length(), []).append(k)
        for power, members in buckets.items():
            width, step = 1 << power, max(64, (1 << 19) >> power)
            for at in range(0, len(members), step):
                part = members[at : at + step]
                size = np.array([len(pieces[k]) for k in part])
                filled = np.arange(width)[None, :] < size[:, None]
                rows = np.full((len(part), width), -1, np.int32)
                rows[filled] = self.byte_id[np.frombuffer(b"".join(pieces[k] for k in part), np.uint8)]
                rows = self.merge_rows(rows)
                for k, row, n in zip(part, rows, (rows >= 0).sum(1).tolist(), strict=True):
                    out[k] = row[:n].tobytes()
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids, gathered from the table of tokens."""
        size = self.lengths[ids]
        ends = np.cumsum(size)
        if not len(ids):
            return b""
        return self.bytes[np.arange(ends[-1]) + np.repeat(self.begins[ids] - ends + size, size)].tobytes()


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file of base64 tokens and ids."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def encoder(vocabulary: Vocabulary, pattern: str) -> Callable[[list[str]], list[np.ndarray]]:
    """A function from texts to ids, with a memory of the pieces that it has met, of bounded size."""
    find, known = regex.compile(pattern).findall, {}

    def encode(texts: list[str]) -> list[np.ndarray]:
        split = [find(t) for t in texts]
        new = [p for p in set().union(*split) if p not in known]
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = list(set().union(*split))
        known.update(zip(new, vocabulary.encode_pieces([p.encode() for p in new]), strict=True))
        return [np.frombuffer(b"".join([known[p] for p in pieces]), np.int32) for pieces in split]

    return encode


_KEPT: dict[tuple, tuple] = {}


def kept_tables(path: str, pattern: str, ranks: dict[bytes, int]) -> tuple[Vocabulary, Callable[[list[str]], list[np.ndarray]]]:
    """A worker builds the tables once and keeps them, with the pieces it has met, for its next tasks."""
    if (path, pattern, len(ranks)) not in _KEPT:
        _KEPT.clear()
        vocabulary = Vocabulary(ranks)
        _KEPT[path, pattern, len(ranks)] = vocabulary, encoder(vocabulary, pattern)
    return _KEPT[path, pattern, len(ranks)]


def _slices(batch: pa.RecordBatch, weigh: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about `most` bytes each, or one row."""
    import pyarrow.compute as pc

    column = batch.column(batch.schema.get_field_index(weigh))
    size = pc.fill_null(pc.binary_length(column), 0) if pa.types.is_string(column.type) or pa.types.is_binary(column.type) else pc.multiply(pc.fill_null(pc.list_value_length(column), 0), 4)
    part = np.concatenate([[0], np.cumsum(size.to_numpy(zero_copy_only=False))[:-1]]) // most
    begins = np.flatnonzero(np.diff(part, prepend=-1)).tolist() + [batch.num_rows]
    for a, b in zip(begins, begins[1:], strict=False):
        yield batch.slice(a, b - a)


def bpe_encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The token ids of each text: id, ids array<int>. No special tokens; a null text is empty and has no ids.

    Each match of the pattern is encoded by itself. The driver reads the rank file, whose size the
    vocabulary bounds, and broadcasts it. Repeated ids and other columns don't matter; one row
    in is one row out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, encode = kept_tables(path, pattern, shared.value)
        for batch in batches:
            for part in _slices(batch, "text"):
                ids = encode([t or "" for t in part.column(1).to_pylist()])
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                values = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), values)], ["id", "ids"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def bpe_decode(encoded: DataFrame, path: str, pattern: str = "", id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The bytes that ids stand for: id, ids, decoded binary. Null ids give no bytes."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, _ = kept_tables(path, pattern, shared.value)
        for batch in batches:
            for part in _slices(batch, "ids"):
                lists = part.column(1)
                offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
                decoded = [vocabulary.decode(values[a:b]) for a, b in zip(offsets, offsets[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(decoded, pa.binary())], ["id", "ids", "decoded"])

    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, ids array<int>, decoded binary").withColumnRenamed("id", id_col)
