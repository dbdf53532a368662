"""Removal of word passages that an earlier document has, by level-wise doubling of repeated windows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

U = np.uint64
#: Windows of the first level hold so many words at most.
FIRST_WORDS = 7
#: Windows that a task compares at once before it sends them on.
CHUNK = 400_000
#: Bits of a hash that the levels before the last compare: they only choose candidates, so a chance hit costs a row and nothing else.
FILTER = U(2**48 - 1)
#: Rows without an id are told apart by numbers from here on; as owners of a passage they are all alike, and larger than any id.
NULL_ID = 2**63 - 2**41


def join_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of two neighbouring (or overlapping) windows as one."""
    x = (a ^ (a >> U(29))) * U(0x9E3779B97F4A7C15) + b
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def double_to(h: np.ndarray, have: int, want: int) -> np.ndarray:
    """Hashes of windows of `want` words from those of `have` words: doubled as often as they fit, then once with an overlap."""
    while have < want and len(h):
        step = min(have, want - have)
        h, have = join_hashes(h[:-step], h[step:]), have + step
    return h


def window_lengths(min_words: int) -> list[int]:
    """Lengths of the levels: each twice the one before, less one where min_words asks for it; the last is min_words."""
    lengths = [min_words]
    while lengths[0] > FIRST_WORDS:
        lengths.insert(0, (lengths[0] + 1) // 2)
    return lengths


def order(doc: np.ndarray) -> np.ndarray:
    return np.minimum(doc, NULL_ID)


class Document:
    """Hashes of one text's windows at the lengths of the levels."""

    def __init__(self, words: list[bytes], lengths: list[int]):
        self.lengths = lengths
        self.words = np.fromiter(map(xxhash.xxh3_64_intdigest, words), U, len(words))
        self.levels = [double_to(self.words, 1, lengths[0])]
        for a, b in zip(lengths, lengths[1:], strict=False):
            self.levels.append(double_to(self.levels[-1], a, b))
        span = lengths[1] - lengths[0] + 1 if len(lengths) > 1 else 1
        #: For each window of the second level, its first-level window of least hash: equal windows have equal ones.
        self.least = sliding_window_view(self.levels[0], span).argmin(1) + np.arange(len(self.levels[1])) if span > 1 and len(self.levels[-1]) else None

    def candidates(self, level: int, repeated: np.ndarray | None) -> np.ndarray:
        """Places of the windows of a level that may be repeated, given the repeated hashes of the level before."""
        if level == 0:
            return np.unique(self.least) if self.least is not None else np.arange(len(self.levels[0]))
        before = np.isin(self.levels[level - 1] & FILTER, repeated)
        if level == 1:
            return np.flatnonzero(before[self.least])
        n = len(self.levels[level])
        return np.flatnonzero(before[:n] & before[self.lengths[level] - self.lengths[level - 1] :][:n])

    def windows(self, level: int, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash, check) of windows of a level; the last one has all 64 bits, and 32 of a second hash independent of the first."""
        hashes = self.levels[level][places]
        if level < len(self.lengths) - 1:
            return hashes & FILTER, np.zeros(len(places), np.int32)
        second = double_to(self.words * U(0xA0761D6478BD642F) ^ U(0xE7037ED1A0B428DB), 1, self.lengths[-1])[places]
        return hashes, (second >> U(32)).astype(np.uint32).view(np.int32)


class Combiner:
    """Windows of many documents of one task: of equal ones the smallest document's is sent on, those of the others are settled here."""

    def __init__(self, last: bool):
        self.last = last
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, doc: int, key: np.ndarray, check: np.ndarray) -> None:
        self.parts.append((key, check, np.full(len(key), doc)))
        self.held += len(key)

    def flush(self) -> pa.RecordBatch:
        key, check, doc = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.held = [], 0
        by = np.lexsort((doc, check, key))
        key, check, doc = key[by], check[by], doc[by]
        same = (key[1:] == key[:-1]) & (check[1:] == check[:-1])
        begin = np.flatnonzero(np.concatenate([[True], ~same]))
        size = np.diff(begin, append=len(key))
        owner = np.repeat(doc[begin], size)
        settled = order(doc) > order(owner) if self.last else doc != owner
        several = np.zeros(len(key), bool)
        several[begin] = doc[begin] != doc[begin + size - 1]
        sent = ~settled & np.concatenate([[True], ~(same & (doc[1:] == doc[:-1]))])
        # settled windows go on as one row a document, under a key of that document, away from hot keys
        done_doc, done_key = doc[settled], key[settled]
        by = np.argsort(done_doc, kind="stable")
        done_doc, done_key = done_doc[by], done_key[by]
        at = np.flatnonzero(np.diff(done_doc, prepend=-1 - NULL_ID))
        ends = np.append(at, len(done_key))
        own, n = done_doc[at], int(sent.sum())
        lists = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer((ends * 8).astype(np.int32).tobytes()), pa.py_buffer(done_key.tobytes())])
        columns = [
            pa.array(np.concatenate([key[sent], join_hashes(own.astype(U), own.astype(U))]).view(np.int64)),
            pa.array(np.concatenate([check[sent], np.zeros(len(at), np.int32)])),
            pa.array(np.concatenate([doc[sent], own])),
            pa.array(np.concatenate([several[sent], np.zeros(len(at), bool)])),
            pa.concat_arrays([pa.nulls(n, pa.binary()), lists]),
        ]
        return pa.RecordBatch.from_arrays(columns, ["key", "check", "doc", "several", "keys"])


class Comparer:
    """Windows sorted by hash and document, read as a stream: the documents whose window is repeated, or, at the last level, goes.

    Only the first document of the open hash is held, however many share it.
    """

    def __init__(self, last: bool):
        self.last = last
        self.open: tuple[int, int, int, bool] | None = None  # key, check, first document, repeated

    def take(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        key, check, doc = (batch.column(k).to_numpy() for k in range(3))
        several, passed = batch.column(3).to_numpy(zero_copy_only=False), batch.column(4).is_valid().to_numpy(zero_copy_only=False)
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (check[1:] != check[:-1]) | passed[1:] | passed[:-1]])
        group = np.cumsum(new) - 1
        begin = np.flatnonzero(new)
        first, held = doc[begin], []
        repeated = np.logical_or.reduceat(several, begin) | (doc[np.append(begin[1:], len(doc)) - 1] != first)
        if self.open and not passed[0] and self.open[:2] == (key[0], check[0]):
            _, _, owner, known = self.open
            repeated[0] |= known or owner != doc[0] or first[0] != owner
            first[0] = owner
            if repeated[0] and not known and not self.last:
                held = [owner]
        if self.last:
            out = order(doc) > order(first[group])
        else:
            out = repeated[group]
            if self.open and not held and not passed[0] and self.open[:2] == (key[0], check[0]) and not repeated[0]:
                out[: begin[1] if len(begin) > 1 else len(doc)] = False
        self.open = None if passed[-1] else (int(key[-1]), int(check[-1]), int(first[-1]), bool(repeated[-1]))
        keep = np.flatnonzero(out | passed)
        column = lambda k: batch.column(k).take(pa.array(keep))
        lone = pa.array([key[0]] * len(held), pa.int64())
        keys = pa.concat_arrays([pa.array(key[keep], pa.int64(), mask=passed[keep]), lone])
        return pa.RecordBatch.from_arrays([pa.concat_arrays([column(2), pa.array(held, pa.int64())]), keys, pa.concat_arrays([column(4), pa.nulls(len(held), pa.binary())])], ["doc", "key", "keys"])


def repeated_hashes(key: pa.Scalar, keys: pa.Scalar) -> np.ndarray:
    """The hashes that a document was told of."""
    lists = [np.frombuffer(x, U) for x in keys.as_py() or []]
    return np.concatenate([key.values.to_numpy().view(U) if key.is_valid else np.zeros(0, U), *lists])


def repeated_windows(rows: DataFrame, min_words: int) -> DataFrame:
    """doc, key array<bigint>, keys array<binary>: the hashes of the windows of each document that go; rows: id, text, doc.

    Level by level, windows of twice the length (13 words: 7, then 13) are formed where the shorter ones that they
    are made of were repeated, and meet by hash in an exchange of their own, until none is left or min_words is reached; longer
    passages are unions of such windows. First-level windows are thinned to those of least hash within a
    window of the next level. The last level compares 96 bits. The texts are dealt out by document once; all joins reuse that exchange.
    """
    lengths = window_lengths(min_words)
    known = None
    for level in range(len(lengths)):
        last = level == len(lengths) - 1

        def spread(batches: Iterable[pa.RecordBatch], level=level, last=last) -> Iterator[pa.RecordBatch]:
            combiner = Combiner(last)
            for batch in batches:
                for k, doc in enumerate(batch.column(2).to_pylist()):
                    if level and not batch.column(3)[k].is_valid:
                        continue  # nothing of this document was repeated
                    words = (batch.column(1)[k].as_py() or "").encode().split()
                    if len(words) < min_words:
                        continue
                    document = Document(words, lengths)
                    places = document.candidates(level, repeated_hashes(batch.column(3)[k], batch.column(4)[k]) if level else None)
                    combiner.add(doc, *document.windows(level, places))
                    if combiner.held >= CHUNK:
                        yield combiner.flush()
            if combiner.held:
                yield combiner.flush()

        def compare(batches: Iterable[pa.RecordBatch], last=last) -> Iterator[pa.RecordBatch]:
            comparer = Comparer(last)
            for batch in batches:
                if batch.num_rows:
                    yield comparer.take(batch)

        source = rows.select("id", "text", "doc") if known is None else rows.join(known, "doc", "left").select("id", "text", "doc", "key", "keys")
        sent = source.mapInArrow(spread, "key bigint, check int, doc bigint, several boolean, keys binary")
        met = sent.repartition("key").sortWithinPartitions("key", "check", "doc").mapInArrow(compare, "doc bigint, key bigint, keys binary")
        known = met.groupBy("doc").agg(F.collect_list("key").alias("key"), F.collect_list("keys").alias("keys"))
    return known


def covered(n: int, places: np.ndarray, min_words: int) -> np.ndarray:
    """Which of n words the windows at some places cover."""
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, places, 1)
    np.add.at(mark, places + min_words, -1)
    return np.cumsum(mark[:-1]) > 0


def remove_repeated(docs: DataFrame, min_words: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_removed, kept_text: each text without the words of passages that a document with a smaller id has.

    Words are runs of other bytes than 0x20 and 0x09-0x0D; kept words are joined by one space. Passages are judged on the input.

    Defined results: ids are whole numbers below 2^63 - 2^41, other types raise a TypeError. Null and empty texts have no words; texts of
    fewer than min_words words lose none. A passage repeated within one document only, or between rows of one id, stays. A null id counts as
    larger than all others, and rows without an id don't take passages from each other. Rows that repeat come back each. An
    empty table gives an empty result; other columns are not read.
    """
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} must hold whole numbers: the smaller id keeps a passage")
    lengths = window_lengths(min_words)
    alone = F.lit(NULL_ID) + F.pmod(F.xxhash64(F.col(text_col)), F.lit(2**41))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.col(id_col).cast("long"), alone).alias("doc"))

    def remove(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, kept = [], [], []
            for k in range(batch.num_rows):
                words = (batch.column(1)[k].as_py() or "").encode().split()
                n.append(len(words))
                if batch.column(3)[k].is_valid and len(words) >= min_words:
                    hashes = Document(words, lengths).levels[-1]
                    out = covered(len(words), np.flatnonzero(np.isin(hashes, repeated_hashes(batch.column(3)[k], batch.column(4)[k]))), min_words)
                    words = [w for w, o in zip(words, out.tolist(), strict=True) if not o]
                gone.append(n[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["id", "n_words", "n_removed", "kept_text"])

    joined = rows.join(repeated_windows(rows, min_words), "doc", "left").select("id", "text", "doc", "key", "keys")
    kind = rows.schema["id"].dataType.simpleString()
    return joined.mapInArrow(remove, f"id {kind}, n_words bigint, n_removed bigint, kept_text string").withColumnRenamed("id", id_col)
