"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, and how often over a corpus."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import PARTS, shared_path

#: Bytes of texts that are encoded together.
TOGETHER = 1 << 18
#: Entries (pairs of a document) and documents of a block.
BLOCK_PAIRS, BLOCK_DOCS = 250_000, 4_000
#: A group with more links than this first counts its equal tokens.
MANY_LINKS = 64
#: Links that are expanded at once.
EXPANDED = 1 << 20

Encode = Callable[[list[str]], list[list[int]]]


@dataclass
class Tokens:
    """A tokenizer as two things: ids of texts, and the bytes of each id."""

    encode: Encode
    raw: list[bytes]
    size: np.ndarray = field(init=False)

    def __post_init__(self):
        self.size = np.fromiter(map(len, self.raw), np.int64, len(self.raw))

    def matching(self, texts: list[str], whole: list[bytes]) -> list[list[int] | None]:
        """Ids of each text, None where their joined bytes are not `whole`."""
        raw = self.raw.__getitem__
        return [ids if b"".join(map(raw, ids)) == w else None for ids, w in zip(self.encode(texts), whole, strict=True)]


def byte_level(path: str, pattern: str | None = None) -> Tokens:
    """A byte-level BPE of the library tokenizers, which encodes a space and the text; strings of special tokens are plain text.

    Where merges stand in the order of their ids and texts are cut by nothing but `pattern`, the library tiktoken gives the same ids in a quarter
    of the time (compared over every code point); it is used if the pattern is given.
    """
    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    vocabulary = model["model"]["vocab"]
    # byte-level vocabularies write each byte as a printable character: printable bytes as themselves, the others from 256 on, in order
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    special = {t["content"]: t["id"] for t in model["added_tokens"]}
    raw = [b""] * (max([*vocabulary.values(), *special.values()]) + 1)
    for token, i in vocabulary.items():
        raw[i] = token.encode() if token in special else bytes(byte[c] for c in token)
    for token, i in special.items():
        raw[i] = token.encode()
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
    if pattern and all(vocabulary["".join(m)] == 256 + k for k, m in enumerate(merges)):
        import tiktoken

        ranks = {raw[i]: i for t, i in vocabulary.items() if t not in special}
        quick = tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return Tokens(lambda texts: [quick.encode_ordinary(" " + t) for t in texts], raw)
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return Tokens(lambda texts: [e.ids for e in tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)], raw)


def pieces(path: str) -> Tokens:
    """A model of the library sentencepiece, which puts a space before the text itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    raw = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        raw.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
    return Tokens(lambda texts: model.encode(texts, num_threads=1), raw)


@lru_cache(maxsize=1)
def digits(ids: int) -> np.ndarray:
    """The decimal digits of the numbers below `ids`, one row each, padded with zero bytes."""
    width = len(str(ids - 1))
    return np.arange(ids).astype(f"S{width}").view(np.uint8).reshape(-1, width)


def shown_groups(ids: list[np.ndarray], group: list[np.ndarray], before: list[np.ndarray], per_doc: np.ndarray, group_doc: np.ndarray, cells: np.ndarray) -> list[bytes]:
    """For each document its groups as `a1,a2|b1;a3|b2,b3`, in one pass over all tokens: each id is a row of digits with its separator; before: tokens of each side in earlier groups."""
    (a, b), (ga, gb), (before_a, before_b) = ids, group, before
    width = cells.shape[1]
    raw = np.zeros((len(a) + len(b), width + 1), np.uint8)
    last_a, last_b = np.append(ga[1:] != ga[:-1], True), np.append(gb[1:] != gb[:-1], True)
    at_a = np.arange(len(a)) + before_b[ga]
    at_b = np.arange(len(b)) + before_a[gb + 1]
    closes = np.append(group_doc[gb[1:]] == group_doc[gb[:-1]], False)
    raw[at_a, :width], raw[at_b, :width] = cells[a], cells[b]
    raw[at_a, width] = np.where(last_a, ord("|"), ord(","))
    raw[at_b, width] = np.where(last_b, np.where(closes, ord(";"), 0), ord(","))
    used = raw != 0
    ends = np.cumsum(used.sum(1))
    flat = raw[used].tobytes()
    stops = ends[np.cumsum(per_doc) - 1].tolist()
    return [flat[i:j] for i, j in zip([0, *stops[:-1]], stops, strict=True)]


def aligned(ids_a: list[list[int]], ids_b: list[list[int]], a: Tokens, b: Tokens) -> tuple[np.ndarray, ...]:
    """Documents side by side, each with equal bytes of both: per document (n_groups, n_links, written groups), and (document, id of A, id of B, times) of distinct linked pairs."""
    na, nb = (np.fromiter(map(len, x), np.int64, len(x)) for x in (ids_a, ids_b))
    ia, ib = (np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum())) for ids, n in ((ids_a, na), (ids_b, nb)))
    ea, eb = np.cumsum(a.size[ia]), np.cumsum(b.size[ib])
    common = np.intersect1d(ea, eb, assume_unique=True)
    ga, gb = np.searchsorted(common, ea), np.searchsorted(common, eb)
    group_doc = np.searchsorted(ea[np.cumsum(na) - 1], common)
    of_a, of_b = np.bincount(ga, minlength=len(common)), np.bincount(gb, minlength=len(common))
    n_groups = np.bincount(group_doc, minlength=len(na))
    n_links = np.zeros(len(na), np.int64)
    np.add.at(n_links, group_doc, of_a * of_b)
    before = [np.concatenate([[0], np.cumsum(n)]) for n in (of_a, of_b)]
    shown = shown_groups([ia, ib], [ga, gb], before, na + nb, group_doc, digits(max(len(a.raw), len(b.raw))))

    many = of_a * of_b > MANY_LINKS
    sides = [(ga, ia, None), (gb, ib, None)]  # (group, id, times), by group
    if many.any():
        for k, (g, ids, _) in enumerate(sides):
            top = int(ids.max()) + 1
            equal, n = np.unique(g[many[g]] * top + ids[many[g]], return_counts=True)
            g, ids, times = (np.concatenate(x) for x in ((g[~many[g]], equal // top), (ids[~many[g]], equal % top), (np.ones(int((~many[g]).sum()), np.int64), n)))
            order = np.argsort(g, kind="stable")
            sides[k] = (g[order], ids[order], times[order])
        of_b = np.bincount(sides[1][0], minlength=len(common))
    (ga, ia, ta), (gb, ib, tb) = sides
    first, repeats = (np.cumsum(of_b) - of_b)[ga], of_b[ga]
    start = np.concatenate([[0], np.cumsum(repeats)])
    pairs, base = len(b.raw) * len(a.raw), len(b.raw)
    row = group_doc[ga] * pairs + ia * base
    keys, times, at = [], [], 0
    while at < len(ga):
        to = max(at + 1, int(np.searchsorted(start, start[at] + EXPANDED, "right")) - 1)
        left = np.repeat(np.arange(at, to), repeats[at:to])
        right = first[left] + np.arange(start[at], start[to]) - start[left]
        key = row[left] + ib[right]
        if ta is None:
            key, n = np.unique(key, return_counts=True)
        else:
            order = np.argsort(key, kind="stable")
            key = key[order]
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            key, n = key[starts], np.add.reduceat((ta[left] * tb[right])[order], starts)
        keys.append(key), times.append(n)
        at = to
    key, total = keys[0], times[0]
    if len(keys) > 1:
        key, back = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(key), np.int64)
        np.add.at(total, back, np.concatenate(times))
    return n_groups, n_links, shown, key // pairs, key % pairs // base, key % base, total


BLOCK_FIELDS = "block bigint, id {id}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, at array<int>, times array<bigint>, a array<int>, b array<int>, holders array<bigint>"


def align_blocks(docs: DataFrame, first: Callable[[], Tokens], second: Callable[[], Tokens]) -> DataFrame:
    """Each document aligned, in blocks of neighbours; the first row of a block holds its distinct pairs (a, b) and how many of its documents hold each.

    `at` and `times` give a document's pairs as places in its block's list, and how many links it has of each.
    """
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = first(), second()
        task = TaskContext.get().partitionId() << 32
        held: list[tuple] = []  # (id, n_a, n_b, n_groups, n_links, digest, pairs, times)
        state = {"pairs": 0, "blocks": 0}
        base, none = len(b.raw), np.zeros(0, np.int64)

        def flush() -> pa.RecordBatch:
            every = np.concatenate([h[6] for h in held])
            pairs, back = np.unique(every, return_inverse=True)
            holders = np.bincount(back, minlength=len(pairs))
            ends = np.cumsum([0, *(len(h[6]) for h in held)])
            lists = lambda values, kind: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))
            once = lambda values, kind: pa.ListArray.from_arrays(pa.array([0] + [len(pairs)] * len(held), pa.int32()), pa.array(values, kind))
            columns = [pa.array([task + state["blocks"]] * len(held), pa.int64()), pa.array([h[0].as_py() for h in held], held[0][0].type)]
            columns += [pa.array([h[k] for h in held], pa.int64()) for k in (1, 2, 3, 4)] + [pa.array([h[5] for h in held])]
            columns += [lists(back, pa.int32()), lists(np.concatenate([h[7] for h in held]), pa.int64())]
            columns += [once(pairs // base, pa.int32()), once(pairs % base, pa.int32()), once(holders, pa.int64())]
            held.clear()
            state["blocks"] += 1
            state["pairs"] = 0
            return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in BLOCK_FIELDS.format(id=kind).split(", ")])

        def take(rows: list[tuple]) -> None:
            texts = [t for _, t in rows]
            whole = [b" " + t.encode() for t in texts]
            both = list(zip(a.matching(texts, whole), b.matching(texts, whole), strict=True))
            good = [k for k, (x, y) in enumerate(both) if texts[k] and x is not None and y is not None]
            found: dict[int, tuple] = {}
            if good:
                n_groups, n_links, shown, doc, pa_, pb_, times = aligned([both[k][0] for k in good], [both[k][1] for k in good], a, b)
                stops = np.searchsorted(doc, np.arange(len(good) + 1))
                for j, k in enumerate(good):
                    part = slice(stops[j], stops[j + 1])
                    own = (len(both[k][0]), len(both[k][1]), int(n_groups[j]), int(n_links[j]), hashlib.sha256(shown[j]).hexdigest())
                    found[k] = (*own, pa_[part] * base + pb_[part], times[part])
            for k, (i, _) in enumerate(rows):
                held.append((i, *found.get(k, (0, 0, 0, 0, "", none, none))))
                state["pairs"] += len(held[-1][6])

        rows, size = [], 0
        for batch in batches:
            for i, text in zip(batch.column(0), batch.column(1), strict=True):
                rows.append((i, text.as_py() or ""))
                size += len(rows[-1][1])
                if size >= TOGETHER or len(rows) >= BLOCK_DOCS:
                    take(rows)
                    rows, size = [], 0
                    if state["pairs"] >= BLOCK_PAIRS or len(held) >= BLOCK_DOCS:
                        yield flush()
        if rows:
            take(rows)
        if held:
            yield flush()

    return docs.mapInArrow(run, BLOCK_FIELDS.format(id=kind))


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(of: block, k: place in the block's list, count: documents of the corpus that hold the pair, best: whether no other b has more with this a).

    Blocks send each pair once. Sums are taken by pair and a part of the blocks first, then by pair; the answers go back the same way, so the entries
    of a pair that every block holds lie in as many tasks as there are parts. Parts grow with the root of the number of blocks.
    """
    parts = max(PARTS, int(blocks.filter("size(a) > 0").count() ** 0.5))
    entries = blocks.select("block", F.posexplode(F.arrays_zip("a", "b", "holders")).alias("k", "e")).select("block", "k", "e.a", "e.b", "e.holders")
    entries = entries.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(parts))).repartition("a", "b", "part")
    sums = entries.groupBy("a", "b", "part").agg(F.sum("holders").alias("n"))
    totals = sums.groupBy("a", "b").agg(F.sum("n").alias("count"), F.collect_list("part").alias("parts"))
    best = (F.col("count") == F.max("count").over(Window.partitionBy("a"))).alias("best")  # at most as many rows as B has ids
    answers = totals.select("*", best).select("a", "b", F.explode("parts").alias("part"), "count", "best")
    return entries.join(answers, ["a", "b", "part"]).select(F.col("block").alias("of"), "k", "count", "best")


def cross_tokenizer_links(
    docs: DataFrame, first: Callable[[], Tokens], second: Callable[[], Tokens], id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    first and second make tokenizers A and B in a task, over a space and the text. Byte offsets at which tokens of both end cut the tokens into groups; every
    pair of an A and a B token of one group is a link. A pair of ids counts the rows of docs that have a link of it; n_best counts a row's links whose pair
    has the highest count of all with its A id, count_sum adds the counts of its links.

    Ends are cumulative sums of token sizes, for a batch of documents at once, common ends their intersection, groups found by binary search, links made by repeating each
    A token once for each B token of its group. In a group of many links equal tokens are counted first, so its expansion is bounded by distinct ids. Counting
    moves each pair of a block of documents once; rows meet the counts by block.

    Defined results: null and empty texts, and texts that either tokenizer does not give back byte for byte, have no tokens: zeros and an
    empty digest. Repeated rows and ids each count and come back. Other columns are not read; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    folder = shared_path(docs.sparkSession, "aligned")
    align_blocks(rows, first, second).write.parquet(folder)  # smaller than a checkpoint, as places are sorted and most times are 1
    blocks = docs.sparkSession.read.parquet(folder)
    counts = pair_counts(blocks)
    plain = ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def finish(held: pa.Table, found: pa.Table) -> pa.Table:
        n = found.num_rows
        count, best = np.zeros(n, np.int64), np.zeros(n, bool)
        k = found["k"].to_numpy()
        count[k], best[k] = found["count"].to_numpy(), found["best"].to_numpy()
        sizes = held["at"].combine_chunks().value_lengths().to_numpy()
        at, times = (held[c].combine_chunks().flatten().to_numpy() for c in ("at", "times"))
        ends = np.cumsum(np.concatenate([[0], sizes]))
        sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[ends])
        return held.select(plain).append_column("n_best", pa.array(sums(times * best[at]))).append_column("count_sum", pa.array(sums(times * count[at])))

    left = blocks.select("block", *plain, "at", "times").groupBy("block")
    fields = f"id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, n_best bigint, count_sum bigint"
    joined = left.cogroup(counts.groupBy("of")).applyInArrow(finish, fields)
    return joined.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def pair_table(docs: DataFrame, first: Callable[[], Tokens], second: Callable[[], Tokens], text_col: str = "text") -> DataFrame:
    """(a, b, n): each linked pair of ids and the rows of docs that hold it, for building a map between two vocabularies."""
    blocks = align_blocks(docs.select(F.lit(0).alias("id"), F.col(text_col).alias("text")), first, second)
    entries = blocks.select("block", F.inline(F.arrays_zip("a", "b", "holders")))
    sums = entries.groupBy("a", "b", F.pmod(F.xxhash64("block"), F.lit(PARTS)).alias("part")).agg(F.sum("holders").alias("n"))
    return sums.groupBy("a", "b").agg(F.sum("n").alias("n"))
