"""SimHash near-duplicates, linked by anchor points of a covering code."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import PARTS, cut, with_total

#: Groups of an anchor up to this size are compared together, larger ones one by one.
SMALL = 64
#: Fingerprints that one task replicates: some 150 replicas of 16 bytes of each.
PRINTS_A_TASK = 20_000


def shingle_hashes(raw: bytes, words: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of `words` words in a text's bytes; fewer words are one shingle, no words none."""
    tokens = raw.lower().split()  # bytes.lower() and bytes.split() know ASCII only
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(size + 1) - 1
    begins = ends - size
    n = max(1, len(tokens) - words + 1)
    a, b = begins[:n].tolist(), (ends[words - 1 :] if len(tokens) >= words else ends[-1:]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(joined[i:j], seed) for i, j in zip(a, b, strict=True)], np.uint64, n)


def majority(h: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 15):
        part = h[at : at + (1 << 15)]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(sum(1 << int(k) for k in np.flatnonzero(2 * ones > len(h))))


def fingerprint(raw: bytes, words: int = 3, seed: int = 42) -> int:
    """The SimHash of a text's bytes: a bit is 1 if it is set in over half of the shingles' XXH64."""
    return majority(shingle_hashes(raw, words, seed))


def scrambled(h: np.ndarray, k: int) -> np.ndarray:
    """Further hashes of hashed shingles, as if by another seed."""
    x = (h ^ np.uint64(0x9E3779B97F4A7C15 * k % 2**64)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint as a signed long; a null text has no words and so the fingerprint zero."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint((t.as_py() or "").encode(), words, seed) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(prints, np.uint64).view(np.int64))], ["id", "fingerprint"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, fingerprint bigint").withColumnRenamed("id", id_col)


class CyclicCode:
    """A perfect cyclic code; for each value the codewords within its covering radius plus 0, 1, 2 ... bits."""

    def __init__(self, length: int, generator: int, radius: int, extra: int):
        self.length, degree = length, generator.bit_length() - 1

        def remainder(v: int) -> int:
            for k in range(length - 1, degree - 1, -1):
                if v >> k & 1:
                    v ^= generator << (k - degree)
            return v

        bit = [remainder(1 << k) for k in range(length)]
        self.tables = [np.zeros(256, np.int64) for _ in range(-(-length // 8))]
        for k in range(length):
            table = self.tables[k // 8]
            table[(np.arange(256) >> (k % 8) & 1) == 1] ^= bit[k]
        by: list[dict[int, list[int]]] = [{} for _ in range(extra + 1)]
        for weight in range(radius + extra + 1):
            for places in combinations(range(length), weight):
                s = 0
                for k in places:
                    s ^= bit[k]
                by[max(0, weight - radius)].setdefault(s, []).append(sum(1 << k for k in places))
        #: levels[e][syndrome]: flips that lead to a codeword at the radius plus e bits (e = 0: within the radius), padded with -1.
        self.levels = []
        for found in by:
            width = max(map(len, found.values()))
            table = np.full((1 << degree, width), -1, np.int64)
            for s, flips in found.items():
                table[s, : len(flips)] = flips
            self.levels.append(table)

    def anchors(self, v: np.ndarray) -> list[np.ndarray]:
        s = np.zeros(len(v), np.int64)
        for k, table in enumerate(self.tables):
            s ^= table[v >> (8 * k) & 255]
        return [np.where(t[s] >= 0, v[:, None] ^ t[s], -1) for t in self.levels]


class CoveringCode:
    """Two Golay codes (23 bits, radius 3) and a Hamming code (15 bits, radius 1) side by side on bits 0 to 60.

    Its words are the anchors, 2^35 of them. Fingerprints x and y with at most t differing bits have a z between them,
    at most ceil(t / 2) from either. The codeword nearest to z in each block is within that block's radius
    of z, and so within the radius plus the block's share of ceil(t / 2) of x and of y. Replicating each fingerprint to all
    codewords within the radii plus ceil(t / 2) bits over all blocks therefore brings every such pair together.
    """

    def __init__(self, max_bits: int = 3):
        #: The generator polynomials of the codes, as bits.
        golay, hamming = 0b110001110101, 0b10011
        self.extra = -(-max_bits // 2)
        self.blocks = [CyclicCode(23, golay, 3, self.extra), CyclicCode(23, golay, 3, self.extra), CyclicCode(15, hamming, 1, self.extra)]

    def replicate(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(anchor, index of the fingerprint) of every replica."""
        v, at, levels, shifts = prints.astype(np.uint64), 0, [], []
        for b in self.blocks:
            part = (v >> np.uint64(at) & np.uint64((1 << b.length) - 1)).astype(np.int64)
            levels.append(b.anchors(part))
            shifts.append(at)
            at += b.length
        anchors, index = [], []
        for e in product(range(self.extra + 1), repeat=len(self.blocks)):
            if sum(e) > self.extra:
                continue
            a, b, c = (levels[k][x] for k, x in enumerate(e))
            whole = (a[:, :, None, None] | (b[:, None, :, None] << shifts[1]) | (c[:, None, None, :] << shifts[2])).reshape(len(v), -1)
            ok = ((a[:, :, None, None] >= 0) & (b[:, None, :, None] >= 0) & (c[:, None, None, :] >= 0)).reshape(len(v), -1)
            row, column = np.nonzero(ok)
            anchors.append(whole[row, column])
            index.append(row)
        return np.concatenate(anchors), np.concatenate(index)


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which rows of longs differ."""
    return np.bitwise_count(a ^ b).sum(-1)


def star_forest(anchor: np.ndarray, node: np.ndarray, prints: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, least linked node) for rows sorted by anchor: links of each anchor's group, as stars; prints: rows of longs that are compared.

    A group of m nodes gives m - 1 rows at most, not its pairs.
    """
    new = np.concatenate([[True], anchor[1:] != anchor[:-1]])
    begins = np.flatnonzero(new)
    size = np.diff(begins, append=len(anchor))
    label = np.arange(len(anchor))
    group = np.repeat(np.arange(len(begins)), size)
    rows = np.flatnonzero((size[group] >= 2) & (size[group] <= SMALL))
    left, right = [], []
    for step in range(1, int(size[(size >= 2) & (size <= SMALL)].max(initial=1))):
        i = rows[rows + step < len(anchor)]
        i = i[group[i] == group[i + step]]
        if not len(i):
            break
        near = i[differing(prints[i], prints[i + step]) <= max_bits]
        left.append(near), right.append(near + step)
    for k in np.flatnonzero(size > SMALL).tolist():
        a, b = _search(prints[begins[k] : begins[k] + size[k]], max_bits)
        left.append(a + begins[k]), right.append(b + begins[k])
    if left:
        left, right = np.concatenate(left), np.concatenate(right)
        while True:  # least index of each connected part
            before = label.copy()
            np.minimum.at(label, left, label[right])
            np.minimum.at(label, right, label[left])
            label = label[label]
            if (label == before).all():
                break
    linked = np.flatnonzero(label != np.arange(len(label)))
    return node[linked], node[label[linked]]


def _search(prints: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Tree links of one large group: each print leaves the open ones when it is first reached."""
    left, right, open_ = [], [], np.arange(len(prints))
    while len(open_):
        front, open_ = [int(open_[0])], open_[1:]
        while front and len(open_):
            i = front.pop()
            near = differing(prints[open_], prints[i]) <= max_bits
            found, open_ = open_[near], open_[~near]
            left.append(np.full(len(found), i)), right.append(found)
            front.extend(found.tolist())
    empty = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (empty, empty)


def anchored_links(prints: DataFrame, max_bits: int = 3) -> DataFrame:
    """Links (u, v), u > v, that join the distinct values of `fingerprint` as all links of at most max_bits between two of them do.

    A known number of fingerprints goes to each task, so that the tasks that replicate grow with them; replicas
    meet by anchor in sorted partitions that are read as a stream. A group holds distinct fingerprints close to its anchor, never copies.
    """
    code = prints.sparkSession.sparkContext.broadcast(CoveringCode(max_bits))

    def replicate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy()
            for at in range(0, len(values), 1000):
                anchor, index = code.value.replicate(values[at : at + 1000].view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(values[at : at + 1000][index])], ["anchor", "node"])

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush(all_: bool) -> Iterator[pa.RecordBatch]:
            anchor, node = (np.concatenate(x) for x in zip(*held, strict=True))
            to = len(anchor) if all_ else int(np.searchsorted(anchor, anchor[-1]))
            held[:] = [(anchor[to:], node[to:])]
            u, v = star_forest(anchor[:to], node[:to], node[:to, None].view(np.uint64), max_bits) if to else (node[:0], node[:0])
            pairs = np.unique(np.stack([np.maximum(u, v), np.minimum(u, v)], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k])) for k in (0, 1)], ["u", "v"])

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            if sum(len(a) for a, _ in held) >= 400_000:
                yield from flush(False)
        if held:
            yield from flush(True)

    tasks = max(1, -(-prints.count() // PRINTS_A_TASK))
    dealt = prints.select("fingerprint").repartition(tasks, "fingerprint").mapInArrow(replicate, "anchor bigint, node bigint")
    met = dealt.repartition("anchor").sortWithinPartitions("anchor", "node")
    return met.mapInArrow(compare, "u bigint, v bigint").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node that isn't the root of its component; the root is the least node reachable, by alternating large and small stars.

    Stars are joins and groupings of Spark; each round is written to the shared folder and the rounds end when none changes a link.
    """
    links = cut(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    with_least = lambda rows: with_total(rows, "u", "v", F.min("v"), F.min, "m")
    before = mark(links)
    while before[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        met = with_least(large)
        small = met.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(met.filter("v = m").select("u", "v"))
        links = cut(small.filter("u <> v").distinct())
        now = mark(links)
        if now == before:
            break
        before = now
    return links.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")


def simhash_components(
    docs: DataFrame, words: int = 3, max_bits: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id, fingerprint (long), component_id: the smallest id that links of at most max_bits lead to, its own included.

    Copies share a fingerprint, so links are sought between distinct fingerprints and a group of copies costs as much as one text.

    Defined results: null and empty texts have the fingerprint zero and are linked like any other; texts of fewer words than a
    shingle are one shingle. Null ids don't count as smallest ids; a component of null ids only has a null component_id. Repeated
    rows each come back. Other columns are not read; an empty table gives an empty result.
    """
    rows = cut(fingerprints(docs, words, seed, id_col, text_col).withColumnRenamed(id_col, "id"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(PARTS)))
    entries = rows.groupBy("fingerprint", "part").agg(F.min("id").alias("least"))
    distinct = cut(entries.groupBy("fingerprint").agg(F.min("least").alias("least")))
    linked = components(anchored_links(distinct, max_bits))
    rooted = distinct.join(linked, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", "least", F.coalesce("root", "fingerprint").alias("root")
    )
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = rooted.join(ids, "root").select("fingerprint", "component_id")
    decided = entries.select("fingerprint", "part").join(by_print, "fingerprint")
    return rows.join(decided, ["fingerprint", "part"]).select(F.col("id").alias(id_col), "fingerprint", "component_id")


def first_of_each(parted: DataFrame, id_col: str) -> DataFrame:
    """Which rows (id, sha, root) stay: one of each root. The decision meets the rows by root and a part of it, so that a large component is dealt over tasks."""
    parts = F.pmod(F.xxhash64("id", "sha"), F.lit(PARTS))
    rows = parted.withColumn("part", parts)
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "sha"))
    entries = rows.groupBy("root", "part").agg(least.alias("own"))
    best = entries.groupBy("root").agg(F.min("own").alias("first"))
    decided = entries.select("root", "part").join(best, "root")
    kept = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("sha") == F.col("first.sha"))
    return rows.join(decided, ["root", "part"]).select(
        F.col("id").alias(id_col), F.col("first.id").alias("keep_id"), kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )
