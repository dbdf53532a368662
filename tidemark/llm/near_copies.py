"""Near copies: SimHash anchors find candidates, exact Jaccard similarity of word shingles links them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import PARTS, cut
from tidemark.llm.exact_dedup import text_digest
from tidemark.llm.simhash import PRINTS_A_TASK, CoveringCode, components, differing, first_of_each, majority, scrambled, shingle_hashes, star_forest

#: SimHashes of a text's set of words, each by another hash, and the bits in which two of one kind surely have a common anchor.
CHANNELS, SURE_BITS = 7, 2
#: Longs of a SimHash of the set of shingles, and the bits in which candidates may differ: sets of a similarity of 0.8 differ in 29 of 192 on average, with a deviation of 5.
SKETCH_LONGS, LOOSE_BITS = 3, 48
#: Nodes of a component that are compared in one task.
BLOCK = 512


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    return np.unique(shingle_hashes((text or "").encode(), words))


def near_prints(text: str | None, words: int) -> tuple[int, list[int], list[int]]:
    """(a hash of the set of shingles, SimHashes of the set of words, a longer SimHash of the set of shingles)."""
    shingles, single = shingle_set(text, words), shingle_set(text, 1)
    prints = [majority(scrambled(single, k)) for k in range(1, CHANNELS + 1)]
    return xxhash.xxh64_intdigest(shingles.tobytes()), prints, [majority(scrambled(shingles, k)) for k in range(1, SKETCH_LONGS + 1)]


def candidate_links(nodes: DataFrame) -> DataFrame:
    """Links (u, v) that join the nodes (node, prints, sketch) whose sketches differ in at most LOOSE_BITS at a common anchor, directly or by others.

    Each print goes to its anchors, apart by channel. A task joins what its groups link and sends one link a node at most, to the least
    node that it has found it to be joined with; so links are stars, whatever the number of groups.
    """
    code = nodes.sparkSession.sparkContext.broadcast(CoveringCode(SURE_BITS))
    fields = ["anchor", "node", *(f"s{k}" for k in range(SKETCH_LONGS))]

    def replicate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            carried = [batch.column(k).to_numpy() for k in range(1 + SKETCH_LONGS)]
            for channel in range(CHANNELS):
                prints = batch.column(1 + SKETCH_LONGS + channel).to_numpy().view(np.uint64)
                for at in range(0, len(prints), 4000):
                    anchor, index = code.value.replicate(prints[at : at + 4000])
                    yield pa.RecordBatch.from_arrays([pa.array(anchor * CHANNELS + channel), *(pa.array(c[at : at + 4000][index]) for c in carried)], fields)

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        up: dict[int, int] = {}  # of nodes with links in this task

        def top(k: int) -> int:
            while (above := up.setdefault(k, k)) != k:
                up[k] = up[above]
                k = up[k]
            return k

        def take(all_: bool) -> None:
            anchor, node, sketch = (np.concatenate(x) for x in zip(*held, strict=True))
            to = len(anchor) if all_ else int(np.searchsorted(anchor, anchor[-1]))
            held[:] = [(anchor[to:], node[to:], sketch[to:])]
            u, v = star_forest(anchor[:to], node[:to], sketch[:to], LOOSE_BITS) if to else (node[:0], node[:0])
            for a, b in np.unique(np.stack([np.maximum(u, v), np.minimum(u, v)], 1), axis=0).tolist():
                a, b = top(a), top(b)
                up[max(a, b)] = min(a, b)

        for batch in batches:
            sketch = np.stack([batch.column(2 + k).to_numpy().view(np.uint64) for k in range(SKETCH_LONGS)], 1)
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), sketch))
            if sum(len(a) for a, _, _ in held) >= 400_000:
                take(False)
        if held:
            take(True)
        linked = [(k, root) for k in list(up) if (root := top(k)) != k]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in linked], pa.int64()) for k in (0, 1)], ["u", "v"])

    tasks = max(1, -(-nodes.count() // PRINTS_A_TASK))
    longs = lambda c, n: [F.col(c)[k].alias(f"{c}{k}") for k in range(n)]
    flat = nodes.select("node", *longs("sketch", SKETCH_LONGS), *longs("prints", CHANNELS))
    dealt = flat.repartition(tasks, "node").mapInArrow(replicate, ", ".join(f"{c} bigint" for c in fields))
    met = dealt.repartition("anchor").sortWithinPartitions("anchor", "node")
    return met.mapInArrow(compare, "u bigint, v bigint").distinct()


def distance(a: str, b: str) -> Column:
    """Bits in which two sketches differ."""
    return sum((F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k])) for k in range(1, SKETCH_LONGS)), F.bit_count(F.col(a)[0].bitwiseXOR(F.col(b)[0])))


def star_links(large: DataFrame, least: float) -> DataFrame:
    """Links (u, v) of the nodes of each large component (root, part, node, shingles, sketch) with its most central node, where their similarity is `least` or more.

    The centre is the node nearest to the majority of all sketches, bit by bit. Nodes meet it by root and part, so that a component is dealt over tasks.
    """
    bits = F.posexplode(F.flatten(F.transform("sketch", lambda s: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.call_function("getbit", s, k)))))
    ones = large.select("root", bits.alias("bit", "one")).groupBy("root", "bit").agg(F.sum(F.col("one").cast("int")).alias("ones"), F.count(F.lit(1)).alias("n"))
    word = lambda k: F.coalesce(F.bit_or(F.expr(f"CASE WHEN bit DIV 64 = {k} AND 2 * ones > n THEN shiftleft(1L, CAST(bit % 64 AS INT)) ELSE 0L END")), F.lit(0))
    middle = ones.groupBy("root").agg(F.array(*[word(k) for k in range(SKETCH_LONGS)]).alias("middle"))
    spread = lambda df: df.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    placed = large.join(spread(middle), ["root", "part"])
    nearest = placed.groupBy("root", "part").agg(F.min(F.struct(distance("sketch", "middle").alias("d"), "node")).alias("own"))
    centre = nearest.groupBy("root").agg(F.min("own").alias("own")).select("root", F.col("own.node").alias("node"))
    own = large.join(centre, ["root", "node"]).select("root", F.col("node").alias("v"), F.col("shingles").alias("other"))
    both = large.join(spread(own), ["root", "part"]).filter("node <> v")
    shared = F.size(F.array_intersect("shingles", "other"))
    return both.filter(shared / (F.size("shingles") + F.size("other") - shared) >= least).select(F.col("node").alias("u"), "v")


def block_links(least: float):
    """A function over the nodes of one block: (u, v) of pairs of an outer node and a member, nearest sketches first, as far as no link before joins them."""

    def run(block: pa.Table) -> pa.Table:
        node, outer, member = (block[c].to_numpy() for c in ("node", "outer", "member"))
        _, label = np.unique(block["cluster"].to_numpy(), return_inverse=True)
        sketch = np.array(block["sketch"].to_pylist(), np.int64).view(np.uint64)
        lists = block["shingles"].combine_chunks()
        flat, ends = lists.flatten().to_numpy(), np.cumsum(np.concatenate([[0], lists.value_lengths().to_numpy()]))
        sets = [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        size = np.diff(ends)
        members = np.flatnonzero(member)
        u, v = [], []
        for i in np.flatnonzero(outer).tolist():
            bits = differing(sketch[members], sketch[i])
            near = (bits <= LOOSE_BITS) & (label[members] != label[i]) & (np.minimum(size[members], size[i]) >= least * np.maximum(size[members], size[i]))
            for j in members[near][np.argsort(bits[near], kind="stable")].tolist():
                if label[j] == label[i]:
                    continue
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if both / (size[i] + size[j] - both) >= least:
                    u.append(node[i]), v.append(node[j])
                    label[label == label[i]] = label[j]
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def verified_links(members: DataFrame, least: float) -> DataFrame:
    """Links (u, v) of a similarity of `least` or more that join the nodes (node, root, m: nodes of the root, shingles, sketch) of each candidate component as all such links do.

    A component of up to BLOCK nodes is compared in one task. In a larger one nodes are held against its most central node first; those that it does not
    link are then compared with all its nodes, in blocks of at most about BLOCK by BLOCK, so the work grows with the nodes of a component times those that lie
    apart from its centre, and no block gives more links than it has nodes.
    """
    members = members.withColumn("part", F.pmod(F.xxhash64("node"), F.lit(PARTS)).cast("int"))
    large = members.filter(F.col("m") > BLOCK)
    star = cut(star_links(large, least))
    in_star = star.select(F.col("u").alias("node"), F.col("v").alias("cluster")).unionByName(star.select(F.col("v").alias("node"), F.col("v").alias("cluster")).distinct())
    known = members.join(in_star, "node", "left").withColumn("outer", F.col("cluster").isNull()).withColumn("cluster", F.coalesce("cluster", "node"))
    apart = known.filter("outer").groupBy("root").agg(F.count(F.lit(1)).alias("o"))
    known = known.join(apart, "root")  # components without nodes apart are done
    at = lambda n: F.pmod(F.xxhash64("node"), F.ceil(F.col(n) / F.lit(BLOCK)).cast("int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.ceil(F.col(n) / F.lit(BLOCK)).cast("int") - 1))
    columns = ["root", "node", "cluster", "shingles", "sketch"]
    small = known.filter(F.col("m") <= BLOCK).select(*columns, F.lit(0).alias("p"), F.lit(0).alias("q"), F.lit(True).alias("member"), F.lit(True).alias("outer"))
    more = known.filter(F.col("m") > BLOCK)
    inner = more.select(*columns, at("m").alias("p"), every("o").alias("q"), F.lit(True).alias("member"), F.lit(False).alias("outer"))
    outer = more.filter("outer").select(*columns, every("m").alias("p"), at("o").alias("q"), F.lit(False).alias("member"), F.lit(True).alias("outer"))
    blocks = small.unionByName(inner).unionByName(outer)
    return star.unionByName(blocks.groupBy("root", "p", "q").applyInArrow(block_links(least), "u bigint, v bigint"))


def near_copies(docs: DataFrame, words: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs, as from exact_dedup: its id, the id that stays of its component, whether it stays, its text's digest.

    Texts are linked where their sets of `words`-word shingles have a Jaccard similarity of `least` or more, and links are followed. Words are those between ASCII
    blanks, A-Z lower-cased. No link is made by a sketch: anchors and sketches name candidates, and shingle sets decide.

    A changed word changes `words` shingles but one word, so texts find each other by SimHashes of their sets of words, CHANNELS of them by different hashes, at
    common anchors of a covering code. Two of one kind that differ in at most SURE_BITS surely meet there; texts of a similarity of 0.8 differ in four on average and
    meet by one of the kinds in 99 cases of 100 or more. Where they meet, longer SimHashes of their shingles leave those of a similarity of some 0.55 or more. These
    candidates are joined to components, whose texts are read again, and compared within.

    Defined results: the smallest id of a component stays, of rows of one id the one of the smallest digest; a null id only where all
    are null. Texts without words are alike; texts of fewer words than a shingle are one shingle. Rows that repeat id and text are
    marked alike, and keep_one keeps one of them. Other columns are not read; an empty table gives an empty result.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [near_prints(t.as_py(), words) for t in batch.column(2)]
            lists = lambda k, n: pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * n), pa.array(np.array([f[k] for f in found], np.uint64).reshape(-1).view(np.int64)))
            node = pa.array(np.array([f[0] for f in found], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), node, lists(1, CHANNELS), lists(2, SKETCH_LONGS)], ["id", "sha", "node", "prints", "sketch"])

    def take_apart(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), words).view(np.int64) for t in batch.column(4)]
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.int64), *sets])
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["node", "root", "m", "sketch", "shingles"])

    texts = docs.select(F.col(id_col).alias("id"), text_digest(F.col(text_col)).alias("sha"), F.col(text_col).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    rows = cut(texts.mapInArrow(run, f"id {kind}, sha binary, node bigint, prints array<bigint>, sketch array<bigint>"))
    loose = components(candidate_links(cut(rows.select("node", "prints", "sketch").distinct())))
    loose = cut(loose.unionByName(loose.select(F.col("root").alias("node"), "root").distinct()))
    sizes = loose.groupBy("root").agg(F.count(F.lit(1)).alias("m"))
    wanted = rows.join(loose, "node").groupBy("node", "root").agg(F.min(F.struct("sha", "sketch")).alias("one")).join(sizes, "root")
    wanted = cut(wanted.select("node", "root", "m", "one.sketch", "one.sha"))
    read = texts.select("sha", "text").join(wanted, "sha").groupBy("node", "root", "m", "sketch").agg(F.min("text").alias("text"))
    members = cut(read.mapInArrow(take_apart, "node bigint, root bigint, m bigint, sketch array<bigint>, shingles array<bigint>"))
    roots = components(verified_links(members, least))
    parted = cut(rows.select("id", "sha", "node").join(roots, "node", "left").select("id", "sha", F.coalesce("root", "node").alias("root")))
    return first_of_each(parted, id_col)
