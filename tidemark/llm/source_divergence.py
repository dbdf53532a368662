"""Source divergence audit: how far the terms of each source of a language lie from those of its other sources, in whole numbers."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import PARTS, cut

#: Bytes of terms as they are, capital ASCII letters as small ones, all other ASCII as blanks.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Terms that a worker counts before it sends them on.
HELD_TERMS = 400_000
#: Bytes of a text that are taken apart at once.
PIECE = 1 << 20


def term_pieces(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text's bytes, a piece of the text at a time."""
    at = 0
    raw = raw.translate(TERM_BYTES)
    while at < len(raw):
        to = len(raw) if at + PIECE >= len(raw) else raw.find(b" ", at + PIECE)
        to = len(raw) if to < 0 else to
        yield raw[at:to].split()
        at = to


def count_terms(docs: DataFrame) -> DataFrame:
    """lang, source, term, n: occurrences, d: documents that hold it; counted per task and added up by Spark."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, d) in seen.items():
                term = pa.array(list(n), pa.binary()).cast(pa.string())
                columns = [pa.repeat(pa.scalar(x, pa.string()), len(n)) for x in (lang, source)]
                yield pa.RecordBatch.from_arrays([*columns, term, pa.array(list(n.values()), pa.int64()), pa.array([d[t] for t in n], pa.int64())], ["lang", "source", "term", "n", "d"])
            seen.clear()

        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True):
                n, d = seen[lang, source]
                before, own = len(n), set()
                for words in term_pieces(text.as_py()):
                    n.update(words)
                    own.update(words)
                d.update(own)
                held += len(n) - before
                if held >= HELD_TERMS:
                    yield from flush()
                    held = 0
        yield from flush()

    counted = docs.mapInArrow(run, "lang string, source string, term string, n bigint, d bigint")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)"""
    return F.call_function("div", (p - q) * (p - q), q)


def share(count: Column, size: Column, scale: int) -> Column:
    """1 + floor(scale * (count + 1) / size), exact for any counts."""
    return F.lit(1) + F.call_function("div", F.lit(scale).cast("decimal(10,0)") * (count + 1).cast("decimal(19,0)"), size.cast("decimal(20,0)"))


def source_divergence(
    docs: DataFrame,
    least_docs: int = 3,
    most_terms: int = 200,
    scale: int = 1_000_000_000,
    lang_col: str = "lang",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """lang, source, part, item, value, rank: what sets the sources of a language apart.

    Terms are runs of ASCII letters and non-ASCII characters, only A-Z lower-cased. A language keeps the terms of `least_docs` of its documents
    or more, V of them. In each (lang, source), and in each language as a whole, a kept term that occurs there n of N times has the
    share 1 + floor(scale * (n + 1) / (N + V)). Part `pair`: the sum of (p - q)^2 / q, rounded down for each kept term, against each other source of
    the language, p the source's share and q the other's. Part `term`: the same for single terms against the language's share, where the source's is
    larger and the term occurs there, to the rank `most_terms`.

    Each term is pivoted into an array over the sources that hold it, with their indices. The pairs of an array's entries emit contributions, which
    are summed map-side first. Most terms are missing from most sources, and such a source's share is the same for all of them: contributions
    of (held, missing) depend on source and count alone and are made once per count and number of terms, those of (missing, missing) once; an
    emitted pair of entries is corrected by what those have given already. So a term held by k of S sources emits k * k rows, not S * S, and sums
    are equal. Parameters of a language meet its terms by language and one of PARTS parts.

    Defined results: null text, lang or source is empty; an empty lang or source is one like any other. A repeated row is a document of its own.
    A source without terms is compared like any other; a language without kept terms gives its pairs with value 0. Ties of value are ranked by
    the item's UTF-8. Other columns are not read; an empty table gives an empty result.
    """
    read = lambda c, name: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
    rows = docs.select(read(lang_col, "lang"), read(source_col, "source"), read(text_col, "text"))
    groups = rows.select("lang", "source").distinct()
    counted = count_terms(rows)
    vectors = counted.groupBy("lang", "term").agg(F.sum("d").alias("d"), F.collect_list(F.struct("source", "n")).alias("held"), F.sum("n").alias("n"))
    vectors = cut(vectors.filter(F.col("d") >= least_docs).drop("d").withColumn("part", F.pmod(F.xxhash64("term"), F.lit(PARTS)).cast("int")))

    # one row a language: its sources in order, the sizes N + V of each and of all, and the share of a missing term in each
    sizes = vectors.select("lang", F.inline("held")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    kept = vectors.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("whole"))
    of_source = groups.join(sizes, ["lang", "source"], "left").select("lang", F.struct("source", F.coalesce("n", F.lit(0)).alias("n")).alias("s"))
    languages = of_source.groupBy("lang").agg(F.sort_array(F.collect_list("s")).alias("s")).join(kept, "lang", "left")
    size = F.transform("s", lambda s: F.greatest(s["n"] + F.coalesce("terms", F.lit(0)), F.lit(1)))  # 1 where no term is kept and none asks
    languages = languages.select("lang", F.col("s.source").alias("names"), F.coalesce("terms", F.lit(0)).alias("terms"), size.alias("sizes"), (F.col("whole") + F.col("terms")).alias("size"))
    languages = cut(languages.withColumn("zero", F.transform("sizes", lambda n: share(F.lit(0).cast("bigint"), n, scale))))
    parted = languages.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))

    # each term as entries (i: source, c: occurrences, p: share, z: share of a term that is missing there)
    zero = lambda i: F.element_at("zero", i)
    entry = lambda h: F.array_position("names", h["source"]).cast("int")
    placed = F.transform("held", lambda h: F.struct(entry(h).alias("i"), h["n"].alias("c")))
    measured = lambda x: F.struct(x["i"].alias("i"), x["c"].alias("c"), share(x["c"], F.element_at("sizes", x["i"]), scale).alias("p"), zero(x["i"]).alias("z"))
    wide = vectors.join(parted, ["lang", "part"]).select("lang", "term", F.transform(placed, measured).alias("e"), share(F.col("n"), F.col("size"), scale).alias("q"))
    wide = cut(wide)

    out = lambda a, b, c, v: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"), c.cast("bigint").alias("c"), v.cast("bigint").alias("v"))
    none = F.lit(0)

    def met(a: Column, b: Column) -> Column:
        return out(a["i"], b["i"], none, gap(a["p"], b["p"]) - gap(a["p"], b["z"]) - gap(a["z"], b["p"]) + gap(a["z"], b["z"]))

    pairs = F.flatten(F.transform("e", lambda a: F.transform(F.filter("e", lambda b: b["i"] != a["i"]), lambda b: met(a, b))))
    singles = F.transform("e", lambda a: out(a["i"], none, a["c"], F.lit(1)))
    emitted = wide.select("lang", F.inline(F.concat(pairs, singles))).groupBy("lang", "a", "b", "c").agg(F.sum("v").alias("v"))
    emitted = cut(emitted)

    # (held, missing) for every count that a source's terms have, both ways round, less (missing, missing)
    once = emitted.filter("b = 0").withColumn("part", F.pmod(F.xxhash64("a", "c"), F.lit(PARTS)).cast("int")).join(parted, ["lang", "part"])
    once = once.withColumn("p", share(F.col("c"), F.element_at("sizes", F.col("a")), scale)).withColumn("z", zero(F.col("a")))
    others = F.filter(F.sequence(F.lit(1), F.size("names")), lambda r: r != F.col("a"))
    p, z, n = F.col("p"), F.col("z"), F.col("v")
    there = F.transform(others, lambda r: out(F.col("a"), r, none, n * (gap(p, zero(r)) - gap(z, zero(r)))))
    back = F.transform(others, lambda r: out(r, F.col("a"), none, n * (gap(zero(r), p) - gap(zero(r), z))))
    once = once.select("lang", F.inline(F.concat(there, back)))
    every = F.sequence(F.lit(1), F.size("names"))
    base = F.flatten(F.transform(every, lambda a: F.transform(F.filter(every, lambda b: b != a), lambda b: out(a, b, none, F.coalesce(F.col("terms") * gap(zero(a), zero(b)), F.lit(0))))))
    base = languages.select("lang", F.inline(base))
    sums = base.unionByName(once).unionByName(emitted.filter("b > 0")).groupBy("lang", "a", "b").agg(F.sum("v").alias("value"))
    place = groups.join(languages.select("lang", "names"), "lang").select("lang", "source", F.array_position("names", F.col("source")).cast("int").alias("a"))
    other = place.select("lang", F.col("source").alias("item"), F.col("a").alias("b"))
    pair = sums.join(place, ["lang", "a"]).join(other, ["lang", "b"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    ahead = F.filter("e", lambda x: x["p"] > F.col("q"))
    term = wide.select("lang", "term", "q", F.inline(ahead)).select("lang", F.col("i").alias("a"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    order = [F.desc("value"), "item"]
    first = term.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "a").orderBy(*order))).filter(F.col("rank") <= most_terms)
    first = first.join(place, ["lang", "a"]).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pair.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order))).unionByName(first)
