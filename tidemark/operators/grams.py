"""An inverted index of three-letter grams, by which needles and patterns find the few names that can hold them.

A text is indexed in lower case with everything but ASCII letters and digits as blanks and a blank at either end, so that a needle between word bounds has grams of its
edges; signs are grams by themselves. Equal texts are one entry: a catalogue repeats its names, and the index grows with the distinct ones. Each query asks for its rarest gram
by counted frequency, and postings of a frequent one are split into parts, so no task holds them all. A query that has no gram of its own asks for the empty one, which every text has.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as token
from re import _parser as regex_parser

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.scratch import written

#: Postings of one gram that lie in one part.
SPLIT = 50_000
EVERY = ""


def inner(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", " ")


def spaced(text: Column) -> Column:
    return F.concat(F.lit(" "), inner(text), F.lit(" "))


def grams(spaced_text: Column) -> Column:
    """The distinct grams of three characters of a text, but those of blanks alone."""
    at = F.when(F.length(spaced_text) >= 3, F.sequence(F.lit(1), F.length(spaced_text) - 2)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.filter(F.transform(at, lambda k: F.substring(spaced_text, k, 3)), lambda g: F.trim(g) != ""))


def signs(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([^a-z0-9\s])"), 1))


def postings(texts: DataFrame) -> DataFrame:
    """kind, gram, id of texts (kind, text, id)."""
    every = F.concat(F.array(F.lit(EVERY)), grams(spaced(F.col("text"))), signs(F.col("text")))
    return texts.select("kind", F.explode(every).alias("gram"), "id")


@dataclass
class Index:
    """texts (kind, text, id), counts (kind, gram, n) and postings (kind, gram, part, id) in their order, so that a reader of one gram skips the rest."""

    texts: DataFrame
    counts: DataFrame
    postings: DataFrame


def indexed(rows: DataFrame, kinds: dict[str, Column]) -> Index:
    """The index of the distinct texts of columns, written to the shared folder; a null text has no entry."""
    said = F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("text")) for k, c in kinds.items()])
    distinct = rows.select(F.explode(said).alias("t")).select("t.*").filter("text IS NOT NULL").distinct()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    texts = written(distinct.repartition(cores, "kind", "text").withColumn("id", F.monotonically_increasing_id()), "texts")
    found = written(postings(texts), "postings")
    counts = written(found.groupBy("kind", "gram").agg(F.count(F.lit(1)).alias("n")), "grams")
    parts = F.ceil(F.col("n") / SPLIT).cast("int")
    d = found.join(counts, ["kind", "gram"]).select("kind", "gram", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"), "id")
    return Index(texts, counts, written(d.repartitionByRange("kind", "gram", "part").sortWithinPartitions("kind", "gram", "part", "id"), "postings"))


def candidates(queries: DataFrame, index: Index, kind: str) -> DataFrame:
    """Queries (query, grams) and the distinct texts (said) of a kind that have the rarest gram of each; none for a query with a gram that no text has."""
    texts, counts, own = (d.filter(F.col("kind") == kind) for d in (index.texts, index.counts, index.postings))
    asked = queries.select("query", F.explode(F.when(F.size("grams") > 0, F.col("grams")).otherwise(F.array(F.lit(EVERY)))).alias("gram"))
    ranked = asked.join(counts.select("gram", "n"), "gram", "left").withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.col("n").asc_nulls_first(), "gram")))
    chosen = ranked.filter("place = 1 AND n IS NOT NULL").select("query", "gram", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / SPLIT).cast("int") - 1)).alias("part"))
    ids = chosen.join(own.select("gram", "part", "id"), ["gram", "part"]).select("query", "id")
    return ids.join(texts.select("id", F.col("text").alias("said")), "id").select("query", "said")


def required_runs(pattern: str) -> list[str]:
    """Runs of ASCII letters and digits that any text has which the pattern finds, in lower case; none where that can't be told."""

    def walk(items: object) -> list[str]:
        runs, run = [], ""
        for op, value in items:
            if op is token.LITERAL and (c := chr(value).lower()).isascii() and c.isalnum():
                run += c
                continue
            runs, run = [*runs, run], ""
            if op is token.SUBPATTERN:
                runs += walk(value[-1])
            elif op in (token.MAX_REPEAT, token.MIN_REPEAT, token.POSSESSIVE_REPEAT) and value[0] > 0:
                runs += walk(value[2])
            elif op is token.ATOMIC_GROUP:
                runs += walk(value)
        return [*runs, run]

    try:
        return [r for r in walk(regex_parser.parse(pattern)) if r]
    except (regex_parser.error, RecursionError, OverflowError):
        return []


def run_grams(runs: list[str]) -> list[str]:
    """The grams inside runs: what stands beside a run isn't known."""
    return sorted({r[k : k + 3] for r in runs for k in range(len(r) - 2)})
