"""Exact de-duplication as a tree-merge of sorted digest runs, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut


def text_digest(text: Column) -> Column:
    """SHA-256 of the UTF-8 text as bytes; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", runs: int = 16) -> DataFrame:
    """One row per input row: its id, the id that stays of its group of equal texts, the group's size and whether it stays.

    The rows of each input partition belong to one of ``runs`` runs, so a hot text is spread over all of them. A run holds each digest
    once, in order of digest. Runs are merged in binomial rounds: in round k the run with bit k set goes to the run without it, slice by
    slice of the digest's hash, and both are merged in sorted order; of equal entries the one with the extreme id stays, and counts add up. An
    entry is the 64-bit digest, verified on the full SHA-256 and the byte length at every level. Aggregations over a struct are
    done by sorting, before and after each exchange: the runs stay sorted and a merge holds one entry at a time. Answers go
    back from the merged run to the entries of the first level, and from there to the rows, so the rows of a hot text lie in as many tasks as there are runs.

    Defined results: a null text equals an empty one. Rows that repeat both id and text are members
    of one group and exactly one of them stays. A null id never wins over another id; in a
    group with null ids only, one row stays. An empty table gives an empty result. Other columns
    are not read, whatever their names.
    """
    if runs < 1 or runs & (runs - 1):
        raise ValueError("runs must be a power of two")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text_digest(text).alias("sha"), F.octet_length(text).alias("bytes"))
    rows = rows.withColumns({"digest": F.xxhash64("sha"), "row": F.monotonically_increasing_id(), "run": F.pmod(F.spark_partition_id(), F.lit(runs))})
    rows = cut(rows)  # the numbers of rows and runs hold from here on
    key = ["digest", "sha", "bytes"]
    # a null is the least id either way: max passes over it by itself, min by its flag
    entry = {"max": F.max(F.struct("id", "row")), "min": F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))}[keep]
    best = {"max": F.max, "min": F.min}[keep]
    level = rows.groupBy("run", *key).agg(entry.alias("best"), F.count(F.lit(1)).alias("n"))
    first, left = level, runs
    while left > 1:
        left //= 2
        received = level.withColumn("run", F.pmod(F.col("run"), F.lit(left)))
        level = received.repartition("run", "digest").sortWithinPartitions("run", *key).groupBy("run", *key).agg(best("best").alias("best"), F.sum("n").alias("n"))
    answers = first.select("run", *key).join(level.drop("run"), key)
    return rows.join(answers, ["run", *key]).select(
        F.col("id").alias(id_col),
        F.col("best.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def row_name(id_: Column, digest: Column) -> Column:
    """One text for an id and a digest; a null id is unlike any other, whatever ids are called."""
    return F.concat_ws(":", F.when(id_.isNull(), "-").otherwise(F.concat(F.lit("+"), id_.cast("string"))), digest)


def keep_one(docs: DataFrame, decisions: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay by decisions of exact_dedup or near_copies, with all their columns, whatever their names.

    Rows that repeat id and text give one row: of those, the one of least other columns, compared as JSON text.
    """
    sha = F.lower(F.hex(text_digest(F.col(text_col))))
    kept = decisions.filter("kept").select(row_name(F.col(id_col), F.col("text_sha256")).alias("key"))
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col)]
    rank = F.to_json(F.struct(*others)) if others else F.lit("")
    whole = docs.select(row_name(F.col(id_col), sha).alias("key"), rank.alias("rank"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return whole.join(kept, "key", "left_semi").groupBy("key").agg(F.min_by("row", "rank").alias("row")).select("row.*")
