"""A uniform shuffle into shards of exact sizes by a hypergeometric communication matrix, in DataFrame operations only."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut

#: Rows of a block, as long as there are at most MOST blocks; the matrix is drawn on the driver, so its size is bounded. Larger blocks
#: are permuted in pieces of about so many rows.
ROWS_A_BLOCK, MOST = 1000, 4096


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many good ones are among draws taken without replacement; by inversion, for numbers of any size.

    Weights come from ratios of neighbours outward from the mode; those beyond 40 standard
    deviations are under the precision of a double.
    """
    lo, hi = max(0, draws - bad), min(draws, good)
    if lo >= hi:
        return lo
    total = good + bad
    mode = min(hi, max(lo, (draws + 1) * (good + 1) // (total + 2)))
    sd = (draws * (good / total) * (bad / total) * max(total - draws, 1) / max(total - 1, 1)) ** 0.5
    reach = int(40 * sd) + 40
    a, b = max(lo, mode - reach), min(hi, mode + reach)
    k = np.arange(a, b, dtype=float)
    step = np.log((good - k) * (draws - k)) - np.log((k + 1) * (bad - draws + k + 1))
    weight = np.concatenate([[0.0], np.cumsum(step)])
    weight = np.exp(weight - weight.max())
    return a + int(np.searchsorted(np.cumsum(weight), rng.random() * weight.sum(), side="right").clip(0, b - a))


def communication_matrix(blocks: list[int], shards: int, seed: int) -> list[list[int]]:
    """Rows that each block sends to each shard, as a uniform shuffle of all rows would have it.

    A block's row of the matrix is a multivariate hypergeometric draw from the places that are
    still free in the shards; the column sums are the exact shard sizes, at most one apart.
    """
    rng, total = np.random.default_rng(seed), sum(blocks)
    free = [total // shards + (j < total % shards) for j in range(shards)]
    out = []
    for n in blocks:
        row, rest = [], sum(free)
        for j in range(shards):
            rest -= free[j]
            got = hypergeometric(rng, free[j], rest, n)
            row.append(got)
            n -= got
        free = [f - g for f, g in zip(free, row, strict=True)]
        out.append(row)
    return out


def numbered(rows: DataFrame, group: str, key: Column, groups: int, total: int) -> DataFrame:
    """rows with `place`, their number within their group in order of a random key, from 0 on.

    Rows are cut by the high bits of the key into pieces that grow in number with the table; pieces are sorted apart, and the
    counts of earlier pieces are added. So no group is ever held by one task.
    """
    bits = (max(1, -(-total // groups // ROWS_A_BLOCK)) - 1).bit_length()
    rows = rows.withColumn("key", key)
    rows = rows.withColumn("piece", F.shiftright("key", 64 - bits) if bits else F.lit(0).cast("bigint"))
    before = Window.partitionBy(group).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    ahead = rows.groupBy(group, "piece").count().withColumn("ahead", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    within = F.row_number().over(Window.partitionBy(group, "piece").orderBy("key", "id", "text_crc32", "size"))
    return rows.withColumn("within", within).join(ahead, [group, "piece"]).withColumn("place", F.col("ahead") + F.col("within") - 1).drop("key", "piece", "ahead", "within")


def uniform_shards(docs: DataFrame, shards: int = 24, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's shard and its place there, as one uniform shuffle of all rows would give them.

    1. Rows fall into blocks by a hash of the id and the driver draws the matrix of counts from
       block to shard: at most MOST by shards numbers, whatever the table's size.
    2. Each block is permuted locally; its first rows go to shard 0 and so on by its matrix row.
    3. Each shard is permuted again. Both permutations number rows piece by piece.

    The law is ``rows``: counts are at most one apart. Equal texts are not held together; no group
    of copies could be under this law when it outgrows a shard. Defined results: a null text has
    no bytes; rows that repeat an id, or have none, are dealt like others (the text's size and crc32 break
    ties); an empty table gives an empty result; other columns are not read.
    """
    spark: SparkSession = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    total = docs.count()
    many = max(1, min(MOST, -(-total // ROWS_A_BLOCK)))
    draw = lambda k: F.xxhash64(F.lit(seed + k), "id", "text_crc32", "size")
    rows = cut(rows.withColumn("block", F.pmod(draw(0), F.lit(many)).cast("int")))

    counts = {r["block"]: r["count"] for r in rows.groupBy("block").count().collect()}
    sent = communication_matrix([counts.get(b, 0) for b in range(many)], shards, seed)
    matrix = spark.createDataFrame(
        [(b, [int(x) for x in np.cumsum(row)]) for b, row in enumerate(sent)], "block int, upto array<bigint>"
    )
    shard = F.size(F.filter("upto", lambda c: c <= F.col("place")))
    dealt = cut(numbered(rows, "block", draw(1), many, total).join(matrix, "block").select("id", "size", "text_crc32", shard.alias("shard")))
    placed = numbered(dealt, "shard", draw(2), shards, total)
    return placed.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", F.col("place").alias("slot"))
