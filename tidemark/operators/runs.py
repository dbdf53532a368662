"""Histories: passes and programme intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HOUR = 3_600_000


def run_totals(runs: DataFrame, since: int | None = None) -> DataFrame:
    runs = runs if since is None else runs.filter(F.col("started_at") >= since)
    return runs.agg(
        F.count(F.lit(1)).alias("runs"), F.sum("probed").cast("bigint").alias("probed"), F.sum("dead").cast("bigint").alias("dead"),
        F.sum("reordered").cast("bigint").alias("reordered"), F.count("error").alias("errors"), F.max("started_at").alias("last_started_at"),
    )


def activity(runs: DataFrame, start: int, buckets: int, width: int = HOUR) -> DataFrame:
    """Tumbling buckets from start on; those without runs are zero."""
    spine = runs.sparkSession.range(buckets).select(F.col("id").alias("bucket"))
    i = F.floor((F.col("started_at") - start) / width)
    found = runs.filter((F.col("started_at") >= start) & (F.col("started_at") < start + buckets * width)).groupBy(i.alias("bucket"))
    found = found.agg(F.count(F.lit(1)).alias("runs"), F.sum("probed").cast("bigint").alias("probed"))
    return spine.join(found, "bucket", "left").select(
        "bucket", (F.lit(start) + F.col("bucket") * width).alias("at"), F.coalesce("runs", F.lit(0)).alias("runs"), F.coalesce("probed", F.lit(0)).alias("probed")
    )


def collapsed(runs: DataFrame, by: list[str]) -> DataFrame:
    """Consecutive quiet runs (nothing probed, reordered or failed) as one entry; islands within each key of `by`."""
    quiet = (F.col("probed") == 0) & (F.col("reordered") == 0) & F.col("error").isNull()
    w = Window.partitionBy(*by).orderBy("started_at", "run_id")
    marked = runs.withColumn("quiet", quiet).withColumn("last", F.lag("quiet", 1, False).over(w))
    island = F.sum(F.when(F.col("quiet") & F.col("last"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("island", island).groupBy(*by, "island", "quiet").agg(
        F.count(F.lit(1)).alias("runs"), F.min("started_at").alias("first_at"), F.max("started_at").alias("last_at")
    )


def epg_current(epg: DataFrame, now: int) -> DataFrame:
    """The programme on air for each channel; of overlapping ones the last input row."""
    live = epg.filter((F.col("start_ms") <= now) & (F.col("end_ms") > now))
    row = F.max_by(F.struct("title", "start_ms", "end_ms", "is_live", "ord"), "ord").alias("r")
    return live.groupBy("tvg_id").agg(row).select("tvg_id", "r.*")


def epg_next(epg: DataFrame, now: int) -> DataFrame:
    """The next start, and the next live start, of each channel."""
    ahead = F.when(F.col("start_ms") > now, F.col("start_ms"))
    return epg.groupBy("tvg_id").agg(F.min(ahead).alias("next_ms"), F.min(F.when(F.col("is_live"), ahead)).alias("next_live_ms"))
