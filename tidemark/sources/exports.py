"""Exports of rules as JSON files, for cross-checks and imports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RULE = "channel_id BIGINT, name STRING, enabled BOOLEAN, aliases ARRAY<STRING>, contains ARRAY<STRING>, exclude ARRAY<STRING>"


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """Channels' rules of the export files at a path; a file holds an array of rules, or an object with `channels`. Unset lists are empty."""
    bodies = spark.read.text(path, wholetext=True)
    listed = F.coalesce(F.get_json_object("value", "$.channels"), F.col("value"))
    d = bodies.select(F.explode(F.from_json(listed, f"ARRAY<STRUCT<{RULE}>>")).alias("r")).select("r.*").filter("channel_id IS NOT NULL")
    lists = {c: F.coalesce(c, F.array().cast("array<string>")) for c in ("aliases", "contains", "exclude")}
    return d.withColumns(lists | {"enabled": F.coalesce("enabled", F.lit(True))})


def cross_checked(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """channel_id, found (both, ours, theirs) and whether the claimed streams are the same; both: channel_id, stream_id."""
    mark = lambda d, name: d.select("channel_id", "stream_id").distinct().withColumn(name, F.lit(1))
    d = mark(ours, "a").join(mark(theirs, "b"), ["channel_id", "stream_id"], "full").groupBy("channel_id")
    d = d.agg(F.count("a").alias("ours"), F.count("b").alias("theirs"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("shared"))
    found = F.when((F.col("ours") > 0) & (F.col("theirs") > 0), "both").when(F.col("ours") > 0, "ours").otherwise("theirs")
    return d.select("channel_id", found.alias("found"), "ours", "theirs", "shared", ((F.col("ours") == F.col("shared")) & (F.col("theirs") == F.col("shared"))).alias("same"))
