"""Jobs of a pass: which verdicts are due, and how slots are shared between lanes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.verdicts import due_at
from tidemark.sources.scratch import written


def due_jobs(candidates: DataFrame, verdicts: DataFrame, now: int, forced: int, **ttl: int) -> DataFrame:
    """One job per stream and variant without a fresh verdict, with its age; null where never probed or forced.

    The candidate of the smallest channel claims it. Candidates shrink to one row a key before they meet verdicts.
    """
    key = ["stream_id", "stream_hash", "variant_id"]
    first = candidates.groupBy(*key).agg(F.min_by(F.struct("channel_id", "provider_id"), "channel_id").alias("c")).select(*key, "c.*")
    v = verdicts.select(*key, "probed_at", due_at(verdicts, now, forced, **ttl).alias("due"))
    found = first.join(v, key, "left").filter(F.col("due").isNull() | (F.col("due") <= now))
    age = F.when(F.col("probed_at") > forced, F.lit(now) - F.col("probed_at"))
    return found.select("stream_id", "variant_id", "channel_id", "provider_id", age.alias("age"))


def triage(jobs: DataFrame, limits: DataFrame) -> DataFrame:
    """Each job as open, deferred or unrunnable; a stream with an open job has none deferred, its other jobs are `covered`."""
    d = jobs.join(limits, "provider_id", "left")
    state = F.when(F.col("limit").isNull(), "unrunnable").when(F.col("limit") > 0, "open").otherwise("deferred")
    per = Window.partitionBy("stream_id")
    d = d.withColumn("state", state).withColumn("any_open", F.max((F.col("state") == "open").cast("int")).over(per) == 1)
    return d.withColumn("state", F.when((F.col("state") == "deferred") & F.col("any_open"), "covered").otherwise(F.col("state"))).drop("any_open")


def lane_slice(jobs: DataFrame, limits: DataFrame, total: int) -> DataFrame:
    """At most `total` jobs: each lane (provider) its share by limit, then what quota is left to the oldest of the rest.

    Lanes come in the order of their oldest job. A job beyond the first `total` of its lane can never be taken, so the
    ranking within lanes is cut there, and each task keeps no more; only the table of lanes is ranked as a whole.
    """
    order = [F.desc_nulls_first("age"), F.col("stream_id"), F.col("variant_id")]
    rank = Window.partitionBy("provider_id").orderBy(*order)
    near = jobs.withColumn("n", F.row_number().over(rank)).filter(F.col("n") <= total)
    lead = F.struct(F.coalesce(-F.col("age"), F.lit(-(2**62))).alias("age"), "stream_id", "variant_id")
    lanes = jobs.groupBy("provider_id").agg(F.count(F.lit(1)).alias("jobs"), F.min(lead).alias("lead")).join(limits, "provider_id", "left")
    lanes = lanes.withColumn("limit", F.coalesce("limit", F.lit(1)).cast("bigint"))
    seen = Window.orderBy("lead")
    lanes = lanes.withColumn("lane", F.row_number().over(seen)).withColumn("capacity", F.sum("limit").over(Window.partitionBy()))
    want = F.least(F.ceil(F.lit(total) * (F.col("limit") / F.col("capacity"))), F.col("jobs"))
    lanes = lanes.withColumn("want", F.when(F.col("capacity") > 0, want).otherwise(F.lit(0)))
    before = F.sum("want").over(seen.rowsBetween(Window.unboundedPreceding, -1))
    lanes = lanes.withColumn("quota", F.least(F.col("want"), F.greatest(F.lit(total) - F.coalesce(before, F.lit(0)), F.lit(0))))
    lanes = lanes.withColumn("left", F.lit(total) - F.sum("quota").over(Window.partitionBy()))
    d = near.join(lanes.select("provider_id", "lane", "quota", "left", "capacity"), "provider_id")
    by_share = d.filter(F.col("n") <= F.col("quota"))
    rest = d.filter((F.col("n") > F.col("quota")) & (F.col("capacity") > 0)).orderBy(F.desc_nulls_first("age"), "lane", "n").limit(total)
    rest = rest.withColumn("r", F.row_number().over(Window.orderBy(F.desc_nulls_first("age"), "lane", "n"))).filter(F.col("r") <= F.col("left"))
    cols = [*jobs.columns]
    return by_share.select(*cols, F.lit("share").alias("taken_by")).unionByName(rest.select(*cols, F.lit("rest").alias("taken_by")))


def numbered(items: DataFrame, by: str, order: list[str]) -> DataFrame:
    """items with `seq`, their number from 0 on within `by` in an order without ties.

    Rows are dealt by ranges of (by, order) and written; each range is numbered by itself and starts where the ranges before it end. So the items of
    one value of `by` may fill many tasks.
    """
    placed = written(items.repartitionByRange(by, *order).withColumn("piece", F.spark_partition_id()), "numbered")
    before = Window.partitionBy(by).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    ahead = placed.groupBy(by, "piece").count().select(by, "piece", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("ahead"))
    within = F.row_number().over(Window.partitionBy(by, "piece").orderBy(*order))
    return placed.withColumn("within", within).join(ahead, [by, "piece"]).withColumn("seq", F.col("ahead") + F.col("within") - 1).drop("piece", "ahead", "within")


def draw(items: DataFrame, logins: DataFrame, order: list[str]) -> DataFrame:
    """Each item's login by weighted round-robin within its provider: the login whose range of widths holds its number modulo their sum.

    `logins` has provider_id, login_id and slots. Where all slots of a provider are zero its first login takes all.
    """
    per = Window.partitionBy("provider_id").orderBy("login_id")
    all_of = Window.partitionBy("provider_id")
    ranges = logins.withColumn("hi", F.sum("slots").over(per.rowsBetween(Window.unboundedPreceding, 0))).withColumn("lo", F.col("hi") - F.col("slots"))
    ranges = ranges.withColumn("width", F.sum("slots").over(all_of)).withColumn("first", F.min("login_id").over(all_of))
    d = numbered(items, "provider_id", order).join(ranges, "provider_id")
    at = F.try_mod(F.col("seq"), F.col("width"))
    hit = F.when(F.col("width") > 0, (F.col("lo") <= at) & (at < F.col("hi"))).otherwise(F.col("login_id") == F.col("first"))
    return d.filter(hit).select(*items.columns, "login_id")
