"""Tables that are kept between passes: what they are after a write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALL_GROUPS = -1


def replaced(old: DataFrame, new: DataFrame) -> DataFrame:
    """The new rows; the old ones where there are no new ones."""
    some = new.agg((F.count(F.lit(1)) > 0).alias("n")).scalar()
    return new.unionByName(old.select(new.columns).filter(~some))


def updated(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows, but those of keys that the new rows have."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(new.columns).unionByName(new)


def upserted(old: DataFrame, new: DataFrame, key: list[Column], keep: list[str], drop: Column | None = None) -> DataFrame:
    """Old rows in their order, each replaced by the new row of its key, then the new rows of other keys; `ord` is their place.

    Of new rows with one key the last counts. `keep` are columns whose old value stays where the new one is null. New rows for
    which `drop` holds take their key's row away.
    """
    names = [f"k{i}" for i in range(len(key))]
    cols = [c for c in old.columns if c != "ord"]
    keyed = lambda d: d.select("*", *[k.alias(n) for k, n in zip(key, names, strict=True)])
    gone = F.lit(False) if drop is None else F.coalesce(drop, F.lit(False))
    last = keyed(new).withColumn("gone", gone).groupBy(*names).agg(F.max_by(F.struct(*cols, "gone"), "ord").alias("new"), F.min("ord").alias("new_ord"))
    was = keyed(old).select(*names, F.struct(*cols).alias("old"), "ord")
    d = was.join(last, names, "full").filter(~F.coalesce("new.gone", F.lit(False)))
    picked = [(F.coalesce(f"new.{c}", f"old.{c}") if c in keep else F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}"))).alias(c) for c in cols]
    return d.select(F.col("ord").isNull().alias("appended"), F.coalesce("ord", "new_ord").alias("ord"), *picked)


def marked(marks: DataFrame, new: DataFrame) -> DataFrame:
    """Refresh marks (group_id, forced_at): of each group the latest; a new mark over all groups clears the others."""
    whole = new.agg(F.max(F.when(F.col("group_id") == ALL_GROUPS, F.col("forced_at"))).alias("at")).scalar()
    d = marks.unionByName(new).filter((F.col("group_id") == ALL_GROUPS) | whole.isNull() | (F.col("forced_at") > whole))
    return d.groupBy("group_id").agg(F.max("forced_at").alias("forced_at"))


def cleared(marks: DataFrame, done: DataFrame) -> DataFrame:
    """Marks but those that are done; one that was set again since stays."""
    return marks.join(done.select("group_id", "forced_at"), ["group_id", "forced_at"], "left_anti")


def with_forced(items: DataFrame, marks: DataFrame) -> DataFrame:
    """Items with the later of their group's mark and the one over all groups, 0 without either."""
    whole = marks.agg(F.coalesce(F.max(F.when(F.col("group_id") == ALL_GROUPS, F.col("forced_at"))), F.lit(0)).alias("at")).scalar()
    d = items.join(marks.filter(F.col("group_id") != ALL_GROUPS), "group_id", "left")
    return d.withColumn("forced_at", F.greatest(F.coalesce("forced_at", F.lit(0)), whole).cast("bigint"))


def completed(hits: DataFrame, verdicts: DataFrame, measure_only: DataFrame) -> DataFrame:
    """Channels of hits (channel_id, stream_id): how many of them have a verdict, whether all, and whether their order may be written."""
    d = hits.select("channel_id", "stream_id").distinct().join(verdicts.select("stream_id").distinct().withColumn("landed", F.lit(1)), "stream_id", "left")
    d = d.groupBy("channel_id").agg(F.count(F.lit(1)).alias("hits"), F.count("landed").alias("landed"))
    d = d.join(measure_only.select("channel_id").distinct().withColumn("silent", F.lit(True)), "channel_id", "left")
    done = F.col("hits") == F.col("landed")
    return d.select("channel_id", "hits", "landed", done.alias("complete"), (done & F.col("silent").isNull()).alias("writable"))
