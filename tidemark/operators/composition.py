"""New orders of channels from ranked and assigned streams, as rows with positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.matching import file_versions

#: Bytes of input files for each partition of rows that are ordered; a task sorts its rows twice, and holds both sorts.
PART_BYTES = 8_000_000


def _parts(*tables: DataFrame) -> int:
    """Partitions for rows of tables: as many more as their files are larger, so that a task holds no more of a larger input."""
    sizes = {path: size for t in tables for path, size, _ in file_versions(t)}
    return max(tables[0].sparkSession.sparkContext.defaultParallelism, -(-sum(sizes.values()) // PART_BYTES))


def composed(ranked: DataFrame, assigned: DataFrame, remove: bool = False, eligible: DataFrame | None = None, most: int = 0) -> DataFrame:
    """channel_id, position, stream_id: ranked streams that the channel has, in rank order, then its other assigned ones.

    With `eligible` (stream_id), ranked streams that it lacks are added, best first, up to `most` held in all (0: no bound).
    `remove` drops the assigned streams that do not rank. Assigned streams may repeat, and keep doing so.
    """
    parts = _parts(ranked, assigned)
    fit = F.lit(False)
    if eligible is not None:
        ranked = ranked.join(eligible.select("stream_id").distinct().withColumn("fit", F.lit(True)), "stream_id", "left")
        fit = F.coalesce("fit", F.lit(False))
    rows = ranked.select("channel_id", "stream_id", "ord", F.lit(0).alias("part"), fit.alias("fit"))
    rows = rows.unionByName(assigned.select("channel_id", "stream_id", "ord", F.lit(1).alias("part"), F.lit(False).alias("fit")))
    # one exchange by channel serves all windows; each row of a list is read once
    pair, whole = Window.partitionBy("channel_id", "stream_id"), Window.partitionBy("channel_id")
    rows = rows.repartition(parts, "channel_id").withColumn("held", F.max("part").over(pair) == 1).withColumn("ranks", F.min("part").over(pair) == 0)
    first = F.col("part") == 0
    new = F.col("fit") & ~F.col("held") & first
    nth = F.sum(new.cast("int")).over(whole.orderBy("part", "ord").rowsBetween(Window.unboundedPreceding, 0))
    room = F.greatest(F.lit(most) - F.sum((first & F.col("held")).cast("int")).over(whole), F.lit(0))
    fits = new & (F.lit(most <= 0) | (nth <= room))
    kept = rows.withColumn("kept", F.when(first, F.col("held") | fits).otherwise(~F.col("ranks") & F.lit(not remove))).filter("kept")
    at = F.row_number().over(whole.orderBy("part", "ord"))
    return kept.select("channel_id", at.cast("bigint").alias("position"), "stream_id")


def candidates(assigned: DataFrame, streams: DataFrame, excluded_groups: DataFrame) -> DataFrame:
    """Assigned streams as candidates: repeats dropped but the first, unknown streams and excluded groups left out, step 0."""
    first = assigned.groupBy("channel_id", "stream_id").agg(F.min("ord").alias("ord"))
    known = first.join(streams.select("stream_id", "provider_id", "group_id"), "stream_id")
    return known.join(excluded_groups.select("group_id"), "group_id", "left_anti").withColumn("step", F.lit(0))


def catalogue(assigned: DataFrame, streams: DataFrame, providers: DataFrame) -> DataFrame:
    """Rows of the catalogue with slots from 0; unknown streams leave gaps, unnamed providers go by their id."""
    d = assigned.withColumn("slot", F.col("ord") - 1).join(streams.select("stream_id", "provider_id"), "stream_id")
    d = d.join(providers.select("provider_id", "provider_name"), "provider_id", "left")
    return d.select("channel_id", "slot", "stream_id", "provider_id", F.coalesce("provider_name", F.col("provider_id").cast("string")).alias("provider_name"))


def applied(sent: DataFrame, assigned: DataFrame, remove: bool = False) -> DataFrame:
    """An order as it was sent, then, unless `remove`, what its channel has besides. Channels without a sent order keep theirs."""
    rows = sent.select("channel_id", "stream_id", "ord", F.lit(0).alias("part"))
    rest = assigned.join(sent.select("channel_id", "stream_id").distinct(), ["channel_id", "stream_id"], "left_anti")
    if remove:
        rest = rest.join(sent.select("channel_id").distinct(), "channel_id", "left_anti")
    rows = rows.unionByName(rest.select("channel_id", "stream_id", "ord", F.lit(1).alias("part")))
    at = F.row_number().over(Window.partitionBy("channel_id").orderBy("part", "ord"))
    return rows.select("channel_id", at.cast("bigint").alias("position"), "stream_id")


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """channel_id of the orders (channel_id, position, stream_id) that are not the same, place by place."""
    b = before.select("channel_id", "position", F.col("stream_id").alias("was"))
    d = b.join(after.select("channel_id", "position", "stream_id"), ["channel_id", "position"], "full")
    return d.filter(~F.col("was").eqNullSafe(F.col("stream_id"))).select("channel_id").distinct()


def unassigned(assigned: DataFrame, taken: DataFrame) -> DataFrame:
    """Assigned streams without any occurrence of the pairs that were taken off."""
    return assigned.join(taken.select("channel_id", "stream_id").distinct(), ["channel_id", "stream_id"], "left_anti")


def blocked(blocks: DataFrame, taken: DataFrame, assigned: DataFrame) -> DataFrame:
    """Blocks with those of the taken pairs that were assigned; a pair that is blocked already keeps its instant."""
    real = taken.join(assigned.select("channel_id", "stream_id").distinct(), ["channel_id", "stream_id"], "left_semi")
    return blocks.unionByName(real.select(blocks.columns)).groupBy("channel_id", "stream_id").agg(F.min("blocked_at").alias("blocked_at"))


def assignable(usable: DataFrame, blocks: DataFrame) -> DataFrame:
    """Usable streams of channels that are not blocked there."""
    return usable.join(blocks.select("channel_id", "stream_id"), ["channel_id", "stream_id"], "left_anti")
