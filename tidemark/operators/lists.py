"""What lists of groups, channels and streams show: filters, totals, choices and unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.texts import RANKS_ASSIGNED
from tidemark.operators.gate import glob

# channels: channel_id, name, group_id, group_name, mode, has_rule, assignment_only, assigned, matched, regex_count


def holds(text: Column, needle: str) -> Column:
    """Whether a text holds a trimmed needle, whatever the case; an empty one is in all."""
    return F.contains(F.lower(text), F.lit(needle.strip().lower()))


def probeable() -> Column:
    """Whether a channel may be probed under its group's mode: by a rule, or by its assignment where that is ranked."""
    own = F.col("has_rule") | F.col("assignment_only") | F.col("mode").isin(RANKS_ASSIGNED) & (F.col("assigned") > 0)
    return (F.col("mode") != "never") & own


def listed(channels: DataFrame, facet: str = "", needle: str = "", disabled: bool = False) -> DataFrame:
    """Channels of a facet (regex, noregex, nomatch or all) whose name holds the needle, by name."""
    keep = {"regex": F.col("regex_count") > 0, "noregex": F.col("regex_count") == 0, "nomatch": (F.col("mode") != "never") & F.col("has_rule") & (F.col("matched") == 0)}.get(facet, F.lit(True))
    return channels.filter(F.lit(disabled) | (F.col("mode") != "never")).filter(keep & holds(F.col("name"), needle)).orderBy("name", "channel_id")


def group_rows(channels: DataFrame) -> DataFrame:
    """Groups with their channels, those with a rule, those matched, and what is said of their coverage."""
    d = channels.groupBy("group_id", "group_name", "mode").agg(
        F.count(F.lit(1)).alias("channels"), F.count_if("has_rule").alias("ruled"), F.count_if(F.col("matched") > 0).alias("matched_channels"),
        F.sum("matched").cast("bigint").alias("links"), F.count_if(probeable()).alias("probeable"),
    )
    ranked = F.col("mode").isin(RANKS_ASSIGNED)
    part = F.when(ranked, F.col("matched_channels")).otherwise(F.col("ruled"))
    said = F.concat(part.cast("string"), F.lit("/"), F.col("channels").cast("string"), F.when(ranked, " ranked").otherwise(" ruled"))
    return d.withColumn("coverage", said)


def visible_groups(groups: DataFrame, needle: str = "", disabled: bool = False) -> DataFrame:
    return groups.filter((F.lit(disabled) | (F.col("mode") != "never")) & holds(F.col("group_name"), needle))


def visible_stream_groups(groups: DataFrame, needle: str = "", everything: bool = False) -> DataFrame:
    """Groups with a claim or switched off; all of them with a needle or on request."""
    rows = groups.filter(holds(F.col("group_name"), needle))
    return rows if everything or needle.strip() else rows.filter((F.col("claimed") > 0) | F.col("excluded"))


def visible_buckets(buckets: DataFrame, min_samples: int, audio: bool = False, thin: bool = False) -> DataFrame:
    return buckets.filter((F.lit(audio) | ~F.col("audio_only")) & (F.lit(thin) | (F.col("samples") >= min_samples)))


def totals(channels: DataFrame) -> DataFrame:
    """Channels with a rule, in switched-off groups, with a rule that matches nothing, and with patterns."""
    on = F.col("mode") != "never"
    return channels.agg(
        F.count_if(on & F.col("has_rule")).alias("managed"), F.count_if(~on).alias("excluded"),
        F.count_if(on & F.col("has_rule") & (F.col("matched") == 0)).alias("gaps"), F.count_if(on & (F.col("regex_count") > 0)).alias("regex"),
    )


def affected(channels: DataFrame, pattern: str) -> DataFrame:
    """Groups that a new pattern names, with their channels."""
    return channels.filter(glob(F.col("group_name"), pattern)).groupBy("group_id", "group_name").agg(F.count(F.lit(1)).alias("channels"))


def order_to_apply(drop_unclaimed: bool) -> Column:
    """The order that an apply writes: without the unclaimed, or the worker's, or what is kept."""
    return F.col("drop_order") if drop_unclaimed else F.coalesce("worker_order", "kept")


def pending(drop_unclaimed: bool) -> list[Column]:
    """Whether a drop is outstanding, and whether an apply would change nothing."""
    drop = F.lit(drop_unclaimed) & (F.col("unclaimed") > 0)
    return [drop.alias("drop_pending"), (F.col("identical") & ~drop).alias("nothing_to_change")]


def unified(assigned: DataFrame, matched: DataFrame) -> DataFrame:
    """Each channel's assigned streams in their order, then matched ones that it doesn't carry; `place` counts from 0, orphaned ones match nothing."""
    key = ["channel_id", "stream_id"]
    hits = matched.select(*key).distinct().withColumn("hit", F.lit(True))
    now = assigned.join(hits, key, "left").select(*key, F.lit(0).alias("part"), "ord", F.col("hit").isNull().alias("orphaned"))
    new = matched.join(assigned.select(*key).distinct(), key, "left_anti").select(*key, F.lit(1).alias("part"), "ord", F.lit(False).alias("orphaned"))
    place = F.row_number().over(Window.partitionBy("channel_id").orderBy("part", "ord", "stream_id")) - 1
    return now.unionByName(new).select(*key, place.cast("bigint").alias("place"), (F.col("part") == 1).alias("new"), "orphaned")


def sorted_buckets(buckets: DataFrame, by: list[str]) -> DataFrame:
    """Buckets with their place within `by`: effective bitrate first, then samples."""
    w = Window.partitionBy(*by).orderBy(F.desc("effective_kbps"), F.desc("samples"), "provider_id", "group_id", "tier", "audio_only")
    return buckets.withColumn("place", F.row_number().over(w).cast("bigint"))


def explained(gated: DataFrame, rules: DataFrame) -> DataFrame:
    """Gated channels with what is said of their verdict, whether they have a rule, and whether they would be probed."""
    d = gated.join(rules.select("channel_id").distinct().withColumn("ruled", F.lit(True)), "channel_id", "left")
    ruled = F.col("ruled").isNotNull()
    return d.select(*gated.columns, ruled.alias("has_rule"), (ruled & F.col("allowed")).alias("would_probe"))


def dead_rules(channels: DataFrame, rules: DataFrame, claims: DataFrame) -> DataFrame:
    """For each group: channels, those with a rule, and those of them whose rule claims nothing."""
    d = channels.join(rules.select("channel_id").distinct().withColumn("ruled", F.lit(1)), "channel_id", "left")
    d = d.join(claims.select("channel_id").distinct().withColumn("claims", F.lit(1)), "channel_id", "left")
    zero = F.col("ruled").isNotNull() & F.col("claims").isNull()
    return d.groupBy("group_id").agg(F.count(F.lit(1)).alias("channels"), F.count("ruled").alias("ruled"), F.count_if(zero).alias("zero"))


def state_rollup(channels: DataFrame, policies: DataFrame, claims: DataFrame, candidates: DataFrame, marks: DataFrame) -> DataFrame:
    """Groups as the state page shows them: mode, channels, ruled, matched_channels, links, assigned, refresh_queued_at.

    channels: channel_id, group_id, has_rule, assigned. A channel with a rule is matched by what the rule claims (claims: channel_id, stream_id); one without, in a group that ranks by
    assignment, by what it is assigned (candidates: channel_id, stream_id); any other by nothing. A group without a policy is always on.
    """
    per = lambda d, name: d.select("channel_id", "stream_id").distinct().groupBy("channel_id").agg(F.count(F.lit(1)).alias(name))
    d = channels.join(policies.select("group_id", "mode"), "group_id", "left").withColumn("mode", F.coalesce("mode", F.lit("always")))
    d = d.join(per(claims, "claimed"), "channel_id", "left").join(per(candidates, "ready"), "channel_id", "left")
    matched = F.coalesce(F.when(F.col("has_rule"), F.col("claimed")).when(F.col("mode").isin(RANKS_ASSIGNED), F.col("ready")), F.lit(0))
    out = d.withColumn("matched", matched).groupBy("group_id", "mode").agg(
        F.count(F.lit(1)).alias("channels"), F.count_if("has_rule").alias("ruled"), F.count_if(F.col("matched") > 0).alias("matched_channels"), F.sum("matched").alias("links"),
        F.sum("assigned").cast("bigint").alias("assigned"),
    )
    queued = marks.groupBy("group_id").agg(F.max("forced_at").alias("refresh_queued_at"))
    return out.join(queued, "group_id", "left")
