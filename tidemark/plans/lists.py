"""Queries about what lists show."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import names, texts
from tidemark.operators import documents, gate, lists, matching, metrics, quality
from tidemark.plans.matching import RULES_SQL, VIEWS, _matched
from tidemark.plans.passes import GATE_SQL, PATTERNS as POLICY_PATTERNS
from tidemark.plans.registry import BUCKETS_SQL, D, EPG_NOW, query
from tidemark.sources import exports

RANKED = "mode IN ('assigned', 'after_epg_start')"
PROBEABLE = f"(mode <> 'never' AND (has_rule OR assignment_only OR {RANKED} AND assigned > 0))"


@query(["v_listed"], f"SELECT group_id, channel_id FROM v_listed WHERE {PROBEABLE}")
def group_probeable(channels):
    return channels.filter(lists.probeable()).select("group_id", "channel_id")


@query(["v_listed"], "SELECT channel_id, name, group_name FROM v_listed WHERE mode <> 'never' AND has_rule AND matched = 0 AND contains(name, '1')")
def channels_listed(channels):
    return lists.listed(channels, "nomatch", " 1 ").select("channel_id", "name", "group_name")


@query(
    ["v_listed"],
    f"""SELECT group_id, group_name, mode, count(*) AS channels, count(*) FILTER (has_rule) AS ruled, count(*) FILTER (matched > 0) AS matched_channels, CAST(sum(matched) AS BIGINT) AS links, count(*) FILTER ({PROBEABLE}) AS probeable,
 CASE WHEN {RANKED} THEN count(*) FILTER (matched > 0) || '/' || count(*) || ' ranked' ELSE count(*) FILTER (has_rule) || '/' || count(*) || ' ruled' END AS coverage FROM v_listed WHERE mode <> 'never' AND contains(lower(group_name), 'd#2') GROUP BY 1, 2, 3""",
)
def groups_listed(channels):
    return lists.visible_groups(lists.group_rows(channels), "D#2 ")


@query(
    ["v_listed"],
    "SELECT group_id, group_name, CAST(sum(matched) AS BIGINT) AS claimed, bool_or(mode = 'never') AS excluded FROM v_listed GROUP BY 1, 2 HAVING sum(matched) > 20 OR bool_or(mode = 'never')",
)
def stream_groups_listed(channels):
    d = channels.groupBy("group_id", "group_name").agg(F.sum("matched").cast("bigint").alias("claimed"), F.bool_or(F.col("mode") == "never").alias("excluded"))
    kept = d.withColumn("all_claims", F.col("claimed")).withColumn("claimed", F.when(F.col("claimed") > 20, F.col("claimed")).otherwise(0))
    return lists.visible_stream_groups(kept).select("group_id", "group_name", F.col("all_claims").alias("claimed"), "excluded")


@query(
    ["v_listed"],
    "SELECT count(*) FILTER (mode <> 'never' AND has_rule) AS managed, count(*) FILTER (mode = 'never') AS excluded, count(*) FILTER (mode <> 'never' AND has_rule AND matched = 0) AS gaps, count(*) FILTER (mode <> 'never' AND regex_count > 0) AS regex FROM v_listed",
)
def list_totals(channels):
    return lists.totals(channels)


@query(["v_event_channel"], "SELECT group_id, group_name, count(*) AS channels FROM v_event_channel WHERE group_name ILIKE 'Brand#_2' GROUP BY 1, 2")
def pattern_affected(channels):
    return lists.affected(channels, "brand#?2")


@query(
    ["v_group"],
    """SELECT group_id, CASE WHEN group_id % 2 = 0 THEN [group_id] WHEN group_id % 3 = 0 THEN [group_id + 2, group_id] ELSE [group_id + 1] END AS "order", group_id % 2 = 0 AND group_id % 5 > 0 AS drop_pending, group_id % 7 = 0 AND NOT (group_id % 2 = 0 AND group_id % 5 > 0) AS nothing_to_change FROM v_group""",
)
def orders_to_apply(groups):
    i = F.col("group_id")
    d = groups.select("group_id", F.array(i).alias("drop_order"), F.when(i % 3 == 0, F.array(i + 2, i)).alias("worker_order"), F.array(i + 1).alias("kept"), (i % 5).alias("unclaimed"), (i % 7 == 0).alias("identical"))
    one = lambda rows, drop: rows.select("group_id", lists.order_to_apply(drop).alias("order"), *lists.pending(drop))
    return one(d.filter(i % 2 == 0), True).unionByName(one(d.filter(i % 2 != 0), False))


@query(VIEWS, f"WITH {RULES_SQL} SELECT DISTINCT stream_id FROM passed WHERE (channel_id, stream_id) NOT IN (SELECT (channel_id, stream_id) FROM out)")
def claimed_streams(channels, streams, groups):
    return _matched(channels, streams, groups).select("stream_id").distinct()


@query(
    ["v_assigned", "v_ranked"],
    """WITH u AS (SELECT channel_id, stream_id, ord, 0 AS part, (channel_id, stream_id) NOT IN (SELECT (channel_id, stream_id) FROM v_ranked) AS orphaned FROM v_assigned
 UNION ALL SELECT channel_id, stream_id, ord, 1, false FROM v_ranked r WHERE NOT EXISTS (SELECT 1 FROM v_assigned a WHERE a.channel_id = r.channel_id AND a.stream_id = r.stream_id))
 SELECT channel_id, stream_id, row_number() OVER (PARTITION BY channel_id ORDER BY part, ord, stream_id) - 1 AS place, part = 1 AS new, orphaned FROM u""",
)
def preview_unified(assigned, ranked):
    return lists.unified(assigned, ranked)


@query(
    ["v_sample"],
    f"WITH b AS ({BUCKETS_SQL.strip()}) SELECT provider_id, group_id, tier, samples, effective_kbps, row_number() OVER (PARTITION BY provider_id ORDER BY effective_kbps DESC, samples DESC, group_id, tier, audio_only) AS place FROM b WHERE NOT audio_only AND samples >= 3",
)
def buckets_sorted(samples):
    d = lists.sorted_buckets(lists.visible_buckets(quality.buckets(samples), 3), ["provider_id"])
    return d.select("provider_id", "group_id", "tier", "samples", "effective_kbps", "place")


@query(
    ["v_event_channel", "v_policy", "v_epg"],
    GATE_SQL + " SELECT channel_id, mode, allowed, reason || CASE WHEN coalesce(detail, '') <> '' THEN ' — ' || detail ELSE '' END AS verdict, channel_id % 3 = 0 AS has_rule, channel_id % 3 = 0 AND allowed AS would_probe FROM verdict",
)
def eligibility_explained(channels, policies, epg):
    gated = gate.gated(gate.with_policy(channels, policies, POLICY_PATTERNS), epg, EPG_NOW)
    d = lists.explained(gated, channels.filter("channel_id % 3 = 0"))
    return d.select("channel_id", "mode", "allowed", texts.described(F.col("reason"), F.col("detail")).alias("verdict"), "has_rule", "would_probe")


@query(
    VIEWS,
    f"""WITH {RULES_SQL}, m AS (SELECT DISTINCT channel_id FROM passed WHERE (channel_id, stream_id) NOT IN (SELECT (channel_id, stream_id) FROM out))
 SELECT channel_id % 25 AS group_id, count(*) AS channels, count(*) AS ruled, count(*) FILTER (channel_id NOT IN (SELECT channel_id FROM m)) AS zero FROM v_channel GROUP BY 1""",
)
def groups_matching_nothing(channels, streams, groups):
    placed = channels.select("channel_id", (F.col("channel_id") % 25).alias("group_id"))
    return lists.dead_rules(placed, channels, _matched(channels, streams, groups))


@query(
    ["v_option"],
    f"""SELECT option_id, CASE WHEN option_id % 7 = 0 THEN 'disabled' WHEN option_id % 5 = 0 THEN 'absent' WHEN option_id * 2000 < 120000 THEN 'active' ELSE 'stale' END AS worker, CASE WHEN option_id % 5 > 0 THEN option_id * 2 END AS heartbeat_age_seconds,
 CASE WHEN option_id % 5 > 0 AND option_id * 2000 < 120000 THEN 1 ELSE 0 END AS running, CASE WHEN option_id % 3 = 0 THEN CAST(floor(option_id * 700 / {D(1000)} + {D(0.5)}) AS BIGINT) WHEN option_id % 3 = 1 THEN CAST(floor(option_id * 900 / {D(1000)} + {D(0.5)}) AS BIGINT) END AS oldest_age_seconds,
 CASE WHEN option_id % 3 = 0 THEN option_id * 700 > 60000 WHEN option_id % 3 = 1 THEN option_id * 900 > 60000 END AS breaching FROM v_option""",
)
def worker_health(options):
    i = F.col("option_id")
    now = 1_000_000_000
    d = options.select("option_id", F.when(i % 5 != 0, F.lit(now) - i * 2000).alias("heartbeat"), (i % 7 != 0).alias("enabled"), F.when(i % 3 == 0, F.lit(now) - i * 700).alias("managed_oldest"), F.when(i % 3 < 2, F.lit(now) - i * 900).alias("cache_oldest"))
    status = metrics.worker_status(F.col("heartbeat"), F.col("enabled"), now)
    fresh = metrics.freshness(F.col("managed_oldest"), F.col("cache_oldest"), now, 60_000)
    return d.select("option_id", *status, *fresh)


@query(
    ["v_option"],
    """SELECT option_id, CASE WHEN option_id % 4 = 1 THEN 'provider' WHEN option_id % 4 = 2 THEN 'alias' ELSE 'quality' END AS mode, ['b', CAST(option_id AS VARCHAR)] AS provider_preference, CASE WHEN option_id % 3 = 0 THEN option_id * 0.5::DOUBLE ELSE 0::DOUBLE END AS bitrate FROM v_option""",
)
def orderings_stored(options):
    i = F.col("option_id")
    mode = F.when(i % 4 == 1, "provider").when(i % 4 == 2, "alias").when(i % 4 == 3, "odd")
    names = F.array(F.lit(" b"), F.lit(" "), i.cast("string"), F.lit("b "))
    weight = F.when(i % 3 == 0, i * 0.5).when(i % 3 == 1, F.lit(float("inf")))
    return options.select("option_id", *documents.ordering(mode, names, {"bitrate": weight}))


@query(
    ["v_channel"],
    """WITH c AS (SELECT channel_id AS i, channel_id % 3 > 0 AS ruled, channel_id % 2 = 0 AS edited FROM v_channel)
 SELECT i AS channel_id, CASE WHEN ruled THEN i % 5 > 0 ELSE true END AS enabled, CASE WHEN edited THEN ['n' || i] ELSE ['o' || i, ' '] END AS aliases, CASE WHEN edited THEN [] ELSE ['c'] END AS contains,
 CASE WHEN edited AND i % 4 = 0 THEN CASE WHEN i % 8 = 0 THEN [i, 2] END WHEN ruled THEN [i] END AS providers FROM c WHERE ruled OR edited""",
)
def rules_edited(channels):
    """Rules of two thirds of the channels after edits of each second one; each edit comes twice and the later one counts."""
    i = F.col("channel_id")
    text = lambda prefix: F.concat(F.lit(prefix), i.cast("string"))
    none, blank = F.array().cast("array<string>"), F.lit(" ")
    old = channels.filter(i % 3 > 0).select("channel_id", (i % 5 > 0).alias("enabled"), F.array(text("o"), blank).alias("aliases"), F.array(F.lit("c")).alias("contains"), none.alias("exclude"), F.array(i).alias("providers"))
    scope = F.when(i % 8 == 0, F.array(i, F.lit(2).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    edit = lambda ord_, name: channels.filter(i % 2 == 0).select("channel_id", F.lit(ord_).alias("ord"), F.array(text(name), blank, text(name)).alias("aliases"), none.alias("contains"), none.alias("exclude"), scope.alias("providers"), (i % 4 == 0).alias("providers_given"))
    return documents.rules_edited(old, edit(2, "n").unionByName(edit(1, "x"))).drop("exclude")


@query(
    VIEWS,
    f"""WITH {RULES_SQL}, m AS (SELECT DISTINCT channel_id, stream_id FROM passed WHERE (channel_id, stream_id) NOT IN (SELECT (channel_id, stream_id) FROM out)), t AS (SELECT * FROM m WHERE stream_id % 5 > 0 OR channel_id % 2 = 0),
 j AS (SELECT m.channel_id, count(*) AS ours, count(t.stream_id) AS shared FROM m LEFT JOIN t ON t.channel_id = m.channel_id AND t.stream_id = m.stream_id GROUP BY 1)
 SELECT channel_id, CASE WHEN shared > 0 THEN 'both' ELSE 'ours' END AS found, ours, shared AS theirs, shared, ours = shared AS same FROM j""",
)
def claims_cross_checked(channels, streams, groups):
    claims = _matched(channels, streams, groups).select("channel_id", "stream_id")
    return exports.cross_checked(claims, claims.filter("stream_id % 5 > 0 OR channel_id % 2 = 0"))


@query(
    VIEWS,
    f"""WITH {RULES_SQL}, m AS (SELECT DISTINCT channel_id, stream_id FROM passed WHERE (channel_id, stream_id) NOT IN (SELECT (channel_id, stream_id) FROM out)),
 f AS (SELECT stream_id, CASE WHEN k = 6 THEN replace(p_name, ' ', '') || '+1' ELSE replace(p_name, ' ', '') END AS key FROM p WHERE contains(lower(name), 'ring'))
 SELECT key, count(DISTINCT f.stream_id) AS streams, count(DISTINCT m.stream_id) AS claimed, count(DISTINCT channel_id) AS claimers FROM f LEFT JOIN m ON m.stream_id = f.stream_id GROUP BY 1""",
)
def search_claimed(channels, streams, groups):
    """Search results by key with how many of their streams are claimed, and by how many channels."""
    found = matching.having(matching.Catalogue.of(streams, names.country_codes(streams.sparkSession), "v_stream"), "ring").select("key", "stream_id")
    return matching.claimers(found, _matched(channels, streams, groups))
