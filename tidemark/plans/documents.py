"""Queries that read raw JSON: upstream listings, status bodies and rules documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.registry import query
from tidemark.sources import legacy, rules, upstream


@query(
    ["v_raw_channel"],
    """SELECT provider_id AS channel_id, '00-' || provider_id AS uuid, CASE WHEN provider_id % 3 = 0 THEN 'Seen' ELSE provider_name END AS name, CASE WHEN provider_id % 4 = 0 THEN '' ELSE 't1' END AS tvg_id,
 CASE WHEN provider_id % 2 = 0 THEN 3 ELSE 0 END AS streams, CASE provider_id % 5 WHEN 0 THEN 7 WHEN 1 THEN 8 END::BIGINT AS group_id FROM v_provider""",
)
def upstream_channels(bodies):
    return upstream.channels(bodies).withColumn("streams", F.size("streams"))


@query(
    ["v_raw_stream"],
    """SELECT stream_id, CASE WHEN stream_id % 2 = 0 THEN 'n' ELSE '' END AS name, 'http://s/x' AS url, CASE WHEN stream_id % 3 = 0 THEN 0 ELSE 4 END::BIGINT AS provider_id, CASE WHEN stream_id % 2 = 0 THEN 'h' ELSE '' END AS stream_hash,
 CASE WHEN stream_id % 3 = 0 THEN 0 ELSE 2 END::BIGINT AS viewers, CASE WHEN stream_id % 3 > 0 THEN 9 END::BIGINT AS group_id FROM v_stream WHERE stream_id % 5 > 1""",
)
def upstream_streams(bodies):
    return upstream.streams(bodies)


@query(["v_raw_provider"], "SELECT provider_id AS group_id, CASE WHEN provider_id % 4 = 1 THEN 'P' ELSE provider_id::VARCHAR END AS group_name FROM v_provider")
def upstream_groups(bodies):
    return upstream.groups(bodies)


@query(
    ["v_raw_provider"],
    "SELECT provider_id, CASE WHEN provider_id % 4 = 1 THEN 'P' ELSE provider_id::VARCHAR END AS provider_name, CASE WHEN provider_id % 3 = 2 THEN 6 ELSE 4 END::BIGINT AS max_streams, 'STD' AS account_type FROM v_provider WHERE provider_id % 4 > 0",
)
def upstream_providers(bodies):
    return upstream.providers(bodies)


@query(
    ["v_raw_provider"],
    """SELECT provider_id, i::BIGINT AS profile_id, i::BIGINT - 1 AS ord, CASE i WHEN 1 THEN 'a' ELSE '2' END AS name, i = 1 AS is_default, i = 1 AS is_active, CASE i WHEN 2 THEN 2 END::BIGINT AS max_streams, CASE i WHEN 2 THEN 3 ELSE 0 END::BIGINT AS viewers,
 CASE i WHEN 2 THEN 'x' ELSE '' END AS search, CASE i WHEN 2 THEN 'y' ELSE '' END AS replace FROM v_provider, (SELECT unnest([1, 2]) AS i) WHERE provider_id % 4 > 0""",
)
def upstream_profiles(bodies):
    return upstream.profiles(bodies)


@query(
    ["v_raw_grid"],
    """SELECT 't' || event_id AS tvg_id, CASE i WHEN 0 THEN 1704103200000 + 60000 * (event_id % 60) END AS start_ms, CASE i WHEN 0 THEN 1704106800000 END AS end_ms, CASE i WHEN 0 THEN 'a' ELSE 'b' END AS title, i = 0 AS is_live, i::BIGINT AS ord
 FROM events, (SELECT unnest([0, 2]) AS i)""",
)
def epg_parse(bodies):
    return upstream.programmes(bodies)


@query(
    ["v_raw_status", "v_uuid"],
    """SELECT channel_id * [1, 10, 1, 1, 100][i] AS channel_id, [NULL, NULL, NULL, 7, 8][i]::BIGINT AS profile_id FROM v_uuid, (SELECT unnest([1, 2, 3, 4, 5]) AS i) WHERE channel_id % 3 > 0""",
)
def active_sessions(bodies, uuids):
    return upstream.sessions(bodies, uuids)


@query(
    ["v_raw_rules"],
    """SELECT channel_id, '' AS name, CASE channel_id % 4 WHEN 1 THEN ['a', 'b'] ELSE [] END AS aliases, CASE channel_id % 4 WHEN 2 THEN ['c'] ELSE [] END AS contains, []::VARCHAR[] AS exclude, CASE channel_id % 4 WHEN 2 THEN [1, 3]::BIGINT[] WHEN 3 THEN [2]::BIGINT[] END AS providers,
 0::BIGINT AS step_order, CASE channel_id % 4 WHEN 1 THEN ['AU'] END AS exclude_regions, CASE channel_id % 3 WHEN 1 THEN 1 ELSE 0 END::BIGINT AS patterns FROM v_channel WHERE channel_id % 4 IN (1, 2) OR channel_id % 4 = 3 AND channel_id % 3 = 1""",
)
def rules_load(bodies):
    return rules.rules(bodies)


@query(
    ["v_raw_rules"],
    """SELECT channel_id, i::BIGINT AS ord, CASE WHEN i = 1 THEN '[a' WHEN channel_id % 3 = 0 THEN '(' ELSE '^x' END AS pattern, CASE i WHEN 0 THEN 4 ELSE 0 END::BIGINT AS step, NULL::BIGINT[] AS providers, i = 0 AND channel_id % 3 = 1 AS usable
 FROM v_channel, (SELECT unnest([0, 1]) AS i) WHERE channel_id % 4 > 0 AND (i = 1 OR channel_id % 3 < 2)""",
)
def rule_patterns(bodies):
    return rules.patterns(bodies)


@query(
    ["v_raw_rules"],
    """SELECT channel_id AS group_id, CASE channel_id % 4 WHEN 0 THEN 'never' WHEN 1 THEN 'always' ELSE 'assigned' END AS mode, CASE channel_id % 4 WHEN 2 THEN 9 ELSE 5 END::BIGINT AS grace_minutes, 180::BIGINT AS window_minutes, channel_id % 4 <> 2 AS require_live,
 channel_id % 4 = 2 AS audio_only, false AS measure_only FROM v_channel WHERE channel_id % 4 < 3""",
)
def policies_parse(bodies):
    return rules.policies(bodies)


@query(
    ["v_raw_rules"],
    """SELECT i::BIGINT AS ord, CASE i WHEN 1 THEN 'Auto*' ELSE 'B' END AS pattern, CASE i WHEN 1 THEN 'never' ELSE 'always' END AS mode, 5::BIGINT AS grace_minutes, 180::BIGINT AS window_minutes, i = 1 AS require_live, false AS audio_only, i = 1 AS measure_only, count(*) AS documents
 FROM v_channel, (SELECT unnest([1, 2]) AS i) GROUP BY i""",
)
def group_patterns_parse(bodies):
    d = rules.group_patterns(bodies)
    return d.groupBy(*d.columns).agg(F.count(F.lit(1)).alias("documents"))


@query(["v_group"], "SELECT group_id, ['Brand#1*', 'b', 'c d'] AS globs FROM v_group")
def globs_split(groups):
    return groups.select("group_id", rules.globs(F.lit(" Brand#1*,,b \n c d,")).alias("globs"))


@query(
    ["v_raw_legacy"],
    """SELECT channel_id, name, channel_id % 6 <> 2 AS enabled, CASE channel_id % 6 WHEN 0 THEN ['HBO East', 'HBO West'] WHEN 1 THEN ['Cub[4K]'] WHEN 4 THEN ['Plain'] ELSE [] END AS aliases, CASE channel_id % 6 WHEN 4 THEN [1, 2]::BIGINT[] END AS providers,
 CASE channel_id % 6 WHEN 1 THEN ['AU', 'NZ'] ELSE [] END AS exclude_regions, CASE channel_id % 6 WHEN 2 THEN ['a(b|c)'] WHEN 3 THEN ['[A-Z]x', 'Plain'] ELSE [] END AS kept, channel_id % 6 = 1 AS timeshift, false AS radio,
 CASE channel_id % 6 WHEN 5 THEN 0 WHEN 3 THEN 2 ELSE 1 END::BIGINT AS patterns FROM v_channel""",
)
def legacy_convert(bodies):
    return legacy.converted(legacy.patterns(bodies))


@query(
    ["v_raw_legacy"],
    """SELECT count(*) AS channels, count(*) FILTER (channel_id % 6 IN (0, 1, 4)) AS converted, count(*) FILTER (channel_id % 6 IN (2, 3)) AS kept_regex, CAST(sum(CASE channel_id % 6 WHEN 5 THEN 0 WHEN 3 THEN 2 ELSE 1 END) AS BIGINT) AS patterns,
 true AS exclude_timeshift, false AS exclude_radio FROM v_channel""",
)
def legacy_totals(bodies):
    return legacy.totals(legacy.converted(legacy.patterns(bodies)))


@query(
    ["v_raw_status", "v_uuid"],
    """SELECT 'live' AS kind, (SELECT count(DISTINCT channel_id * m) FROM v_uuid, (SELECT unnest([1, 10, 100]) AS m) WHERE channel_id % 3 > 0) AS channels, false AS idle, false AS probe_failed
 UNION ALL SELECT 'quiet', 0, true, false UNION ALL SELECT 'missing', NULL, false, true UNION ALL SELECT 'broken', NULL, false, true""",
)
def activity_read(bodies, uuids):
    """Who watches, by four readings: sessions, none, no answer, and an answer that cannot be read."""
    found = upstream.sessions(bodies, uuids)
    none = found.filter("false")
    broken = bodies.select(F.lit("<html>").alias("body"))
    cases = {"live": (bodies, found), "quiet": (bodies.select(F.lit('{"count":0,"channels":[]}').alias("body")), none), "missing": (bodies.filter("false"), none), "broken": (broken, none)}
    rows = [upstream.activity(*c).select(F.lit(k).alias("kind"), "*") for k, c in cases.items()]
    return reduce(DataFrame.unionByName, rows)


@query(["v_raw_status", "v_uuid"], "SELECT profile_id, count(*) AS viewers FROM v_uuid, (SELECT unnest([7, 8])::BIGINT AS profile_id) WHERE channel_id % 3 > 0 GROUP BY 1")
def profile_viewers(bodies, uuids):
    return upstream.profile_viewers(upstream.sessions(bodies, uuids))


@query(
    ["v_raw_grid"],
    """SELECT 't' || event_id AS tvg_id, CASE i WHEN 0 THEN 1704103200000 + 60000 * (event_id % 60) END AS start_ms, i::BIGINT AS ord FROM events, (SELECT unnest([0, 2]) AS i)""",
)
def epg_fallback(bodies):
    """Programmes of a second grid, as the first answered with none."""
    first = upstream.programmes(bodies.select(F.lit("[]").alias("body")))
    return upstream.with_fallback(first, upstream.programmes(bodies)).select("tvg_id", "start_ms", "ord")
