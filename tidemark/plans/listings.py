"""Queries that list verdicts, lanes and groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import lanes, verdicts
from tidemark.plans.registry import BEST_SQL, LATEST_SQL, SCORED_SQL, query

@query(["v_verdict_log"], LATEST_SQL + "," + SCORED_SQL + " SELECT usable, alive, black, count(*) AS verdicts FROM scored GROUP BY ALL")
def usable_flags(log):
    return verdicts.scored(verdicts.latest(log)).groupBy("usable", "alive", "black").agg(F.count(F.lit(1)).alias("verdicts"))


LANE_VIEWERS = "SELECT p.provider_id, max_streams, coalesce(v, 0) AS v FROM v_provider p LEFT JOIN (SELECT provider_id, sum(viewers) AS v FROM v_profile GROUP BY 1) f ON f.provider_id = p.provider_id"


def _viewed(providers, profiles):
    seen = profiles.groupBy("provider_id").agg(F.sum("viewers").alias("viewers"))
    return providers.select("provider_id", F.col("max_streams").alias("limit")).join(seen, "provider_id", "left")


@query(["v_provider", "v_profile"], f"""SELECT provider_id, max_streams AS "limit", CAST(max_streams - v - 1 AS BIGINT) AS free FROM ({LANE_VIEWERS}) WHERE max_streams - v - 1 > 0""")
def lane_limits(providers, profiles):
    """What each lane may start while somebody watches, with a reserve of one."""
    return lanes.limits(_viewed(providers, profiles), False, 1).select("provider_id", "limit", "free")


@query(["v_provider", "v_profile"], f"""SELECT provider_id, max_streams AS "limit", CAST(max_streams - v AS BIGINT) AS free FROM ({LANE_VIEWERS}) WHERE max_streams > v""")
def lane_limits_idle(providers, profiles):
    d = _viewed(providers, profiles)
    return lanes.limits(d, True, 1, pause=True).unionByName(lanes.limits(d, False, 1, pause=True)).select("provider_id", "limit", "free")


@query(["v_provider"], """SELECT provider_id, greatest(max_streams - 1 - CASE WHEN provider_id % 2 = 0 THEN 1 ELSE 0 END, 0) AS "limit" FROM v_provider""")
def lane_shrunk(providers):
    return providers.select("provider_id", lanes.shrunk(F.col("max_streams"), True, 1, F.col("provider_id") % 2 == 0).alias("limit"))


@query(["v_event_channel"], "SELECT group_id, group_name, count(*) AS channels FROM v_event_channel GROUP BY 1, 2")
def user_groups(channels):
    return channels.groupBy("group_id", "group_name").agg(F.count(F.lit(1)).alias("channels"))


@query(
    ["v_assigned", "v_ranked", "v_stream", "v_provider", "v_verdict_log"],
    BEST_SQL + """ SELECT r.stream_id, r.ord AS place, a.ord AS current_place, s.name, p.provider_name, b.score, b.usable FROM v_ranked r LEFT JOIN (SELECT channel_id, stream_id, min(ord) AS ord FROM v_assigned GROUP BY 1, 2) a ON a.channel_id = r.channel_id AND a.stream_id = r.stream_id
 LEFT JOIN v_stream s ON s.stream_id = r.stream_id LEFT JOIN v_provider p ON p.provider_id = s.provider_id LEFT JOIN best b ON b.stream_id = r.stream_id WHERE r.channel_id = 7 ORDER BY r.ord LIMIT 300""",
)
def preview_channel(assigned, ranked, streams, providers, log):
    """The first 300 rows of one channel's new order beside its current one (a report with a top-k)."""
    now = assigned.filter("channel_id = 7").groupBy("stream_id").agg(F.min("ord").alias("current_place"))
    d = ranked.filter("channel_id = 7").join(now, "stream_id", "left").join(streams.select("stream_id", "name", "provider_id"), "stream_id", "left")
    d = d.join(providers.select("provider_id", "provider_name"), "provider_id", "left")
    d = d.join(verdicts.best_of_stream(verdicts.scored(verdicts.latest(log))).select("stream_id", "score", "usable"), "stream_id", "left")
    return d.orderBy("ord").limit(300).select("stream_id", F.col("ord").alias("place"), "current_place", "name", "provider_name", "score", "usable")
