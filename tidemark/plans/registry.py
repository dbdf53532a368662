"""Registered queries of the engine and the DuckDB SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import quality, runs, verdicts
from tidemark.sources.fixtures import view, with_views

NOW, EPG_NOW = 789_300_000_000, 1_705_000_000_000
TTL = {"live": 86_400_000, "dead": 10_800_000, "most": 86_400_000, "unknown": 3_600_000}
SCOPE = (True, ["Brand#3*"], ["Brand#1*"])
RUNS_SINCE, ACTIVITY_START, ACTIVITY_DAYS = 820_000_000_000, 788_918_400_000, 2400

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(views: list[str], sql: str) -> Callable:
    """Registers a function from the views' DataFrames under its name, with SQL over the same views; empty where SQL can't say it."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*[view(spark, sf_dir, v) for v in views])
        if not sql:
            return f
        head, tail = with_views(views, "duckdb"), sql.strip()
        SQL[f.__name__] = head + (",\n" + tail[5:] if tail.startswith("WITH ") else "\n" + tail)
        return f

    return add


RATED = "alive AND measured AND NOT black AND bitrate_kbps > 0"
PICK = "CASE WHEN len({a}) = 0 THEN 0 ELSE {a}[least(len({a}) - 1, CAST(floor(len({a}) * CAST({f} AS DOUBLE)) AS BIGINT)) + 1] END"
BUCKETS_SQL = f"""
WITH g AS (SELECT provider_id, group_id, tier, audio_only, count(*) AS samples, count(*) FILTER (alive) AS n_alive,
  count(*) FILTER (alive AND black) AS n_black, max(sampled_at) AS last_sampled_at,
  coalesce(list_sort(list(bitrate_kbps) FILTER ({RATED})), []) AS r, coalesce(list_sort(list(height) FILTER (alive AND height > 0)), []) AS h
 FROM v_sample GROUP BY ALL),
 b AS (SELECT *, CAST(n_alive AS DOUBLE) / samples AS alive_rate, CASE WHEN n_alive = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(n_black AS DOUBLE) / n_alive END AS black_rate,
  CAST({PICK.format(a="r", f=0.5)} AS BIGINT) AS median_kbps, CAST({PICK.format(a="r", f=0.9)} AS BIGINT) AS p90_kbps,
  CAST({PICK.format(a="h", f=0.5)} AS BIGINT) AS median_height FROM g)
SELECT provider_id, group_id, tier, audio_only, samples, alive_rate, black_rate, last_sampled_at, CAST(len(r) AS BIGINT) AS measured_samples,
 median_kbps, p90_kbps, median_height, CAST(floor(median_kbps * alive_rate * (1 - black_rate) + CAST(0.5 AS DOUBLE)) AS BIGINT) AS effective_kbps FROM b
"""


@query(["v_sample"], BUCKETS_SQL)
def quality_buckets(samples):
    return quality.buckets(samples)


@query(
    ["v_sample"],
    """SELECT CASE WHEN group_name LIKE 'Brand#1%' THEN 'excluded' WHEN group_name LIKE 'Brand#3%' THEN 'in' WHEN policy_mode = '' THEN 'unrecorded'
 WHEN policy_mode IN ('after_epg_start', 'assigned') THEN 'in' ELSE 'not-event' END AS verdict, count(*) AS samples FROM v_sample GROUP BY 1""",
)
def quality_scope_summary(samples):
    return samples.groupBy(quality.scope_verdict(*SCOPE, F.col("group_name"), F.col("policy_mode")).alias("verdict")).agg(F.count(F.lit(1)).alias("samples"))


@query(["v_tier"], "SELECT tier, count(*) AS streams FROM v_tier GROUP BY tier")
def tier_counts(streams):
    return streams.groupBy("tier").agg(F.count(F.lit(1)).alias("streams"))


@query(
    ["v_sample"],
    """SELECT provider_id, tier, policy_mode, stream_id, sampled_at, l_orderkey, l_linenumber, tie FROM v_sample
 QUALIFY row_number() OVER (PARTITION BY provider_id, tier, policy_mode ORDER BY sampled_at DESC, l_orderkey DESC, l_linenumber DESC, tie DESC) <= 40""",
)
def samples_trim(samples):
    return quality.trimmed(samples, 40).select("provider_id", "tier", "policy_mode", "stream_id", "sampled_at", "l_orderkey", "l_linenumber", "tie")


@query(["v_sample"], "SELECT count(*) AS samples, count(*) FILTER (stream_name <> '') AS named, count(*) FILTER (audio_only) AS audio_only FROM v_sample")
def samples_named_counts(samples):
    return samples.agg(F.count(F.lit(1)).alias("samples"), F.count_if(F.col("stream_name") != "").alias("named"), F.count_if("audio_only").alias("audio_only"))


LATEST_SQL = """
WITH x AS (SELECT *, sum(CASE WHEN alive THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id, stream_hash, variant_id ORDER BY probed_at, l_orderkey, l_linenumber, tie ROWS UNBOUNDED PRECEDING) AS isl FROM v_verdict_log),
 y AS (SELECT *, CAST(sum(CASE WHEN alive THEN 0 ELSE 1 END) OVER (PARTITION BY stream_id, stream_hash, variant_id, isl ORDER BY probed_at, l_orderkey, l_linenumber, tie ROWS UNBOUNDED PRECEDING) AS BIGINT) AS dead_streak FROM x),
 latest AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY stream_id, stream_hash, variant_id ORDER BY probed_at DESC, l_orderkey DESC, l_linenumber DESC, tie DESC) = 1)"""
TTL_SQL = f"""CASE WHEN NOT alive THEN least(CAST(pow(2, least(greatest(dead_streak - 1, 0), 30)) AS BIGINT) * {TTL["dead"]}, {TTL["most"]})
 WHEN bitrate_kbps <= 0 THEN {min(TTL["live"], TTL["unknown"])} ELSE {TTL["live"]} END"""
D = "CAST({} AS DOUBLE)".format
SCORED_SQL = f"""
 scored AS (SELECT *, alive AND NOT black AND (bitrate_kbps <= 0 OR bitrate_kbps >= 500) AS usable,
 CASE WHEN alive AND NOT black AND (bitrate_kbps <= 0 OR bitrate_kbps >= 500) THEN floor(least(((((
  least(height / {D(2160)}, 1) * {D(0.35)} + least(bitrate_kbps / {D(12000)}, 1) * {D(0.4)}) + least(fps / {D(60)}, 1) * {D(0.15)})
  + CASE video_codec WHEN 'hevc' THEN {D(1)} WHEN 'h264' THEN {D(0.5)} ELSE {D(0.25)} END * {D(0.1)})
  + least(audio_channels / {D(6)}, 1) * {D(0.75)} * {D(0)}) / {D(1)}, 1) * 10000 + {D(0.5)}) / 10000 ELSE {D(0)} END AS score FROM latest)"""


@query(["v_verdict_log"], LATEST_SQL + " SELECT dead_streak, count(*) AS verdicts FROM latest GROUP BY 1")
def cache_dead_streak(log):
    return verdicts.latest(log).groupBy("dead_streak").agg(F.count(F.lit(1)).alias("verdicts"))


@query(
    ["v_verdict_log"],
    LATEST_SQL + """ SELECT count(*) AS streams, count(*) FILTER (alive = 1) AS alive, min(seen) AS oldest FROM
 (SELECT stream_id, max(CAST(alive AS INT)) AS alive, min(probed_at) AS seen FROM latest GROUP BY 1)""",
)
def cache_stats(log):
    per = verdicts.latest(log).groupBy("stream_id").agg(F.max(F.col("alive").cast("int")).alias("alive"), F.min("probed_at").alias("at"))
    return per.agg(F.count(F.lit(1)).alias("streams"), F.count_if(F.col("alive") == 1).alias("alive"), F.min("at").alias("oldest"))


@query(
    ["v_verdict_log"],
    LATEST_SQL + f""", due AS (SELECT stream_id, max(CAST(alive AS INT)) AS alive, min(probed_at) AS seen, min(CASE WHEN probed_at <= 0 THEN {NOW} ELSE probed_at + {TTL_SQL} END) AS due FROM latest GROUP BY 1)
 SELECT count(*) AS total, count(*) FILTER (alive = 1) AS alive, min(seen) AS oldest, max(seen) AS newest, min(due) AS next_due, count(*) FILTER (due <= {NOW}) AS due,
 count(*) FILTER ({NOW} - seen < 3600000) AS hour, count(*) FILTER ({NOW} - seen >= 3600000 AND {NOW} - seen < 21600000) AS six_hours,
 count(*) FILTER ({NOW} - seen >= 21600000 AND {NOW} - seen < 86400000) AS day, count(*) FILTER ({NOW} - seen >= 86400000) AS older FROM due""",
)
def cache_health(log):
    return verdicts.cache_health(verdicts.latest(log), NOW, 0, **TTL)


@query(["v_verdict_log"], LATEST_SQL + f" SELECT stream_id, stream_hash, variant_id, dead_streak, probed_at + {TTL_SQL} AS due_at FROM latest")
def cache_ttl_due(log):
    v = verdicts.latest(log)
    return v.select("stream_id", "stream_hash", "variant_id", "dead_streak", verdicts.due_at(v, NOW, 0, **TTL).alias("due_at"))


@query(["v_verdict_log"], LATEST_SQL + "," + SCORED_SQL + " SELECT stream_id, stream_hash, variant_id, usable, score FROM scored")
def score_streams(log):
    return verdicts.scored(verdicts.latest(log)).select("stream_id", "stream_hash", "variant_id", "usable", "score")


BEST_SQL = LATEST_SQL + "," + SCORED_SQL + """, best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY stream_id
 ORDER BY usable DESC, (bitrate_kbps > 0) DESC, score DESC, variant_id, stream_hash) = 1)"""


@query(["v_verdict_log"], BEST_SQL + " SELECT stream_id, variant_id, stream_hash, usable, score FROM best")
def cache_best_verdict(log):
    return verdicts.best_of_stream(verdicts.scored(verdicts.latest(log))).select("stream_id", "variant_id", "stream_hash", "usable", "score")


@query(
    ["v_verdict_log", "v_stream"],
    BEST_SQL + """ SELECT group_id, stream_id, row_number() OVER (PARTITION BY group_id ORDER BY usable DESC, (bitrate_kbps > 0) DESC, score DESC, stream_id) AS place
 FROM best JOIN v_stream USING (stream_id)""",
)
def rank_quality(log, streams):
    best = verdicts.best_of_stream(verdicts.scored(verdicts.latest(log))).join(streams.select("stream_id", "group_id"), "stream_id")
    return verdicts.ranked(best, ["group_id"], []).select("group_id", "stream_id", "place")


@query(
    ["v_verdict_log", "v_stream"],
    BEST_SQL + """ SELECT group_id, stream_id, row_number() OVER (PARTITION BY group_id ORDER BY usable DESC,
 CASE provider_id WHEN 3 THEN 0 WHEN 1 THEN 1 ELSE 2 END, (bitrate_kbps > 0) DESC, score DESC, stream_id) AS place FROM best JOIN v_stream USING (stream_id)""",
)
def rank_provider(log, streams):
    best = verdicts.best_of_stream(verdicts.scored(verdicts.latest(log))).join(streams.select("stream_id", "group_id", "provider_id"), "stream_id")
    tier = F.when(F.col("provider_id") == 3, 0).when(F.col("provider_id") == 1, 1).otherwise(2)
    return verdicts.ranked(best, ["group_id"], [tier]).select("group_id", "stream_id", "place")


TOTALS_SQL = """SELECT count(*) AS runs, CAST(sum(probed) AS BIGINT) AS probed, CAST(sum(dead) AS BIGINT) AS dead, CAST(sum(reordered) AS BIGINT) AS reordered,
 count(error) AS errors, max(started_at) AS last_started_at FROM v_run"""


@query(["v_run"], TOTALS_SQL)
def run_totals(history):
    return runs.run_totals(history)


@query(["v_run"], f"{TOTALS_SQL} WHERE started_at >= {RUNS_SINCE}")
def run_stats(history):
    return runs.run_totals(history, RUNS_SINCE)


@query(["v_run"], "SELECT run_id, started_at, probed, dead, reordered, error FROM v_run ORDER BY started_at DESC, run_id DESC LIMIT 50")
def runs_recent(history):
    return history.orderBy(F.desc("started_at"), F.desc("run_id")).limit(50)


@query(
    ["v_run"],
    f"""WITH g AS (SELECT CAST(floor((started_at - {ACTIVITY_START}) / CAST(86400000 AS DOUBLE)) AS BIGINT) AS bucket, count(*) AS runs, CAST(sum(probed) AS BIGINT) AS probed FROM v_run
 WHERE started_at >= {ACTIVITY_START} GROUP BY 1)
SELECT s.bucket, {ACTIVITY_START} + s.bucket * 86400000 AS at, coalesce(g.runs, 0) AS runs, coalesce(g.probed, 0) AS probed
FROM (SELECT unnest(range({ACTIVITY_DAYS})) AS bucket) s LEFT JOIN g ON g.bucket = s.bucket""",
)
def run_activity(history):
    return runs.activity(history, ACTIVITY_START, ACTIVITY_DAYS, 24 * runs.HOUR)


@query(
    ["v_run"],
    """WITH q AS (SELECT *, run_id % 16 AS worker, probed = 0 AND reordered = 0 AND error IS NULL AS quiet FROM v_run),
 m AS (SELECT *, lag(quiet, 1, false) OVER (PARTITION BY worker ORDER BY started_at, run_id) AS last FROM q),
 i AS (SELECT *, sum(CASE WHEN quiet AND last THEN 0 ELSE 1 END) OVER (PARTITION BY worker ORDER BY started_at, run_id ROWS UNBOUNDED PRECEDING) AS isl FROM m)
SELECT worker, CAST(isl AS BIGINT) AS island, quiet, count(*) AS runs, min(started_at) AS first_at, max(started_at) AS last_at FROM i GROUP BY ALL""",
)
def runs_collapsed(history):
    return runs.collapsed(history.withColumn("worker", F.col("run_id") % 16), ["worker"])


@query(["v_epg"], f"SELECT tvg_id, title, start_ms, end_ms, is_live, ord FROM v_epg WHERE start_ms <= {EPG_NOW} AND end_ms > {EPG_NOW} QUALIFY row_number() OVER (PARTITION BY tvg_id ORDER BY ord DESC) = 1")
def epg_current(epg):
    return runs.epg_current(epg, EPG_NOW)


@query(["v_epg"], f"SELECT tvg_id, min(start_ms) FILTER (start_ms > {EPG_NOW}) AS next_ms, min(start_ms) FILTER (start_ms > {EPG_NOW} AND is_live) AS next_live_ms FROM v_epg GROUP BY 1")
def epg_next(epg):
    return runs.epg_next(epg, EPG_NOW)


@query(["v_tier"], "SELECT group_id, count(*) AS streams, count(*) FILTER (tier = 'uhd') AS uhd, count(DISTINCT provider_id) AS providers FROM v_tier GROUP BY 1")
def stream_groups(streams):
    return streams.groupBy("group_id").agg(F.count(F.lit(1)).alias("streams"), F.count_if(F.col("tier") == "uhd").alias("uhd"), F.countDistinct("provider_id").alias("providers"))


@query(
    ["v_verdict_log"],
    LATEST_SQL + """ SELECT stream_id % 25 AS provider, CASE WHEN NOT alive THEN 'dead' WHEN black THEN 'black' WHEN bitrate_kbps > 0 AND bitrate_kbps < 500 THEN 'low_bitrate' ELSE 'alive' END AS state,
 count(*) AS verdicts, count(DISTINCT stream_id) AS streams FROM latest GROUP BY 1, 2""",
)
def provider_states(log):
    state = F.when(~F.col("alive"), "dead").when(F.col("black"), "black").when((F.col("bitrate_kbps") > 0) & (F.col("bitrate_kbps") < 500), "low_bitrate").otherwise("alive")
    by = verdicts.latest(log).groupBy((F.col("stream_id") % 25).alias("provider"), state.alias("state"))
    return by.agg(F.count(F.lit(1)).alias("verdicts"), F.countDistinct("stream_id").alias("streams"))
