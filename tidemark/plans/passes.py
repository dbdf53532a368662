"""Queries about a pass: gate, jobs, composition and pruning."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import composition, gate, planning, verdicts
from tidemark.plans.registry import EPG_NOW, LATEST_SQL, TTL, query

PATTERNS = [("Brand#4*", "never", 0, 0, False), ("Brand#*5", "after_epg_start", 5, 120, True)]
PLAN_NOW, FORCED = 980_000_000_000, 800_000_000_000
TOTAL = 300

POLICY_SQL = """ pol AS (SELECT c.*, coalesce(p.mode, CASE WHEN group_name ILIKE 'Brand#4%' THEN 'never' WHEN group_name ILIKE 'Brand#%5' THEN 'after_epg_start' ELSE 'always' END) AS mode,
 coalesce(p.grace_minutes, CASE WHEN group_name ILIKE 'Brand#4%' THEN 0 WHEN group_name ILIKE 'Brand#%5' THEN 5 ELSE 0 END) AS grace_minutes,
 coalesce(p.window_minutes, CASE WHEN group_name ILIKE 'Brand#4%' THEN 0 WHEN group_name ILIKE 'Brand#%5' THEN 120 ELSE 0 END) AS window_minutes,
 coalesce(p.require_live, group_name NOT ILIKE 'Brand#4%' AND group_name ILIKE 'Brand#%5') AS require_live
 FROM v_event_channel c LEFT JOIN v_policy p ON p.group_id = c.group_id)"""
GATE_SQL = f"""WITH {POLICY_SQL.strip()},
 air AS (SELECT * FROM v_epg WHERE start_ms <= {EPG_NOW} AND end_ms > {EPG_NOW} QUALIFY row_number() OVER (PARTITION BY tvg_id ORDER BY ord DESC) = 1),
 nxt AS (SELECT tvg_id, min(start_ms) FILTER (start_ms > {EPG_NOW}) AS next_ms, min(start_ms) FILTER (start_ms > {EPG_NOW} AND is_live) AS next_live_ms FROM v_epg GROUP BY 1),
 j AS (SELECT pol.*, air.ord IS NOT NULL AS on_air, air.title, air.start_ms, air.is_live, air.start_ms + grace_minutes * 60000 AS opens, air.start_ms + window_minutes * 60000 AS closes,
  CASE WHEN require_live THEN next_live_ms ELSE next_ms END + grace_minutes * 60000 AS opens_next
  FROM pol LEFT JOIN air ON air.tvg_id = pol.tvg_id LEFT JOIN nxt ON nxt.tvg_id = pol.tvg_id),
 gate AS (SELECT *, CASE WHEN mode = 'never' THEN 'group excluded' WHEN mode IN ('always', 'assigned') THEN '' WHEN NOT on_air THEN 'no EPG data'
  WHEN require_live AND NOT is_live THEN 'no live programme' WHEN {EPG_NOW} < opens THEN 'before kickoff' WHEN {EPG_NOW} > closes THEN 'event window passed' ELSE '' END AS reason FROM j),
 verdict AS (SELECT *, reason = '' AS allowed, CASE WHEN reason IN ('no EPG data', 'no live programme', 'event window passed') THEN opens_next WHEN reason = 'before kickoff' THEN opens END AS eligible_at,
  CASE WHEN reason IN ('no live programme', 'event window passed') THEN '"' || title || '"' WHEN reason = 'before kickoff' THEN strftime(make_timestamp(start_ms * 1000), '%H:%M') || 'Z "' || title || '"' END AS detail FROM gate)
"""


@query(["v_event_channel", "v_policy"], f"WITH {POLICY_SQL.strip()} SELECT channel_id, group_id, mode, CAST(grace_minutes AS BIGINT) AS grace_minutes, CAST(window_minutes AS BIGINT) AS window_minutes, require_live FROM pol")
def policy_resolution(channels, policies):
    return gate.with_policy(channels, policies, PATTERNS).select("channel_id", "group_id", "mode", "grace_minutes", "window_minutes", "require_live")


def _gated(channels, policies, epg):
    return gate.gated(gate.with_policy(channels, policies, PATTERNS), epg, EPG_NOW)


@query(["v_event_channel", "v_policy", "v_epg"], GATE_SQL + "SELECT channel_id, allowed, reason, detail, CAST(eligible_at AS BIGINT) AS eligible_at FROM verdict")
def gate_verdicts(channels, policies, epg):
    return _gated(channels, policies, epg).select("channel_id", "allowed", "reason", "detail", "eligible_at")


@query(["v_event_channel", "v_policy", "v_epg"], GATE_SQL + "SELECT reason, count(*) AS channels FROM verdict WHERE NOT allowed GROUP BY 1")
def held_back_tally(channels, policies, epg):
    return _gated(channels, policies, epg).filter(~F.col("allowed")).groupBy("reason").agg(F.count(F.lit(1)).alias("channels"))


@query(["v_event_channel", "v_policy", "v_epg"], GATE_SQL + f"SELECT count(*) FILTER (allowed) AS open_now, CAST(min(eligible_at) FILTER (eligible_at > {EPG_NOW}) AS BIGINT) AS next_eligible_at FROM verdict")
def next_wake(channels, policies, epg):
    at = F.col("eligible_at")
    return _gated(channels, policies, epg).agg(F.count_if("allowed").alias("open_now"), F.min(F.when(at > EPG_NOW, at)).alias("next_eligible_at"))


JOBS_SQL = LATEST_SQL + f""",
 cand AS (SELECT stream_id, stream_hash, variant_id, min(channel_id) AS channel_id, any_value(provider_id) AS provider_id FROM v_job GROUP BY ALL),
 jobs AS (SELECT c.stream_id, c.variant_id, c.channel_id, c.provider_id, CASE WHEN probed_at > {FORCED} THEN {PLAN_NOW} - probed_at END AS age FROM cand c LEFT JOIN latest v
  ON v.stream_id = c.stream_id AND v.stream_hash = c.stream_hash AND v.variant_id = c.variant_id
  WHERE v.stream_id IS NULL OR probed_at <= {FORCED} OR probed_at + CASE WHEN NOT alive THEN least(CAST(pow(2, least(greatest(dead_streak - 1, 0), 30)) AS BIGINT) * {TTL["dead"]}, {TTL["most"]})
   WHEN bitrate_kbps <= 0 THEN {min(TTL["live"], TTL["unknown"])} ELSE {TTL["live"]} END <= {PLAN_NOW})"""


def _jobs(candidates, log):
    return planning.due_jobs(candidates, verdicts.latest(log), PLAN_NOW, FORCED, **TTL)


def _limits(providers):
    return providers.select("provider_id", (F.col("max_streams") - 1).alias("limit"))


@query(["v_job", "v_verdict_log"], JOBS_SQL + " SELECT stream_id, variant_id, channel_id, provider_id, age FROM jobs")
def plan_jobs(candidates, log):
    return _jobs(candidates, log)


@query(["v_job", "v_verdict_log"], JOBS_SQL + " SELECT count(*) AS backlog, count(age) AS aged, max(age) AS oldest, count(DISTINCT channel_id) AS channels FROM jobs")
def plan_ages(candidates, log):
    return _jobs(candidates, log).agg(F.count(F.lit(1)).alias("backlog"), F.count("age").alias("aged"), F.max("age").alias("oldest"), F.countDistinct("channel_id").alias("channels"))


@query(
    ["v_job", "v_verdict_log", "v_provider"],
    JOBS_SQL + """, st AS (SELECT j.*, CASE WHEN p.provider_id IS NULL THEN 'unrunnable' WHEN max_streams > 1 THEN 'open' ELSE 'deferred' END AS s FROM jobs j LEFT JOIN v_provider p ON p.provider_id = j.provider_id),
 op AS (SELECT DISTINCT stream_id FROM st WHERE s = 'open')
 SELECT stream_id, variant_id, provider_id, CASE WHEN s = 'deferred' AND stream_id IN (SELECT stream_id FROM op) THEN 'covered' ELSE s END AS state FROM st""",
)
def job_triage(candidates, log, providers):
    return planning.triage(_jobs(candidates, log), _limits(providers)).select("stream_id", "variant_id", "provider_id", "state")


@query(
    ["v_job", "v_verdict_log", "v_provider"],
    JOBS_SQL + f""", o AS (SELECT j.*, coalesce(age, 4611686018427387904) AS a, coalesce(max_streams - 1, 1) AS cap FROM jobs j LEFT JOIN v_provider p ON p.provider_id = j.provider_id),
 n AS (SELECT *, row_number() OVER (PARTITION BY provider_id ORDER BY a DESC, stream_id, variant_id) AS n, row_number() OVER (ORDER BY a DESC, stream_id, variant_id) AS g FROM o),
 lane AS (SELECT provider_id, any_value(cap) AS cap, count(*) AS jobs, min(g) AS g FROM n GROUP BY 1),
 want AS (SELECT *, least(CAST(ceil({TOTAL} * (cap / CAST(sum(cap) OVER () AS DOUBLE))) AS BIGINT), jobs) AS want, row_number() OVER (ORDER BY g) AS lane FROM lane),
 quota AS (SELECT *, least(want, greatest({TOTAL} - coalesce(sum(want) OVER (ORDER BY lane ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)) AS quota FROM want),
 z AS (SELECT n.*, lane, quota FROM n JOIN quota USING (provider_id)),
 rest AS (SELECT * FROM z WHERE n > quota ORDER BY a DESC, lane, n LIMIT (SELECT CAST({TOTAL} - sum(quota) AS BIGINT) FROM quota))
 SELECT stream_id, variant_id, provider_id, 'share' AS taken_by FROM z WHERE n <= quota UNION ALL SELECT stream_id, variant_id, provider_id, 'rest' FROM rest""",
)
def lane_slice(candidates, log, providers):
    return planning.lane_slice(_jobs(candidates, log), _limits(providers), TOTAL).select("stream_id", "variant_id", "provider_id", "taken_by")


@query(
    ["v_stream"],
    """WITH l AS (SELECT DISTINCT provider_id, i AS login_id, (provider_id + i) % 3 AS slots FROM v_stream, (SELECT unnest([0, 1, 2]) AS i) t),
 r AS (SELECT *, sum(slots) OVER (PARTITION BY provider_id ORDER BY login_id) AS hi, sum(slots) OVER (PARTITION BY provider_id) AS width FROM l),
 s AS (SELECT *, row_number() OVER (PARTITION BY provider_id ORDER BY stream_id) - 1 AS seq FROM v_stream)
 SELECT stream_id, provider_id, CAST(login_id AS BIGINT) AS login_id FROM s JOIN r USING (provider_id) WHERE seq % width >= hi - slots AND seq % width < hi""",
)
def variant_draw(streams):
    ids = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(2).cast("bigint")))
    logins = streams.select("provider_id").distinct().select("provider_id", ids.alias("login_id"))
    logins = logins.withColumn("slots", (F.col("provider_id") + F.col("login_id")) % 3)
    return planning.draw(streams, logins, ["stream_id"]).select("stream_id", "provider_id", "login_id")


@query(["v_job"], "SELECT provider_id, CAST(sum(greatest(stream_id % 4, 1)) AS BIGINT) AS viewers FROM v_job WHERE stream_id % 4 > 0 OR channel_id % 10 = 0 GROUP BY 1")
def provider_viewers(jobs):
    seen = jobs.filter((F.col("stream_id") % 4 > 0) | (F.col("channel_id") % 10 == 0))
    return seen.groupBy("provider_id").agg(F.sum(F.greatest(F.col("stream_id") % 4, F.lit(1))).cast("bigint").alias("viewers"))


@query(
    ["v_verdict_log", "v_stream"],
    LATEST_SQL + f""" SELECT group_id, {FORCED} + group_id * 4000000000 AS forced_at, count(*) FILTER (probed_at <= {FORCED} + group_id * 4000000000) AS remaining
 FROM latest JOIN v_stream USING (stream_id) GROUP BY ALL""",
)
def refresh_remaining(log, streams):
    forced = F.lit(FORCED) + F.col("group_id") * F.lit(4_000_000_000)
    d = verdicts.latest(log).join(streams.select("stream_id", "group_id"), "stream_id").withColumn("forced_at", forced)
    return d.groupBy("group_id", "forced_at").agg(F.count_if(F.col("probed_at") <= F.col("forced_at")).alias("remaining"))


@query(["v_verdict_log", "v_stream"], LATEST_SQL + """, k AS (SELECT DISTINCT stream_id FROM v_stream WHERE group_id < 20), g AS (SELECT (SELECT count(*) FROM k) AS kept, (SELECT count(*) FROM latest) AS n)
 SELECT stream_id, stream_hash, variant_id, probed_at FROM latest, g WHERE stream_id IN (SELECT stream_id FROM k) OR NOT (kept > 0 AND (n <= 50 OR kept >= n * 0.1))""")
def prune_outside(log, streams):
    kept = verdicts.without_outside(verdicts.latest(log), streams.filter("group_id < 20"), least_share=0.1)
    return kept.select("stream_id", "stream_hash", "variant_id", "probed_at")


@query(["v_verdict_log"], LATEST_SQL + " SELECT stream_id, stream_hash, variant_id FROM latest WHERE variant_id IN (0, 2)")
def prune_variants(log):
    return verdicts.latest(log).filter(F.col("variant_id").isin(0, 2)).select("stream_id", "stream_hash", "variant_id")


def _compose_sql(most: int | None, remove: bool) -> str:
    add = "false" if most is None else f"(NOT held AND fit AND (nth <= greatest({most} - n_held, 0) OR {most} = 0))"
    rest = "" if remove else " UNION ALL SELECT channel_id, stream_id, ord, 1 FROM v_assigned a WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.channel_id = a.channel_id AND k.stream_id = a.stream_id)"
    return f"""WITH h AS (SELECT r.*, d.stream_id IS NOT NULL AS held, r.stream_id % 3 = 0 AS fit FROM v_ranked r LEFT JOIN (SELECT DISTINCT channel_id, stream_id FROM v_assigned) d ON d.channel_id = r.channel_id AND d.stream_id = r.stream_id),
 c AS (SELECT *, count(*) FILTER (held) OVER (PARTITION BY channel_id) AS n_held, count(*) FILTER (fit AND NOT held) OVER (PARTITION BY channel_id ORDER BY ord) AS nth FROM h),
 k AS (SELECT channel_id, stream_id, ord FROM c WHERE held OR {add}),
 u AS (SELECT channel_id, stream_id, ord, 0 AS part FROM k{rest})
 SELECT channel_id, row_number() OVER (PARTITION BY channel_id ORDER BY part, ord) AS position, stream_id FROM u"""


@query(["v_ranked", "v_assigned"], _compose_sql(None, False))
def compose_order(ranked, assigned):
    return composition.composed(ranked, assigned)


@query(["v_ranked", "v_assigned"], _compose_sql(None, True))
def compose_remove(ranked, assigned):
    return composition.composed(ranked, assigned, remove=True)


@query(["v_ranked", "v_assigned", "v_stream"], _compose_sql(6, False))
def compose_assign(ranked, assigned, streams):
    return composition.composed(ranked, assigned, eligible=streams.filter("stream_id % 3 = 0"), most=6)


@query(
    ["v_assigned", "v_stream", "v_group"],
    """SELECT a.channel_id, a.stream_id, min(a.ord) AS ord, 0 AS step FROM v_assigned a JOIN v_stream s ON s.stream_id = a.stream_id
 WHERE s.group_id NOT IN (SELECT group_id FROM v_group WHERE group_name ILIKE 'Brand#1%') GROUP BY 1, 2""",
)
def assigned_candidates(assigned, streams, groups):
    out = composition.candidates(assigned, streams, groups.filter(gate.glob(F.col("group_name"), "Brand#1*")))
    return out.select("channel_id", "stream_id", "ord", "step")


@query(["v_assigned", "v_ranked"], "SELECT a.channel_id, a.stream_id, a.ord, r.stream_id IS NOT NULL AS matched FROM v_assigned a LEFT JOIN v_ranked r ON r.channel_id = a.channel_id AND r.stream_id = a.stream_id")
def assigned_split(assigned, ranked):
    hits = ranked.select("channel_id", "stream_id", F.lit(True).alias("matched"))
    return assigned.join(hits, ["channel_id", "stream_id"], "left").select("channel_id", "stream_id", "ord", F.coalesce("matched", F.lit(False)).alias("matched"))


@query(
    ["v_assigned", "v_stream", "v_provider"],
    """SELECT a.channel_id, a.ord - 1 AS slot, a.stream_id, s.provider_id, coalesce(p.provider_name, CAST(s.provider_id AS VARCHAR)) AS provider_name
 FROM v_assigned a JOIN v_stream s ON s.stream_id = a.stream_id LEFT JOIN v_provider p ON p.provider_id = s.provider_id""",
)
def catalogue_rows(assigned, streams, providers):
    return composition.catalogue(assigned, streams, providers)


@query(["v_assigned"], "SELECT stream_id, max(channel_id) AS channel_id FROM v_assigned GROUP BY 1")
def stream_to_channel(assigned):
    return assigned.groupBy("stream_id").agg(F.max("channel_id").alias("channel_id"))
