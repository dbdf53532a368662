"""Queries about lanes: logins, what they play, their room and what they did."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import lanes, verdicts
from tidemark.plans.passes import JOBS_SQL, PLAN_NOW, _jobs
from tidemark.plans.registry import D, LATEST_SQL, NOW, TTL, TTL_SQL, query

CAP = 60
LOGINS_SQL = """WITH lg AS (SELECT p.provider_id, CASE WHEN f.profile_id IS NULL OR f.is_default THEN 0 ELSE f.profile_id END AS login_id, f.profile_id, coalesce(f.name, 'default') AS name, coalesce(f.is_default, true) AS is_default,
  coalesce(nullif(f.max_streams, 0), p.max_streams) AS max_streams, coalesce(f.viewers, 0) AS viewers, p.account_type = 'XC' AS rebuilds, f.ord,
  row_number() OVER (PARTITION BY p.provider_id ORDER BY f.is_default DESC, f.ord) AS nth FROM v_account p LEFT JOIN (SELECT * FROM v_profile WHERE is_active) f ON f.provider_id = p.provider_id)"""
URLS_SQL = LOGINS_SQL + """, t AS (SELECT s.stream_id, s.provider_id, coalesce(login_id, 0) AS login_id, nth, ord = 2 AND s.provider_id % 2 = 0 AS bad,
  CASE WHEN ord = 0 OR ord = 2 AND s.provider_id % 2 = 1 AND s.provider_id % 3 = 0 THEN replace(url, 'user/pass', 'u0/p0') WHEN ord = 1 THEN replace(url, 'user/pass', 'u1/p$$')
   WHEN ord = 2 AND s.provider_id % 2 = 1 THEN replace(url, 'user/pass', 'u2/p2') ELSE url END AS url FROM v_url s LEFT JOIN lg ON lg.provider_id = s.provider_id),
 u AS (SELECT *, row_number() OVER (PARTITION BY stream_id, url ORDER BY nth) = 1 AS taken FROM t),
 found AS (SELECT stream_id, provider_id, login_id, url, taken, CASE WHEN bad THEN 'unusable-pattern' WHEN NOT taken THEN 'duplicate-url' END AS issue FROM u)"""


def _lines(accounts, profiles):
    return lanes.logins(accounts, profiles)


@query(["v_account", "v_profile"], LOGINS_SQL + " SELECT provider_id, login_id, profile_id, name, is_default, max_streams, viewers, rebuilds, nth FROM lg")
def provider_logins(accounts, profiles):
    return _lines(accounts, profiles).drop("search", "replace")


@query(["v_account", "v_profile", "v_url"], URLS_SQL + " SELECT * FROM found")
def login_urls(accounts, profiles, urls):
    return lanes.targets(urls, _lines(accounts, profiles))


@query(["v_account", "v_profile", "v_url"], URLS_SQL + " SELECT provider_id, login_id, issue, count(*) AS streams FROM found WHERE issue IS NOT NULL GROUP BY ALL")
def login_issues(accounts, profiles, urls):
    return lanes.issues(lanes.targets(urls, _lines(accounts, profiles)))


@query(
    ["v_account", "v_profile", "v_job"],
    LOGINS_SQL + """, pv AS (SELECT provider_id, count(*) AS v FROM v_job WHERE channel_id % 40 = 0 GROUP BY 1), sv AS (SELECT channel_id * 10 + variant_id AS profile_id, count(*) % 6 AS v FROM v_job WHERE variant_id < 2 GROUP BY 1),
 o AS (SELECT lg.*, greatest(viewers, coalesce(sv.v, 0)) AS own, coalesce(pv.v, 0) AS seen FROM lg LEFT JOIN sv ON sv.profile_id = lg.profile_id LEFT JOIN pv ON pv.provider_id = lg.provider_id),
 q AS (SELECT *, greatest(seen - sum(own) OVER (PARTITION BY provider_id), 0) AS open, bool_or(is_default) OVER (PARTITION BY provider_id) AS led, count(*) OVER (PARTITION BY provider_id) AS n FROM o)
 SELECT provider_id, login_id, max_streams AS base, CAST(own + CASE WHEN is_default THEN open WHEN led THEN 0 ELSE ceil(open / CAST(n AS DOUBLE)) END AS BIGINT) AS viewers FROM q""",
)
def lane_budgets(accounts, profiles, jobs):
    seen = jobs.filter("channel_id % 40 = 0").groupBy("provider_id").agg(F.count(F.lit(1)).alias("viewers"))
    sessions = jobs.filter("variant_id < 2").groupBy((F.col("channel_id") * 10 + F.col("variant_id")).alias("profile_id")).agg((F.count(F.lit(1)) % 6).alias("viewers"))
    return lanes.budgets(_lines(accounts, profiles), seen, sessions)


@query(["v_provider"], f"""SELECT provider_id, max_streams AS "limit", CASE WHEN {CAP} < (SELECT sum(max_streams) FROM v_provider) THEN greatest(1, least(max_streams, CAST({CAP} * max_streams AS BIGINT) // (SELECT sum(max_streams) FROM v_provider)::BIGINT)) ELSE max_streams END AS sustained FROM v_provider""")
def lane_sustained(providers):
    return lanes.sustained(providers.select("provider_id", F.col("max_streams").alias("limit")), CAP)


OUTCOMES_SQL = f"""WITH j AS (SELECT provider_id, variant_id AS login_id, ['done', 'dead', 'failed', 'queued', 'done'][1 + (stream_id + variant_id) % 5] AS state, stream_id * 1000 AS began, stream_id * 1000 + 500 * (1 + channel_id % 4) AS ended FROM v_job),
 o AS (SELECT provider_id, login_id, count(*) AS queued, count(*) FILTER (state IN ('done', 'dead')) AS done, count(*) FILTER (state = 'dead') AS dead, count(*) FILTER (state = 'failed') AS failed,
  CAST(sum(ended - began) AS BIGINT) AS busy, max(ended) - min(began) AS span FROM j GROUP BY 1, 2),
 out AS (SELECT o.*, CASE WHEN span * max_streams > 0 THEN busy / CAST(span * max_streams AS DOUBLE) * 100 ELSE {D(0)} END AS utilisation FROM o LEFT JOIN v_provider p ON p.provider_id = o.provider_id)"""


def _outcomes(jobs, providers):
    state = F.get(F.array(*map(F.lit, ["done", "dead", "failed", "queued", "done"])), ((F.col("stream_id") + F.col("variant_id")) % 5).cast("int"))
    began = F.col("stream_id") * 1000
    d = jobs.select("provider_id", F.col("variant_id").alias("login_id"), state.alias("state"), began.alias("began"), (began + 500 * (1 + F.col("channel_id") % 4)).alias("ended"))
    return lanes.outcomes(d, providers.select("provider_id", F.col("max_streams").alias("limit")))


@query(["v_job", "v_provider"], OUTCOMES_SQL + " SELECT provider_id, login_id, queued, done, dead, failed, utilisation FROM out")
def lane_outcomes(jobs, providers):
    return _outcomes(jobs, providers)


@query(["v_job", "v_provider"], OUTCOMES_SQL + " SELECT provider_id, CAST(sum(queued) AS BIGINT) AS queued, CAST(sum(done) AS BIGINT) AS done, CAST(sum(dead) AS BIGINT) AS dead, CAST(sum(failed) AS BIGINT) AS failed, list_sort(list(login_id)) AS logins FROM out GROUP BY 1")
def lanes_by_provider(jobs, providers):
    return lanes.by_provider(_outcomes(jobs, providers))


DAY = 86_400_000


@query(
    ["v_job", "v_verdict_log"],
    JOBS_SQL + f""", g AS (SELECT provider_id, count(*) AS backlog, coalesce(max(age), 0) % {3 * DAY} AS oldest FROM jobs GROUP BY 1)
 SELECT provider_id, backlog, CAST(CASE WHEN oldest >= {2 * DAY} THEN least(backlog, 40) ELSE greatest(least(25, backlog), least(floor(backlog / greatest(({2 * DAY} - oldest) / {D(600_000)}, {D(1)}) + {D(0.5)}), 40, backlog)) END AS BIGINT) AS slice FROM g""",
)
def pace_slices(candidates, log):
    by = _jobs(candidates, log).groupBy("provider_id").agg(F.count(F.lit(1)).alias("backlog"), (F.coalesce(F.max("age"), F.lit(0)) % (3 * DAY)).alias("oldest"))
    return by.select("provider_id", "backlog", lanes.slice_size(F.col("backlog"), F.col("oldest"), 2 * DAY, 600_000, 40).alias("slice"))


@query(
    ["v_job", "v_verdict_log"],
    JOBS_SQL + f""", t AS (SELECT count(*) AS total FROM cand), b AS (SELECT count(*) AS backlog, max(age) AS age FROM jobs)
 SELECT backlog, total, total - backlog AS within_target, floor(1000 * (total - backlog) / CAST(total AS DOUBLE) + {D(0.5)}) / 10 AS compliance, floor(age / {D(3_600_000)} * 100 + {D(0.5)}) / 100 AS oldest_hours, age > {DAY} AS breaching FROM t, b""",
)
def pace_status(candidates, log):
    total = candidates.agg(F.countDistinct("stream_id", "stream_hash", "variant_id").alias("n")).scalar()
    age = F.col("age")
    d = _jobs(candidates, log).agg(F.count(F.lit(1)).alias("backlog"), F.max("age").alias("age")).withColumn("total", total)
    within = F.col("total") - F.col("backlog")
    share = F.when(F.col("total") > 0, F.floor(1000 * within / F.col("total") + 0.5) / 10).otherwise(F.lit(100.0))
    return d.select("backlog", "total", within.alias("within_target"), share.alias("compliance"), (F.floor(age / 3_600_000 * 100 + 0.5) / 100).alias("oldest_hours"), (age > DAY).alias("breaching"))


@query(
    ["v_run"],
    """SELECT run_id, CASE WHEN error IS NOT NULL OR probed > 0 OR reordered > 0 THEN 60000 ELSE least(greatest(least(CASE WHEN run_id % 3 > 0 THEN run_id * 1000 END, CASE WHEN run_id % 4 > 0 THEN run_id * 700 END), 60000), 900000) END AS wait_ms
 FROM v_run WHERE error IS NOT NULL OR probed > 0 OR reordered > 0 OR run_id % 12 > 0 UNION ALL SELECT run_id, 60000 FROM v_run WHERE error IS NULL AND probed = 0 AND reordered = 0 AND run_id % 12 = 0""",
)
def pace_wait(history):
    i = F.col("run_id")
    wakes = [F.when(i % 3 > 0, F.col("started_at") + i * 1000), F.when(i % 4 > 0, F.col("started_at") + i * 700)]
    worked = (F.col("probed") > 0) | (F.col("reordered") > 0)
    return history.select("run_id", lanes.wait(60_000, 900_000, F.col("error").isNotNull(), worked, wakes, F.col("started_at")).alias("wait_ms"))


@query(
    ["v_verdict_log"],
    LATEST_SQL + f""", seen AS (SELECT stream_id, min(probed_at) AS seen FROM latest GROUP BY 1),
 n AS (SELECT CASE WHEN {NOW} - seen < 3600000 THEN 'hour' WHEN {NOW} - seen < 21600000 THEN 'six_hours' WHEN {NOW} - seen < 86400000 THEN 'day' ELSE 'older' END AS bucket FROM seen)
 SELECT bucket, count(*) AS streams, {D(100)} * count(*) / (SELECT count(*) FROM n) AS share FROM n GROUP BY 1""",
)
def freshness_share(log):
    health = verdicts.cache_health(verdicts.latest(log), NOW, 0, **TTL)
    ages = ["hour", "six_hours", "day", "older"]
    d = health.unpivot(["total"], ages, "bucket", "streams").filter("streams > 0")
    return d.select("bucket", "streams", (F.lit(100.0) * F.col("streams") / F.col("total")).alias("share"))
