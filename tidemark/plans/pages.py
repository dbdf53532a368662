"""Queries about whole documents: the metrics page, the merged rules file, listings read page by page, previews of every channel."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import lists, metrics, published, verdicts
from tidemark.operators.gate import glob
from tidemark.plans.lanes import OUTCOMES_SQL, _outcomes
from tidemark.plans.matching import RULES_SQL, VIEWS, _matched
from tidemark.plans.measures import METRICS, STREAMS_SQL, _streams, _zero_filled
from tidemark.plans.registry import BEST_SQL, D, query
from tidemark.plans.streams import stream_query
from tidemark.sources.paged import Paged
from tidemark.sources.scratch import path

ABOUT = {
    "tidemark_up": ("gauge", "Always 1."),
    "tidemark_runs_total": ("counter", "Passes recorded."),
    "tidemark_runs_failed_total": ("counter", "Passes that ended in an error."),
    "tidemark_streams_probed_total": ("counter", "Streams probed in all passes."),
    "tidemark_lane_limit": ("gauge", "Streams that a lane may hold."),
    "tidemark_lane_queued": ("gauge", "Streams queued on a lane."),
    "tidemark_lane_done": ("gauge", "Streams completed on a lane."),
    "tidemark_lane_dead": ("gauge", "Dead streams found on a lane."),
    "tidemark_lane_failed": ("gauge", "Probes that failed on a lane."),
    "tidemark_provider_streams": ("gauge", "Distinct streams by state."),
    "tidemark_provider_resolution_streams": ("gauge", "Distinct streams by resolution."),
    "tidemark_provider_leads": ("gauge", "Channels that a provider leads."),
    "tidemark_provider_leads_healthy": ("gauge", "Channels that a usable stream of a provider leads."),
    "tidemark_nothing": ("gauge", "A family without samples."),
}
LANES = ["limit", "queued", "done", "dead", "failed"]
_label = lambda **c: " || ',' || ".join(f"'{k}=\"' || {v} || '\"'" for k, v in c.items())
_lane_rows = "\n UNION ALL ".join(f"SELECT 'tidemark_lane_{c}' AS f, {_label(provider='o.provider_id', login='login_id')} AS l, {'max_streams' if c == 'limit' else c} AS v FROM out o JOIN v_provider q ON q.provider_id = o.provider_id" for c in LANES)
PAGE_SQL = STREAMS_SQL + ", " + OUTCOMES_SQL[5:] + f""", st_ AS ({_zero_filled("state", metrics.STATES)}), re_ AS ({_zero_filled("resolution", metrics.RESOLUTIONS)}),
 lead AS (SELECT cat.provider_id, count(*) AS channels, count(*) FILTER (b.usable) AS healthy FROM cat LEFT JOIN best b ON b.stream_id = cat.stream_id WHERE slot = 0 GROUP BY 1),
 smp AS (SELECT 'tidemark_up' AS f, NULL AS l, 1 AS v UNION ALL SELECT 'tidemark_runs_total', NULL, count(*) FROM v_run UNION ALL SELECT 'tidemark_runs_failed_total', NULL, count(error) FROM v_run UNION ALL SELECT 'tidemark_streams_probed_total', NULL, sum(probed) FROM v_run
 UNION ALL {_lane_rows}
 UNION ALL SELECT 'tidemark_provider_streams', {_label(provider='provider_id', state='state')}, streams FROM st_ UNION ALL SELECT 'tidemark_provider_resolution_streams', {_label(provider='provider_id', resolution='resolution')}, streams FROM re_
 UNION ALL SELECT 'tidemark_provider_leads', {_label(provider='provider_id')}, channels FROM lead UNION ALL SELECT 'tidemark_provider_leads_healthy', {_label(provider='provider_id')}, healthy FROM lead),
 about AS (SELECT * FROM (VALUES {', '.join(f"({k}, '{f}', '{kind}', '{text}')" for k, (f, (kind, text)) in enumerate(ABOUT.items()))}) a(place, f, kind, help)),
 lines AS (SELECT DISTINCT place, 0 AS part, '# HELP ' || f || ' ' || help AS line FROM about JOIN smp USING (f) UNION ALL SELECT DISTINCT place, 1, '# TYPE ' || f || ' ' || kind FROM about JOIN smp USING (f)
  UNION ALL SELECT place, 2, f || CASE WHEN l IS NULL THEN '' ELSE '{{' || l || '}}' END || ' ' || CAST(v AS BIGINT) FROM about JOIN smp USING (f))
 SELECT row_number() OVER (ORDER BY place, part, line) AS line_no, line FROM lines"""


@query([*METRICS, "v_job", "v_run"], PAGE_SQL)
def metrics_page(assigned, streams, providers, log, jobs, runs):
    """Every family as the text that is served: totals of passes, what lanes did, streams of providers by state and resolution, and what they lead."""
    login = {"provider": F.col("provider_id"), "login": F.col("login_id")}
    lanes = _outcomes(jobs, providers).join(providers.select("provider_id", F.col("max_streams").alias("limit")), "provider_id")
    counts = metrics.provider_counts(_streams(assigned, streams, providers, log))
    owner = {"provider": F.col("provider_id")}
    totals = runs.agg(F.lit(1).alias("up"), F.count(F.lit(1)).alias("runs"), F.count("error").alias("failed"), F.sum("probed").alias("probed"))
    rows = [metrics.families(totals, [(f"tidemark_{name}", F.col(c), {}) for name, c in (("up", "up"), ("runs_total", "runs"), ("runs_failed_total", "failed"), ("streams_probed_total", "probed"))])]
    rows.append(metrics.families(lanes, [(f"tidemark_lane_{c}", F.col(c), login) for c in LANES]))
    of = []
    for name, column, values in (("streams", "state", metrics.STATES), ("resolution_streams", "resolution", metrics.RESOLUTIONS)):
        of += [(f"tidemark_provider_{name}", F.col(f"{column}_{v}"), owner | {column: F.lit(v)}) for v in values]
    of += [(f"tidemark_provider_{name}", F.col(c), owner) for name, c in (("leads", "channels"), ("leads_healthy", "healthy"))]
    rows.append(metrics.families(counts, of))
    return metrics.page(reduce(DataFrame.unionByName, rows), ABOUT)


@query(
    ["v_job", "v_provider"],
    OUTCOMES_SQL + """ SELECT o.provider_id AS provider, o.login_id AS login, m AS family, CAST(CASE m WHEN 'lane_limit' THEN max_streams WHEN 'lane_queued' THEN queued WHEN 'lane_done' THEN done WHEN 'lane_dead' THEN dead WHEN 'lane_failed' THEN failed
  WHEN 'lane_in_flight' THEN queued - done - failed ELSE done + failed END AS BIGINT) AS value
 FROM out o JOIN v_provider q ON q.provider_id = o.provider_id, (SELECT unnest(['lane_limit', 'lane_queued', 'lane_done', 'lane_dead', 'lane_failed', 'lane_in_flight', 'lane_completed']) AS m)""",
)
def lane_metrics(jobs, providers):
    """Gauges of lanes from what the lanes did."""
    d = _outcomes(jobs, providers).join(providers.select("provider_id", F.col("max_streams").alias("limit")), "provider_id")
    flight = (F.col("queued") - F.col("done") - F.col("failed")).cast("int")
    lanes = d.select(F.struct("provider_id", "login_id").alias("provider"), "limit", "queued", "done", "dead", "failed", F.when(flight > 0, F.sequence(F.lit(1), flight)).alias("current"))
    return metrics.lane_families(lanes).select("provider.provider_id", "provider.login_id", "family", "value").toDF("provider", "login", "family", "value")


@query(
    ["v_group"],
    """WITH e AS (SELECT group_id AS ord, CASE WHEN group_id % 2 = 0 THEN 'm3u' ELSE 'group' END AS type, ' Supplier#' || group_id AS value FROM v_group WHERE group_id % 9 <> 5),
 n AS (SELECT 'supplier#' || (group_id % 15 + 5) AS value, max(group_id) AS points, min(group_id) AS ord FROM v_group GROUP BY 1),
 m AS (SELECT e.ord IS NULL AS appended, coalesce(e.ord, n.ord) AS ord, coalesce(CASE WHEN n.ord IS NOT NULL THEN 'm3u' END, e.type) AS type, coalesce(n.value, e.value) AS value, coalesce(n.points, 1) AS points FROM e FULL JOIN n ON e.type = 'm3u' AND lower(trim(e.value)) = n.value)
 SELECT CAST(row_number() OVER (ORDER BY appended, ord) - 1 AS INTEGER) AS place, type, value, 99 AS priority, 'score' AS mode, CAST(points AS BIGINT) AS points FROM m""",
)
def rules_document(groups):
    """The merged rules as the exported document holds them, read back from its JSON."""
    i = F.col("group_id")
    fixed = [F.lit(99).alias("priority"), F.lit("score").alias("mode")]
    name = F.when(i % 9 != 5, F.concat(F.lit(" Supplier#"), i.cast("string")))
    old = groups.select(i.alias("ord"), F.when(i % 2 == 0, "m3u").otherwise("group").alias("type"), name.alias("value"), *fixed, F.lit(1).cast("bigint").alias("points"))
    new = groups.select(i.alias("ord"), F.lit("m3u").alias("type"), F.concat(F.lit("supplier#"), (i % 15 + 5).cast("string")).alias("value"), *fixed, i.alias("points"))
    rules = F.from_json("rules", "array<struct<type: string, value: string, priority: int, mode: string, points: bigint>>")
    return published.envelope(old, new).select(F.posexplode(rules).alias("place", "r")).select("place", "r.*")


PAGES = 40


@stream_query(f"""WITH n AS (SELECT CAST(ceil(count(*) / {D(PAGES)}) AS BIGINT) AS size, count(*) AS c FROM part), r AS (SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_partkey) - 1 AS k FROM part)
SELECT CAST(k // size + 1 AS INTEGER) AS page, CAST(k % size AS INTEGER) AS ord, p_partkey AS id, p_name AS name FROM r, n""")
def pages_read(spark, sf_dir):
    """A listing in forty page files, read as a data source whose partitions are its pages."""
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))
    count = rows.count()
    size = max(1, -(-count // PAGES))
    # keys are gapless from 1 on in this table, so a row's page and place follow from its key
    placed = rows.withColumn("k", F.col("id") - F.lit(rows.agg(F.min("id")).first()[0] or 0))
    page = F.expr(f"CAST(k DIV {size} + 1 AS INT)")
    bodies = placed.groupBy(page.alias("page")).agg(F.array_sort(F.collect_list(F.struct("id", "name", "brand"))).alias("results"))  # a page's rows
    more = F.when(F.col("page") * size < count, F.lit("more"))
    folder = path(spark, "pages")
    bodies.select("page", F.to_json(F.struct(F.lit(count).alias("count"), more.alias("next"), "results")).alias("value")).write.partitionBy("page").text(folder)
    spark.dataSource.register(Paged)
    return spark.read.format("paged").schema("page int, ord int, id bigint, name string").option("page_size", str(size)).load(folder)


@query(
    ["v_assigned", "v_ranked", "v_stream", "v_provider", "v_verdict_log"],
    BEST_SQL + """ SELECT r.channel_id, r.stream_id, CAST(row_number() OVER (PARTITION BY r.channel_id ORDER BY r.ord) AS INTEGER) AS place, a.ord AS current_place, s.name, p.provider_name, b.score, b.usable FROM v_ranked r LEFT JOIN (SELECT channel_id, stream_id, min(ord) AS ord FROM v_assigned GROUP BY 1, 2) a ON a.channel_id = r.channel_id AND a.stream_id = r.stream_id
 LEFT JOIN v_stream s ON s.stream_id = r.stream_id LEFT JOIN v_provider p ON p.provider_id = s.provider_id LEFT JOIN best b ON b.stream_id = r.stream_id QUALIFY row_number() OVER (PARTITION BY r.channel_id ORDER BY r.ord) <= 300""",
)
def previews(assigned, ranked, streams, providers, log):
    """The first 300 rows of every channel's new order beside its current one (a report with a top-k)."""
    place = F.row_number().over(Window.partitionBy("channel_id").orderBy("ord"))
    d = ranked.select("channel_id", "stream_id", "ord").withColumn("place", place).filter("place <= 300")
    now = assigned.groupBy("channel_id", "stream_id").agg(F.min("ord").alias("current_place"))
    d = d.join(now, ["channel_id", "stream_id"], "left").join(streams.select("stream_id", "name", "provider_id"), "stream_id", "left")
    d = d.join(providers.select("provider_id", "provider_name"), "provider_id", "left")
    best = verdicts.best_of_stream(verdicts.scored(verdicts.latest(log))).select("stream_id", "score", "usable")
    return d.join(best, "stream_id", "left").select("channel_id", "stream_id", "place", "current_place", "name", "provider_name", "score", "usable")


@query(
    [*VIEWS, "v_policy", "v_assigned"],
    f"""WITH {RULES_SQL}, c AS (SELECT channel_id, channel_id % 25 AS group_id, channel_id % 6 <> 1 AS has_rule FROM v_channel),
 m AS (SELECT channel_id, count(DISTINCT stream_id) AS n FROM passed WHERE (channel_id, stream_id) NOT IN (SELECT (channel_id, stream_id) FROM out) GROUP BY 1), a AS (SELECT channel_id, count(*) AS n FROM v_assigned GROUP BY 1),
 r AS (SELECT a.channel_id, count(DISTINCT a.stream_id) AS n FROM v_assigned a JOIN v_stream s ON s.stream_id = a.stream_id WHERE s.group_id NOT IN (SELECT group_id FROM v_group WHERE group_name ILIKE 'Brand#1%') GROUP BY 1),
 h AS (SELECT c.*, coalesce(p.mode, 'always') AS mode, coalesce(a.n, 0) AS assigned, coalesce(CASE WHEN has_rule THEN m.n WHEN coalesce(p.mode, 'always') IN ('assigned', 'after_epg_start') THEN r.n END, 0) AS matched
  FROM c LEFT JOIN v_policy p ON p.group_id = c.group_id LEFT JOIN a ON a.channel_id = c.channel_id LEFT JOIN m ON m.channel_id = c.channel_id LEFT JOIN r ON r.channel_id = c.channel_id)
 SELECT group_id, mode, count(*) AS channels, count(*) FILTER (has_rule) AS ruled, count(*) FILTER (matched > 0) AS matched_channels, CAST(sum(matched) AS BIGINT) AS links, CAST(sum(assigned) AS BIGINT) AS assigned,
  CASE WHEN group_id % 3 = 0 THEN CAST(1000 + group_id AS BIGINT) END AS refresh_queued_at FROM h GROUP BY 1, 2""",
)
def state_page(channels, streams, groups, policies, assigned):
    """Every group's roll-up from what the rules claim and what is assigned."""
    i = F.col("channel_id")
    per = assigned.groupBy("channel_id").agg(F.count(F.lit(1)).alias("assigned"))
    rows = channels.select("channel_id", (i % 25).alias("group_id"), (i % 6 != 1).alias("has_rule")).join(per, "channel_id", "left").fillna(0, ["assigned"])
    outside = groups.filter(glob(F.col("group_name"), "Brand#1*")).select("group_id")
    ready = assigned.select("channel_id", "stream_id").join(streams.join(outside, "group_id", "left_anti").select("stream_id"), "stream_id")
    marks = rows.filter("group_id % 3 = 0").select("group_id", (F.col("group_id") + 1000).cast("bigint").alias("forced_at"))
    return lists.state_rollup(rows, policies, _matched(channels, streams, groups), ready, marks)
