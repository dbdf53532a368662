"""Queries about what is kept between passes, about completion, and about sound."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import probing
from tidemark.operators import composition, matching, metrics, state, verdicts
from tidemark.operators.gate import glob
from tidemark.plans.matching import PARTS, _countries
from tidemark.plans.measures import METRICS, STREAMS_SQL, _best, _catalogue
from tidemark.plans.registry import D, LATEST_SQL, query

HEARD_SQL = LATEST_SQL + f""", heard AS (SELECT *, 32 * (l_orderkey % 12) AS abr, [44100, 48000, 0][1 + l_orderkey % 3] AS rate, ['flac', 'ac3', 'mp3', '', 'opus'][1 + l_orderkey % 5] AS codec,
  CASE WHEN l_orderkey % 7 = 0 THEN 0 ELSE audio_channels END AS ch FROM latest),
 us AS (SELECT *, alive AND NOT black AND (abr > 0 OR bitrate_kbps > 0 OR ch > 0) AS usable FROM heard),
 sc AS (SELECT *, CASE WHEN usable THEN floor((least((CASE WHEN ch = 0 THEN 2 ELSE ch END) / {D(6)}, 1) * {D(0.4)} + least((CASE WHEN abr > 0 THEN abr WHEN bitrate_kbps > 0 THEN bitrate_kbps ELSE 128 END) / {D(256)}, 1) * {D(0.4)}
  + least((CASE WHEN rate = 0 THEN 44100 ELSE rate END) / {D(48000)}, 1) * {D(0.1)} + CASE codec WHEN 'flac' THEN {D(1)} WHEN 'ac3' THEN {D(0.8)} WHEN 'mp3' THEN {D(0.6)} ELSE {D(0.5)} END * {D(0.1)}) * 10000 + {D(0.5)}) / 10000 ELSE {D(0)} END AS score FROM us),
 bst AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY stream_id ORDER BY usable DESC, (bitrate_kbps > 0) DESC, score DESC, variant_id, stream_hash) = 1)"""


@query(
    ["v_verdict_log", "v_stream"],
    HEARD_SQL + " SELECT group_id, stream_id, usable, score, row_number() OVER (PARTITION BY group_id ORDER BY usable DESC, (bitrate_kbps > 0) DESC, score DESC, stream_id) AS place FROM bst JOIN v_stream USING (stream_id)",
)
def rank_audio(log, streams):
    i = F.col("l_orderkey")
    pick = lambda values, n: F.get(F.array(*map(F.lit, values)), (i % n).cast("int"))
    v = verdicts.latest(log).withColumn("audio_bitrate_kbps", 32 * (i % 12)).withColumn("audio_sample_rate", pick([44100, 48000, 0], 3)).withColumn("audio_codec", pick(["flac", "ac3", "mp3", "", "opus"], 5))
    v = v.withColumn("audio_channels", F.when(i % 7 == 0, 0).otherwise(F.col("audio_channels")))
    best = verdicts.best_of_stream(verdicts.audio_scored(v)).join(streams.select("stream_id", "group_id"), "stream_id")
    return verdicts.ranked(best, ["group_id"], []).select("group_id", "stream_id", "usable", "score", "place")


@query(["v_channel", "v_stream"], f"WITH {PARTS} SELECT channel_id, stream_id FROM v_channel c JOIN p ON p.p_name = c.name WHERE k = 2 AND channel_id % 8 = 3 OR k IN (0, 3) AND channel_id % 8 = 5 AND px = 'US'")
def match_excludes(channels, streams):
    """Pairs that aliases claim and exclude lines take away: one line is a bare tag, one asks for a section and a tag."""
    countries = _countries(streams)
    line = F.when(F.col("channel_id") % 8 == 3, F.lit("hd")).when(F.col("channel_id") % 8 == 5, F.concat(F.lit("@US "), F.col("name"), F.lit(" ~FHD")))
    rows = channels.select("channel_id", F.explode(F.array(F.struct(F.lit("alias").alias("kind"), F.initcap("name").alias("line")), F.struct(F.lit("exclude").alias("kind"), line.alias("line")))).alias("r"))
    lines = rows.select("channel_id", "r.kind", F.lit(0).alias("position"), "r.line").filter("line IS NOT NULL")
    c = matching.stored(matching.compiled(lines, countries))
    known = matching.Catalogue.of(streams, countries, "v_stream")
    hits = matching.by_key(c.filter("kind = 'alias'"), known.names)
    out = matching.excluded(hits.select("channel_id", "name_id", "key", "quality_keys", "section_keys", "tail_keys"), c.filter("kind = 'exclude'"), "name_id")
    return known.bearing(out).select("channel_id", "stream_id").distinct()


@query(
    ["v_stream"],
    f"""WITH {PARTS}, f AS (SELECT *, CASE WHEN k = 6 THEN replace(p_name, ' ', '') || '+1' ELSE replace(p_name, ' ', '') END AS key FROM p WHERE contains(lower(name), 'ring')),
 s AS (SELECT key, 'prefix' AS kind, px AS name FROM f WHERE px <> '' UNION ALL SELECT key, 'section', CASE WHEN px <> '' THEN px ELSE string_split(up, ' ')[1] END FROM f),
 n AS (SELECT key, kind, name, count(*) AS streams FROM s GROUP BY ALL)
 SELECT key, kind, name, streams, CAST(row_number() OVER (PARTITION BY key, kind ORDER BY streams DESC, name) AS INTEGER) AS place FROM n QUALIFY row_number() OVER (PARTITION BY key, kind ORDER BY streams DESC, name) <= 8""",
)
def search_sections(streams):
    return matching.search_sections(matching.Catalogue.of(streams, _countries(streams), "v_stream"), "ring")


ERRORS = ["", "spawn failed: ENOENT", "refusing a url", "Protocol not found", "Server returned 403 Forbidden (not found)", "HTTP error 404 Not Found", "502 Bad Gateway", "Connection timed out", "Connection refused", "failed at 2024 something"]


@query(
    METRICS,
    STREAMS_SQL + """, d AS (SELECT provider_id, ['other', 'probe_error', 'rejected', 'unsupported', 'auth', 'not_found', 'server_error', 'timeout', 'unreachable', 'other'][1 + stream_id % 10] AS reason FROM st WHERE state = 'dead')
 SELECT p.provider_id, e.reason, count(d.reason) AS streams FROM (SELECT DISTINCT provider_id FROM st) p, (SELECT unnest(['probe_error', 'rejected', 'unsupported', 'auth', 'not_found', 'server_error', 'timeout', 'unreachable', 'other']) AS reason) e
 LEFT JOIN d ON d.provider_id = p.provider_id AND d.reason = e.reason GROUP BY 1, 2""",
)
def provider_dead_reasons(assigned, streams, providers, log):
    d = metrics.provider_streams(_catalogue(assigned, streams, providers), _best(log))
    error = F.get(F.array(*map(F.lit, ERRORS)), (F.col("stream_id") % 10).cast("int"))
    d = d.withColumn("reason", F.when(F.col("state") == "dead", probing.dead_reason(error)))
    return metrics.histogram(d, "reason", [*dict.fromkeys(r for r, _ in probing.REASONS), "other"])


PHASES = ["idle", "fetching", "planning", "probing", "ranking", "writing", "done"]


@query(
    ["v_run"],
    f"""WITH t AS (SELECT count(*) AS runs_total, count(error) AS runs_failed_total, CAST(sum(probed) AS BIGINT) AS probed_total, CAST(sum(dead) AS BIGINT) AS dead_total, CAST(sum(reordered) AS BIGINT) AS reordered_total,
  CAST(floor(max(started_at) / {D(1000)} + {D(0.5)}) AS BIGINT) AS last_run_start_seconds, arg_max(CASE WHEN error IS NULL THEN 0 ELSE 1 END, (started_at, run_id))::BIGINT AS last_run_failed FROM v_run)
 SELECT name AS family, '' AS label, value FROM (UNPIVOT t ON COLUMNS(*)) UNION ALL SELECT 'run_phase', p, CASE WHEN p = 'probing' THEN 1 ELSE 0 END FROM (SELECT unnest({PHASES}) AS p)""",
)
def run_metrics(history):
    return metrics.run_families(history, PHASES, "probing")


@query(["v_ranked", "v_assigned"], """WITH s AS (SELECT * FROM v_ranked WHERE channel_id % 3 = 0),
 u AS (SELECT channel_id, stream_id, ord, 0 AS part FROM s UNION ALL SELECT channel_id, stream_id, ord, 1 FROM v_assigned a WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.channel_id = a.channel_id AND s.stream_id = a.stream_id))
 SELECT channel_id, row_number() OVER (PARTITION BY channel_id ORDER BY part, ord) AS position, stream_id FROM u""")
def apply_order(ranked, assigned):
    return composition.applied(ranked.filter("channel_id % 3 = 0"), assigned)


@query(["v_ranked", "v_assigned"], """WITH s AS (SELECT channel_id, stream_id, ord FROM v_ranked WHERE channel_id % 3 = 0),
 n AS (SELECT * FROM s UNION ALL SELECT channel_id, stream_id, ord FROM v_assigned WHERE channel_id NOT IN (SELECT channel_id FROM s)),
 a AS (SELECT channel_id, list(stream_id ORDER BY ord) AS l FROM n GROUP BY 1), b AS (SELECT channel_id, list(stream_id ORDER BY ord) AS l FROM v_assigned GROUP BY 1)
 SELECT coalesce(a.channel_id, b.channel_id) AS channel_id FROM a FULL JOIN b ON a.channel_id = b.channel_id WHERE a.l IS DISTINCT FROM b.l""")
def orders_changed(ranked, assigned):
    before = assigned.select("channel_id", F.col("ord").alias("position"), "stream_id")
    return composition.changed(before, composition.applied(ranked.filter("channel_id % 3 = 0"), assigned, remove=True))


TAKEN_SQL = "WITH t AS (SELECT channel_id, stream_id, 2000 + ord AS blocked_at FROM v_ranked WHERE stream_id % 2 = 0), b AS (SELECT DISTINCT channel_id, stream_id, 1000 AS blocked_at FROM v_assigned WHERE stream_id % 6 = 0)"


def _taken(ranked, assigned):
    blocks = assigned.filter("stream_id % 6 = 0").select("channel_id", "stream_id", F.lit(1000).cast("bigint").alias("blocked_at")).distinct()
    return ranked.filter("stream_id % 2 = 0").select("channel_id", "stream_id", (2000 + F.col("ord")).cast("bigint").alias("blocked_at")), blocks


@query(["v_ranked", "v_assigned"], TAKEN_SQL + " SELECT channel_id, stream_id, ord FROM v_assigned WHERE (channel_id, stream_id) NOT IN (SELECT (channel_id, stream_id) FROM t)")
def unassign_streams(ranked, assigned):
    return composition.unassigned(assigned, _taken(ranked, assigned)[0]).select("channel_id", "stream_id", "ord")


BLOCKS_SQL = TAKEN_SQL + ", k AS (SELECT channel_id, stream_id, CAST(min(blocked_at) AS BIGINT) AS blocked_at FROM (SELECT * FROM b UNION ALL SELECT * FROM t WHERE (channel_id, stream_id) IN (SELECT (channel_id, stream_id) FROM v_assigned)) x GROUP BY 1, 2)"


@query(["v_ranked", "v_assigned"], BLOCKS_SQL + " SELECT * FROM k")
def assign_blocks(ranked, assigned):
    taken, blocks = _taken(ranked, assigned)
    return composition.blocked(blocks, taken, assigned)


@query(["v_ranked", "v_assigned"], BLOCKS_SQL + " SELECT channel_id, stream_id FROM v_ranked WHERE (channel_id, stream_id) NOT IN (SELECT (channel_id, stream_id) FROM k)")
def assign_eligible(ranked, assigned):
    taken, blocks = _taken(ranked, assigned)
    return composition.assignable(ranked, composition.blocked(blocks, taken, assigned)).select("channel_id", "stream_id")


@query(["v_assigned", "v_ranked"], "SELECT channel_id, ord, stream_id FROM v_assigned WHERE channel_id NOT IN (SELECT channel_id FROM v_ranked WHERE channel_id % 4 = 0) UNION ALL SELECT channel_id, ord, stream_id FROM v_ranked WHERE channel_id % 4 = 0")
def catalogue_update(assigned, ranked):
    return state.updated(assigned, ranked.filter("channel_id % 4 = 0").select("channel_id", "ord", "stream_id"), "channel_id")


@query(["v_assigned", "v_ranked"], "SELECT 'kept' AS outcome, channel_id, ord, stream_id FROM v_assigned UNION ALL SELECT 'replaced', channel_id, ord, stream_id FROM v_ranked")
def catalogue_replace(assigned, ranked):
    """All rows anew; where there are none to write, what was there stays."""
    new = ranked.select("channel_id", "ord", "stream_id")
    return state.replaced(assigned, new.filter("channel_id < 0")).withColumn("outcome", F.lit("kept")).unionByName(state.replaced(assigned, new).withColumn("outcome", F.lit("replaced")))


@query(
    ["v_group", "v_stream"],
    """WITH m AS (SELECT group_id, max(ms) AS ms FROM (SELECT group_id, 100 * group_id AS ms FROM v_group WHERE group_id % 2 = 0 UNION ALL SELECT group_id, 100 * group_id + 50 FROM v_group WHERE group_id % 3 = 0) x WHERE ms > 800 GROUP BY 1)
 SELECT stream_id, group_id, CAST(greatest(coalesce(ms, 0), 800) AS BIGINT) AS forced_at FROM v_stream LEFT JOIN m USING (group_id)""",
)
def forced_marks(groups, streams):
    i = F.col("group_id")
    old = groups.filter(i % 2 == 0).select("group_id", (100 * i).alias("forced_at"))
    new = groups.filter(i % 3 == 0).select("group_id", (100 * i + 50).alias("forced_at")).unionByName(groups.filter(i == 0).select(F.lit(-1).cast("bigint").alias("group_id"), F.lit(800).cast("bigint").alias("forced_at")))
    return state.with_forced(streams.select("stream_id", "group_id"), state.marked(old, new))


@query(
    ["v_group"],
    """WITH o AS (SELECT group_id AS ord, upper(group_name) AS pattern, 'always' AS mode, true AS require_live FROM v_group WHERE group_id < 15), n AS (SELECT group_id AS ord, group_name AS pattern, CASE WHEN group_id % 5 = 0 THEN 'always' ELSE 'never' END AS mode FROM v_group WHERE group_id >= 10)
 SELECT o.ord IS NULL AS appended, coalesce(o.ord, n.ord) AS ord, coalesce(n.pattern, o.pattern) AS pattern, coalesce(n.mode, o.mode) AS mode, o.require_live FROM o FULL JOIN n ON lower(n.pattern) = lower(o.pattern) WHERE n.mode IS DISTINCT FROM 'always'""",
)
def policy_upsert(groups):
    """Patterns by name without case; a policy set back to the default goes, and an old switch that the new row lacks stays."""
    i = F.col("group_id")
    old = groups.filter(i < 15).select(i.alias("ord"), F.upper("group_name").alias("pattern"), F.lit("always").alias("mode"), F.lit(True).alias("require_live"))
    new = groups.filter(i >= 10).select(i.alias("ord"), F.col("group_name").alias("pattern"), F.when(i % 5 == 0, "always").otherwise("never").alias("mode"), F.lit(None).cast("boolean").alias("require_live"))
    return state.upserted(old, new, [F.lower(F.trim("pattern"))], ["require_live"], F.col("mode") == "always")


@query(["v_job", "v_verdict_log"], """WITH h AS (SELECT DISTINCT channel_id, stream_id FROM v_job WHERE stream_id % 3 > 0), v AS (SELECT DISTINCT stream_id, 1 AS landed FROM v_verdict_log WHERE stream_id % 97 > 0)
 SELECT channel_id, count(*) AS hits, count(landed) AS landed, count(*) = count(landed) AS complete, count(*) = count(landed) AND channel_id % 5 <> 0 AS writable FROM h LEFT JOIN v USING (stream_id) GROUP BY 1""")
def channels_complete(jobs, log):
    hits = jobs.filter("stream_id % 3 > 0")
    return state.completed(hits, log.filter("stream_id % 97 > 0"), jobs.filter("channel_id % 5 = 0"))


@query(["v_job"], "SELECT stream_id, count(*) AS parts, count(*) FILTER (channel_id % 9 > 0) AS landed, count(*) = count(*) FILTER (channel_id % 9 > 0) AS settled FROM v_job GROUP BY 1")
def streams_settled(jobs):
    landed = F.count_if(F.col("channel_id") % 9 > 0)
    return jobs.groupBy("stream_id").agg(F.count(F.lit(1)).alias("parts"), landed.alias("landed"), (F.count(F.lit(1)) == landed).alias("settled"))


@query(
    ["v_sample", "v_job", "v_policy"],
    """WITH c AS (SELECT stream_id, min(channel_id) AS channel_id FROM v_job GROUP BY 1)
 SELECT s.stream_id, s.l_orderkey, s.l_linenumber, s.tie, s.provider_id, c.channel_id, coalesce(p.mode, 'always') AS mode FROM v_sample s LEFT JOIN c ON c.stream_id = s.stream_id LEFT JOIN v_policy p ON p.group_id = c.channel_id % 25""",
)
def sample_enrichment(samples, jobs, policies):
    """Samples with the first channel that has a job for the stream, and the policy of that channel's group."""
    first = jobs.groupBy("stream_id").agg(F.min("channel_id").alias("channel_id"))
    d = samples.select("stream_id", "l_orderkey", "l_linenumber", "tie", "provider_id").join(first, "stream_id", "left").withColumn("group_id", F.col("channel_id") % 25)
    return d.join(policies.select("group_id", "mode"), "group_id", "left").withColumn("mode", F.coalesce("mode", F.lit("always"))).drop("group_id")


@query(["v_stream", "v_group"], """SELECT g.group_id, CASE WHEN g.group_name ILIKE 'Brand#_3' THEN 'brand#?3' WHEN g.group_name ILIKE 'Brand#1%' THEN 'Brand#1*' END AS excluded_by, count(stream_id) AS streams FROM v_group g LEFT JOIN v_stream s ON s.group_id = g.group_id GROUP BY 1, 2""")
def group_exclusions(streams, groups):
    """Groups, the first glob of a list that names each, and how many streams they hold."""
    name = F.col("group_name")
    by = F.when(glob(name, "brand#?3"), "brand#?3").when(glob(name, "Brand#1*"), "Brand#1*")
    per = streams.groupBy("group_id").agg(F.count(F.lit(1)).alias("streams"))
    return groups.join(per, "group_id", "left").select("group_id", by.alias("excluded_by"), F.coalesce("streams", F.lit(0)).alias("streams"))
