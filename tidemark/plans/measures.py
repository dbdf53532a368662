"""Queries about probes, learned effects and provider metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import probing
from tidemark.operators import composition, effects, metrics, quality, verdicts
from tidemark.plans.registry import BEST_SQL, D, query

NOW = 1_000_000_000_000


@query(
    ["v_probe"],
    """SELECT ['other', 'probe_error', 'rejected', 'unsupported', 'auth', 'not_found', 'server_error', 'timeout', 'unreachable', 'other'][1 + probe_id % 10] AS reason, count(*) AS probes
 FROM v_probe GROUP BY 1""",
)
def dead_reason_classify(probes):
    return probes.groupBy(probing.dead_reason(F.col("error")).alias("reason")).agg(F.count(F.lit(1)).alias("probes"))


@query(["v_probe"], f"SELECT probe_id, CASE probe_id % 6 WHEN 0 THEN {D(25)} WHEN 1 THEN {D(29.97)} WHEN 4 THEN {D(50)} ELSE {D(0)} END AS fps FROM v_probe")
def fps_parse(probes):
    return probes.select("probe_id", probing.frames(F.col("rate")).alias("fps"))


@query(
    ["v_probe"],
    f"""SELECT probe_id, v AS alive, CAST(CASE WHEN v THEN 1920 ELSE 0 END AS BIGINT) AS width, CAST(CASE WHEN v THEN 1080 ELSE 0 END AS BIGINT) AS height, CASE WHEN v THEN {D(25)} ELSE {D(0)} END AS fps,
 CASE WHEN NOT v THEN {D(0)} WHEN probe_id % 3 = 0 THEN {D(384)} ELSE floor((probe_id * 7) / {D(1000)} * 100 + {D(0.5)}) / 100 END AS bitrate_kbps,
 CASE WHEN v THEN 'h264' ELSE '' END AS video_codec, CASE WHEN v THEN 'ac3' ELSE '' END AS audio_codec, CAST(CASE WHEN v THEN 6 ELSE 0 END AS BIGINT) AS audio_channels,
 CASE WHEN v THEN {D(384)} ELSE {D(0)} END AS audio_bitrate_kbps, CAST(CASE WHEN v THEN 48000 ELSE 0 END AS BIGINT) AS audio_sample_rate, '' AS pixel_format, '' AS channel_layout FROM (SELECT *, probe_id % 5 <> 0 AS v FROM v_probe) p""",
)
def probe_payload_parse(probes):
    return probes.select("probe_id", probing.parsed(F.col("payload")).alias("p")).select("probe_id", "p.*")


@query(["v_probe"], f"SELECT probe_id, probe_id + {D(0.5)} AS bitrate_kbps, {D(1.25)} + {D(1.125)} + probe_id % 4 AS black_seconds FROM v_probe")
def sample_stderr_parse(probes):
    return probes.select("probe_id", probing.sampled(F.col("stderr")).alias("s")).select("probe_id", "s.*")


@query(["v_probe"], r"SELECT probe_id, regexp_replace(url, '//old([0-9])\.', '//new\1.', 'g') AS url FROM v_probe")
def url_rewrite(probes):
    return probes.select("probe_id", F.regexp_replace("url", r"//old([0-9])\.", "//new$1.").alias("url"))


@query(["v_probe"], "SELECT probe_id, 'http://edge.example/live/u2/p2/' || CAST(probe_id AS VARCHAR) || '.ts' AS url FROM v_probe")
def xtream_url(probes):
    moved = F.regexp_replace("url", r"^http://[^/]+/live/[^/]+/[^/]+/", "http://edge.example/x/u2/p2/")
    return probes.select("probe_id", probing.playback_url(F.col("url"), moved).alias("url"))


def _fitted(samples):
    names = samples.groupBy("provider_id", "group_id").agg(F.min("provider_name").alias("provider_name"), F.min("group_name").alias("group_name"))
    b = quality.buckets(samples).filter("samples >= 3 AND NOT audio_only").join(names, ["provider_id", "group_id"])
    return effects.fitted(b)


@query(["v_sample"], "")
def quality_effects(samples):
    """Iterative; tests hold it against a brute-force fit."""
    return _fitted(samples)


@query(["v_sample"], "")
def quality_rules_export(samples):
    return effects.rules(_fitted(samples), {t: f"(?i).*{t}.*" for t in ("uhd", "fhd", "hd", "sd")})


MERGE_SQL = """WITH e AS (SELECT ord, t AS type, ' Supplier#' || ord AS value, 99 AS priority, 'score' AS mode, CAST(1 AS BIGINT) AS points FROM (SELECT group_id AS ord, CASE WHEN group_id % 2 = 0 THEN 'm3u' ELSE 'group' END AS t FROM v_group) x),
 g AS (SELECT group_id AS ord, 'm3u' AS type, 'supplier#' || (group_id % 15 + 5) AS value, 99 AS priority, 'score' AS mode, group_id AS points FROM v_group),
 n AS (SELECT value, arg_max(points, ord) AS points, min(ord) AS ord FROM g GROUP BY 1)
 SELECT e.ord IS NULL AS appended, coalesce(e.ord, n.ord) AS ord, e.ord IS NOT NULL AND n.ord IS NOT NULL AS replaced, coalesce(CASE WHEN n.ord IS NOT NULL THEN 'm3u' END, e.type) AS type, coalesce(n.value, e.value) AS value,
 99 AS priority, 'score' AS mode, coalesce(n.points, e.points) AS points FROM e FULL JOIN n ON e.type = 'm3u' AND lower(trim(e.value)) = n.value"""


@query(["v_group"], MERGE_SQL)
def quality_rules_merge(groups):
    i = F.col("group_id")
    fixed = [F.lit(99).alias("priority"), F.lit("score").alias("mode")]
    old = groups.select(i.alias("ord"), F.when(i % 2 == 0, "m3u").otherwise("group").alias("type"), F.concat(F.lit(" Supplier#"), i.cast("string")).alias("value"), *fixed, F.lit(1).cast("bigint").alias("points"))
    new = groups.select(i.alias("ord"), F.lit("m3u").alias("type"), F.concat(F.lit("supplier#"), (i % 15 + 5).cast("string")).alias("value"), *fixed, i.alias("points"))
    return effects.merged(old, new)


METRICS = ["v_assigned", "v_stream", "v_provider", "v_verdict_log"]
STREAMS_SQL = BEST_SQL + """, cat AS (SELECT a.channel_id, a.ord - 1 AS slot, a.stream_id, s.provider_id FROM v_assigned a JOIN v_stream s ON s.stream_id = a.stream_id),
 st AS (SELECT c.provider_id, c.stream_id, b.probed_at, b.usable, b.score, b.bitrate_kbps, CASE WHEN b.stream_id IS NULL THEN 'unmeasured' WHEN NOT alive THEN 'dead' WHEN black THEN 'black' WHEN bitrate_kbps > 0 AND bitrate_kbps < 500 THEN 'low_bitrate' ELSE 'alive' END AS state, height
  FROM (SELECT DISTINCT provider_id, stream_id FROM cat) c LEFT JOIN best b ON b.stream_id = c.stream_id),
 res AS (SELECT *, CASE WHEN state IN ('dead', 'unmeasured') THEN 'unknown' WHEN height >= 2160 THEN 'uhd' WHEN height >= 1080 THEN 'fhd' WHEN height >= 720 THEN 'hd' WHEN height > 0 THEN 'sd' ELSE 'unknown' END AS resolution FROM st)"""


def _zero_filled(column: str, values: list[str]) -> str:
    spine = f"(SELECT DISTINCT provider_id FROM res) p, (SELECT unnest({values}) AS v) e"
    return f" SELECT p.provider_id, e.v AS {column}, count(r.stream_id) AS streams FROM {spine} LEFT JOIN res r ON r.provider_id = p.provider_id AND r.{column} = e.v GROUP BY 1, 2"


def _catalogue(assigned, streams, providers):
    return composition.catalogue(assigned, streams, providers)


def _best(log):
    return verdicts.best_of_stream(verdicts.scored(verdicts.latest(log)))


def _streams(assigned, streams, providers, log):
    return metrics.provider_streams(_catalogue(assigned, streams, providers), _best(log))


@query(METRICS, STREAMS_SQL + _zero_filled("state", metrics.STATES))
def provider_stream_states(*t):
    return metrics.histogram(_streams(*t), "state", metrics.STATES)


@query(METRICS, STREAMS_SQL + _zero_filled("resolution", metrics.RESOLUTIONS))
def provider_resolutions(*t):
    return metrics.histogram(_streams(*t), "resolution", metrics.RESOLUTIONS)


@query(METRICS, STREAMS_SQL + " SELECT provider_id, resolution, median(bitrate_kbps) AS median_kbps FROM (SELECT provider_id, bitrate_kbps, resolution FROM res UNION ALL SELECT provider_id, bitrate_kbps, 'all' FROM res) x WHERE bitrate_kbps > 0 GROUP BY 1, 2")
def provider_bitrate_median(*t):
    return metrics.bitrate_medians(_streams(*t))


@query(METRICS, STREAMS_SQL + " SELECT provider_id, median(score) AS median_score FROM res WHERE usable GROUP BY 1")
def provider_score_median(*t):
    return _streams(*t).filter("usable").groupBy("provider_id").agg(F.median("score").alias("median_score"))


@query(METRICS, STREAMS_SQL + f" SELECT provider_id, median({NOW} - probed_at) AS median_age, max({NOW} - probed_at) AS oldest_age FROM res WHERE probed_at IS NOT NULL GROUP BY 1")
def provider_verdict_age(*t):
    return metrics.ages(_streams(*t), NOW)


@query(METRICS, STREAMS_SQL + " SELECT cat.provider_id, count(*) AS channels, count(*) FILTER (b.usable) AS healthy FROM cat LEFT JOIN best b ON b.stream_id = cat.stream_id WHERE slot = 0 GROUP BY 1")
def provider_rank1(assigned, streams, providers, log):
    return metrics.rank1(_catalogue(assigned, streams, providers), _best(log))


@query(METRICS, STREAMS_SQL + " SELECT channel_id, slot, cat.stream_id, cat.provider_id, r.state, coalesce(r.height, 0) AS height, coalesce(r.bitrate_kbps, 0) AS bitrate_kbps FROM cat JOIN res r ON r.stream_id = cat.stream_id")
def channel_sources(assigned, streams, providers, log):
    d = _catalogue(assigned, streams, providers).join(_best(log).select("stream_id", "alive", "black", "probed_at", "height", "bitrate_kbps"), "stream_id", "left")
    return d.select("channel_id", "slot", "stream_id", "provider_id", metrics.state().alias("state"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("height", "bitrate_kbps")])


HELP = "Distinct streams by state."


@query(
    METRICS,
    STREAMS_SQL + f""", h AS ({_zero_filled("state", metrics.STATES)})
 SELECT 'tidemark_provider_streams' AS family, 2::BIGINT AS line_no, 'tidemark_provider_streams{{provider="' || provider_id || '",state="' || state || '"}} ' || streams AS line FROM h
 UNION ALL SELECT 'tidemark_provider_streams', 0, '# HELP tidemark_provider_streams {HELP}' UNION ALL SELECT 'tidemark_provider_streams', 1, '# TYPE tidemark_provider_streams gauge'""",
)
def metrics_text(*t):
    h = metrics.histogram(_streams(*t), "state", metrics.STATES).withColumnRenamed("provider_id", "provider")
    return metrics.exposition(h, "tidemark_provider_streams", "gauge", HELP, ["provider", "state"], "streams")
