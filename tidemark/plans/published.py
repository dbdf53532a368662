"""Queries about what is published: stats of streams, ranks by alias step, and rules documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import probing, texts
from tidemark.operators import effects, probes, published, verdicts
from tidemark.plans.matching import RULES_SQL, VIEWS, _matched
from tidemark.plans.registry import BEST_SQL, D, query
from tidemark.sources import rules


@query(
    ["v_probe"],
    f"""WITH b AS (SELECT probe_id, probe_id % 5 <> 0 AS v, probe_id % 13 <> 6 AS s, probe_id + {D(0.5)} AS r, CASE WHEN probe_id % 3 = 0 THEN {D(384)} ELSE floor((probe_id * 7) / {D(1000)} * 100 + {D(0.5)}) / 100 END AS declared, {D(1.25)} + {D(1.125)} + probe_id % 4 AS black_s FROM v_probe),
 c AS (SELECT *, CASE WHEN NOT v THEN {D(0)} WHEN s THEN r ELSE declared END AS kbps, v AND s AND black_s >= {D(4.5)} AS black FROM b),
 d AS (SELECT *, v AND NOT black AND (kbps <= 0 OR kbps >= 500) AS usable FROM c)
 SELECT probe_id, CAST(CASE WHEN v THEN 1920 ELSE 0 END AS BIGINT) AS width, CAST(CASE WHEN v THEN 1080 ELSE 0 END AS BIGINT) AS height, CASE WHEN v THEN '1920x1080' ELSE '0x0' END AS resolution, CASE WHEN v THEN {D(25)} ELSE {D(0)} END AS source_fps,
 CASE WHEN v THEN 'h264' ELSE '' END AS video_codec, CASE WHEN v THEN 'ac3' ELSE '' END AS audio_codec, '' AS pixel_format, CAST(CASE WHEN v THEN 6 ELSE 0 END AS BIGINT) AS audio_channels, '' AS channel_layout,
 CAST(CASE WHEN v THEN 384 ELSE 0 END AS BIGINT) AS audio_bitrate, CAST(CASE WHEN v THEN 48000 ELSE 0 END AS BIGINT) AS sample_rate, CAST(floor(kbps + {D(0.5)}) AS BIGINT) AS video_bitrate, CAST(floor(kbps + {D(0.5)}) AS BIGINT) AS ffmpeg_output_bitrate,
 v AND s AS bitrate_measured, black AS blank_detected, CASE WHEN v AND s THEN floor(black_s * 100 + {D(0.5)}) / 100 ELSE {D(0)} END AS blank_seconds,
 CASE WHEN usable THEN floor(least(((((least(1080 / {D(2160)}, 1) * {D(0.35)} + least(kbps / {D(12000)}, 1) * {D(0.4)}) + least(25 / {D(60)}, 1) * {D(0.15)}) + {D(0.5)} * {D(0.1)}) + {D(0)}) / {D(1)}, 1) * 10000 + {D(0.5)}) / 10000 ELSE {D(0)} END AS quality_score,
 v AS alive, CASE WHEN NOT v THEN CASE WHEN probe_id % 10 = 0 THEN 'dead' ELSE 'HTTP error 404 Not Found' END WHEN black THEN 'black screen' ELSE 'ok' END AS quality_reason, 'tidemark' AS probed_by, '2001-09-09T01:46:40.000Z' AS probed_at FROM d""",
)
def stats_payload(p):
    """All published fields of each probe's merged and scored verdict."""
    d = p.select("probe_id", "error", probing.parsed(F.col("payload")).alias("p"), F.when(F.col("probe_id") % 13 != 6, probing.sampled(F.col("stderr"))).alias("s"), F.lit(False).alias("truncated"), F.lit(1).alias("remaining_ms"))
    own = [c for c in ("width", "height", "fps", "video_codec", "audio_codec", "audio_channels", "audio_bitrate_kbps", "audio_sample_rate", "pixel_format", "channel_layout")]
    v = probes.merged(d).select("probe_id", "error", "alive", "bitrate_kbps", "bitrate_measured", F.coalesce("black", F.lit(False)).alias("black"), "black_seconds", *[F.col(f"p.{c}").alias(c) for c in own])
    at = F.date_format(F.timestamp_millis(F.lit(1_000_000_000_000)), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    scored = verdicts.scored(v)
    return scored.select("probe_id", *[c.alias(k) for k, c in published.stats(scored, "tidemark", at).items()])


@query(
    [*VIEWS, "v_verdict_log"],
    BEST_SQL + f""", {RULES_SQL}, m AS (SELECT channel_id, stream_id, min(step) AS step FROM passed WHERE (channel_id, stream_id) NOT IN (SELECT (channel_id, stream_id) FROM out) GROUP BY 1, 2)
 SELECT channel_id, stream_id, row_number() OVER (PARTITION BY channel_id ORDER BY usable DESC, step, (bitrate_kbps > 0) DESC, score DESC, stream_id) AS place FROM m JOIN best USING (stream_id)""",
)
def rank_alias(channels, streams, groups, log):
    """Ranks of each channel's claimed streams where the step at which its rule claimed them comes before quality."""
    best = verdicts.best_of_stream(verdicts.scored(verdicts.latest(log))).join(_matched(channels, streams, groups), "stream_id")
    return verdicts.ranked(best, ["channel_id"], [F.col("step")]).select("channel_id", "stream_id", "place")


ENVELOPE_SQL = """WITH e AS (SELECT group_id AS ord, CASE WHEN group_id % 2 = 0 THEN 'm3u' ELSE 'group' END AS type, CASE WHEN group_id % 9 <> 5 THEN ' Supplier#' || group_id END AS value FROM v_group),
 g AS (SELECT DISTINCT group_id % 15 + 5 AS k FROM v_group)
 SELECT (SELECT count(value) FROM e) AS existing, (SELECT count(*) - count(value) FROM e) AS skipped, (SELECT count(*) FROM v_group) AS generated,
 (SELECT count(value) FROM e) + (SELECT count(*) FROM v_group) - ((SELECT count(value) FROM e) + (SELECT count(*) FROM g WHERE k NOT IN (SELECT ord FROM e WHERE type = 'm3u' AND value IS NOT NULL))) AS replaced"""


@query(["v_group"], ENVELOPE_SQL)
def rules_envelope(groups):
    i = F.col("group_id")
    fixed = [F.lit(99).alias("priority"), F.lit("score").alias("mode")]
    name = F.when(i % 9 != 5, F.concat(F.lit(" Supplier#"), i.cast("string")))
    old = groups.select(i.alias("ord"), F.when(i % 2 == 0, "m3u").otherwise("group").alias("type"), name.alias("value"), *fixed, F.lit(1).cast("bigint").alias("points"))
    new = groups.select(i.alias("ord"), F.lit("m3u").alias("type"), F.concat(F.lit("supplier#"), (i % 15 + 5).cast("string")).alias("value"), *fixed, i.alias("points"))
    return published.envelope(old, new).drop("rules")


@query(
    ["v_group"],
    f"""SELECT CASE group_id % 3 WHEN 0 THEN 'm3u' WHEN 1 THEN 'group' ELSE 'regex' END AS type, CASE WHEN group_id % 3 = 2 THEN '(?i).*4K.*' ELSE group_name END AS value, 99 AS priority, 'score' AS mode, p AS points
 FROM (SELECT *, CAST(greatest(-15, least(15, floor((group_id * 400 - 4200) / {D(1000)} * {D(5)} + {D(0.5)}))) AS BIGINT) AS p FROM v_group) x WHERE group_id >= 4 AND p <> 0 AND NOT (group_id % 3 = 2 AND group_id % 2 = 0)""",
)
def effect_rules(groups):
    """Rules and points of given effects: small samples, the unknown tier and no points give none."""
    i = F.col("group_id")
    factor = F.when(i % 3 == 0, "provider_name").when(i % 3 == 1, "group_name").otherwise("tier")
    key = F.when(i % 3 < 2, F.col("group_name")).when(i % 2 == 0, "unknown").otherwise("uhd")
    d = groups.select(factor.alias("factor"), key.alias("key"), (i * 5).alias("samples"), (i * 400 - 4200).alias("delta_kbps"))
    return effects.rules(d, {"uhd": "(?i).*4K.*"})


@query(
    ["v_option"],
    """SELECT option_id, CASE WHEN raw IS NULL THEN true ELSE trim(raw) IN ('1', 'true', 'yes', 'on') END AS event_only, CASE WHEN raw IS NULL THEN ['Brand#3*'] ELSE list_filter([trim(raw)], lambda x: x <> '') END AS include FROM v_option""",
)
def scope_overridden(options):
    return options.select("option_id", *rules.scope_override(F.lit(True), F.array(F.lit("Brand#3*")), F.col("raw"), F.col("raw")))


@query(["v_group"], "SELECT group_id, '(?i).*' || group_name || '.*' AS value FROM v_group")
def scoring_patterns(groups):
    return groups.select("group_id", texts.anywhere(F.col("group_name")).alias("value"))
