"""Queries about names and rules.

The SQL beside them takes names apart by how the fixture puts them together (six sections, eight tails), not by parsing.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import names
from tidemark.operators import matching
from tidemark.operators.gate import glob
from tidemark.plans.registry import query

REGIONS = ["AU"]
PATTERNS = [(7, 5, "(?i)^us: .*ring", None)]
PARTS = """p AS (SELECT s.stream_id, s.provider_id, s.group_id, s.name, p_name, upper(p_name) AS up, [' FHD', ' 4K HEVC', ' HD 50fps', ' 1080p', ' [Multi]', ' SD TH', ' +1', ''][1 + k] AS sfx, k,
  ['US', 'UK', 'AU', 'Radio', '', ''][1 + s.stream_id % 6] AS px FROM (SELECT *, CAST((stream_id - stream_id % 6) / 6 AS BIGINT) % 8 AS k FROM v_stream) s JOIN part ON p_partkey = s.stream_id)"""
RULES_SQL = (
    PARTS + """, open AS (SELECT * FROM p WHERE group_id NOT IN (SELECT group_id FROM v_group WHERE group_name ILIKE 'Brand#1%')),
 alias AS (SELECT channel_id, o.*, CASE WHEN channel_id % 4 = 0 AND px <> 'US' THEN 1 ELSE 0 END AS step FROM v_channel c JOIN open o ON o.p_name = c.name WHERE k <> 6
  AND (channel_id % 4 <> 1 OR k <> 1) AND (channel_id % 4 <> 2 OR k IN (0, 3))),
 needle AS (SELECT channel_id, o.*, 1 AS step FROM v_channel c JOIN open o ON list_contains(string_split(o.p_name, ' '), string_split(c.name, ' ')[2]) WHERE channel_id % 16 = 5),
 rx AS (SELECT 7 AS channel_id, o.*, 5 AS step FROM open o WHERE px = 'US' AND contains(name, 'RING')),
 hits AS (SELECT * FROM alias UNION ALL SELECT * FROM needle UNION ALL SELECT * FROM rx),
 passed AS (SELECT * FROM hits WHERE k <> 6 AND px NOT IN ('Radio', 'AU') AND EXISTS (SELECT 1 FROM v_channel c WHERE c.channel_id = hits.channel_id)),
 out AS (SELECT * FROM passed WHERE channel_id % 8 = 3 AND k = 2)"""
)


def _rule_lines(channels):
    def when(keep, kind, position, line):
        row = F.struct(F.lit(kind).alias("kind"), F.lit(position).cast("bigint").alias("position"), line.alias("line"))
        return F.when(keep, row)

    c, name = F.col("channel_id"), F.col("name")
    rows = [
        when(c % 4 == 0, "alias", 0, F.concat(F.lit("@US "), name)),
        when(c % 4 == 0, "alias", 1, name),
        when(c % 4 == 1, "alias", 0, F.concat(name, F.lit(" ~!4k"))),
        when(c % 4 == 2, "alias", 0, F.concat(name, F.lit(" ~1080p"))),
        when(c % 4 == 3, "alias", 0, F.initcap(name)),
        when(c % 8 == 3, "exclude", 0, F.lit("hd")),
        when(c % 16 == 5, "contains", 0, F.element_at(F.split(name, " "), 2)),
    ]
    lines = channels.select("channel_id", F.explode(F.array_compact(F.array(*rows))).alias("r")).select("channel_id", "r.*")
    scope = [F.lit(None).cast("array<bigint>").alias("providers"), F.lit(None).cast("array<string>").alias("exclude_regions")]
    return channels.select("channel_id", F.lit(0).cast("bigint").alias("step_order"), *scope), lines


def _countries(df):
    return names.country_codes(df.sparkSession)


def _matched(channels, streams, groups):
    rules, lines = _rule_lines(channels)
    countries = _countries(streams)
    out = groups.filter(glob(F.col("group_name"), "Brand#1*"))
    return matching.matched(rules, lines, PATTERNS, matching.Catalogue.of(streams, countries, "v_stream"), out, countries, REGIONS)


VIEWS = ["v_channel", "v_stream", "v_group"]


@query(
    ["v_stream"],
    f"""WITH {PARTS} SELECT stream_id, CASE WHEN k = 6 THEN up || ' + 1' ELSE up END AS clean, CASE WHEN k = 6 THEN replace(p_name, ' ', '') || '+1' ELSE replace(p_name, ' ', '') END AS key, px AS prefixes,
 CASE k WHEN 0 THEN 'fhd' WHEN 1 THEN 'uhd' WHEN 2 THEN 'hd' WHEN 3 THEN 'fhd' WHEN 5 THEN 'sd' ELSE '' END AS tier,
 CAST(CASE k WHEN 0 THEN 1080 WHEN 1 THEN 2160 WHEN 2 THEN 720 WHEN 3 THEN 1080 WHEN 5 THEN 480 ELSE 0 END AS BIGINT) AS height, CASE k WHEN 1 THEN 'hevc' ELSE '' END AS codec,
 CAST(CASE k WHEN 2 THEN 50 ELSE 0 END AS BIGINT) AS fps, CASE k WHEN 5 THEN 'TH' ELSE '' END AS regions, CASE k WHEN 4 THEN 'Multi' ELSE '' END AS brackets, k = 6 AS timeshift FROM p""",
)
def normalize_names(streams):
    flat = [F.array_join(c, "|").alias(c) for c in ("prefixes", "regions", "brackets")]
    return matching.prepared(streams, _countries(streams)).select("stream_id", "clean", "key", "tier", "height", "codec", "fps", "timeshift", *flat)


@query(["v_channel", "v_stream"], f"WITH {PARTS} SELECT channel_id, stream_id FROM v_channel c JOIN p ON p.p_name = c.name WHERE k <> 6")
def match_alias(channels, streams):
    countries = _countries(streams)
    lines = matching.stored(matching.compiled(channels.select("channel_id", F.lit("alias").alias("kind"), F.lit(0).alias("position"), F.initcap("name").alias("line")), countries))
    known = matching.Catalogue.of(streams, countries, "v_stream")
    return known.bearing(matching.by_key(lines, known.names).select("channel_id", "name_id")).select("channel_id", "stream_id")


@query(["v_channel", "v_stream"], f"WITH {PARTS} SELECT channel_id, stream_id FROM v_channel c JOIN p ON p.p_name = c.name WHERE k <> 6")
def match_sections(channels, streams):
    """Aliases of the second word that require the first word as a section."""
    countries = _countries(streams)
    line = F.concat(F.lit("@"), F.element_at(F.split("name", " "), 1), F.lit(" "), F.element_at(F.split("name", " "), 2))
    lines = matching.stored(matching.compiled(channels.select("channel_id", F.lit("alias").alias("kind"), F.lit(0).alias("position"), line.alias("line")), countries))
    known = matching.Catalogue.of(streams, countries, "v_stream")
    return known.bearing(matching.by_section(lines, known.names).select("channel_id", "name_id")).select("channel_id", "stream_id")


@query(["v_channel", "v_stream"], f"WITH {PARTS} SELECT channel_id, stream_id FROM v_channel c JOIN p ON list_contains(string_split(p.p_name, ' '), string_split(c.name, ' ')[2]) WHERE channel_id % 16 = 5")
def match_contains(channels, streams):
    countries = _countries(streams)
    rules, lines = _rule_lines(channels)
    needles = matching.stored(matching.compiled(lines.filter("kind = 'contains'"), countries))
    known = matching.Catalogue.of(streams, countries, "v_stream")
    return known.bearing(matching.by_needle(needles, known.names, known.index).select("channel_id", "name_id")).select("channel_id", "stream_id")


@query(["v_stream"], f"WITH {PARTS} SELECT CAST(7 AS BIGINT) AS channel_id, CAST(5 AS BIGINT) AS step, stream_id FROM p WHERE px = 'US' AND contains(name, 'RING')")
def match_regex(streams):
    known = matching.Catalogue.of(streams, _countries(streams), "v_stream")
    met = matching.patterns_met(PATTERNS, known.names.select("name_id", "name"), known.index)
    return known.bearing(met).filter(matching.admitted("only")).select("channel_id", "step", "stream_id")


@query(VIEWS, f"WITH {RULES_SQL} SELECT channel_id, stream_id, CAST(min(step) AS BIGINT) AS step FROM passed WHERE (channel_id, stream_id) NOT IN (SELECT (channel_id, stream_id) FROM out) GROUP BY 1, 2")
def match_best_step(channels, streams, groups):
    return _matched(channels, streams, groups)


@query(VIEWS, f"WITH {RULES_SQL} SELECT stream_id, min(channel_id) AS channel_id FROM passed WHERE (channel_id, stream_id) NOT IN (SELECT (channel_id, stream_id) FROM out) GROUP BY 1")
def claimed_by(channels, streams, groups):
    return _matched(channels, streams, groups).groupBy("stream_id").agg(F.min("channel_id").alias("channel_id"))


@query(VIEWS, f"WITH {RULES_SQL} SELECT c.channel_id, count(DISTINCT o.stream_id) AS links FROM v_channel c LEFT JOIN (SELECT * FROM passed WHERE (channel_id, stream_id) NOT IN (SELECT (channel_id, stream_id) FROM out)) o ON o.channel_id = c.channel_id GROUP BY 1")
def group_rollup(channels, streams, groups):
    links = _matched(channels, streams, groups).groupBy("channel_id").agg(F.count(F.lit(1)).alias("links"))
    return channels.select("channel_id").join(links, "channel_id", "left").select("channel_id", F.coalesce("links", F.lit(0)).alias("links"))


@query(["v_group"], "SELECT group_id, group_name FROM v_group WHERE group_name ILIKE 'Brand#1%' OR group_name ILIKE 'Brand#_3'")
def excluded_groups(groups):
    return groups.filter(glob(F.col("group_name"), "brand#1*") | glob(F.col("group_name"), "Brand#?3")).select("group_id", "group_name")


@query(
    ["v_stream"],
    f"""WITH {PARTS}, f AS (SELECT *, CASE WHEN k = 6 THEN replace(p_name, ' ', '') || '+1' ELSE replace(p_name, ' ', '') END AS key FROM p WHERE contains(lower(name), 'ring')),
 n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY stream_id) AS n FROM f)
 SELECT key, count(*) AS streams, array_to_string(list_sort(list(DISTINCT CAST(provider_id AS VARCHAR))), ',') AS providers, max(name) FILTER (n = 1) AS sample_1, max(name) FILTER (n = 2) AS sample_2, max(name) FILTER (n = 3) AS sample_3 FROM n GROUP BY 1""",
)
def stream_search(streams):
    return matching.search(matching.Catalogue.of(streams, _countries(streams), "v_stream"), "ring")


@query(["v_stream"], f"WITH {PARTS} SELECT stream_id, CASE k WHEN 0 THEN 'fhd' WHEN 1 THEN 'uhd' WHEN 2 THEN 'hd' WHEN 3 THEN 'fhd' WHEN 5 THEN 'sd' ELSE 'unknown' END AS tier FROM p")
def name_tiers(streams):
    return streams.select("stream_id", names.tier_of(F.col("name")).alias("tier"))
