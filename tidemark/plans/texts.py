"""Queries over texts: patterns, urls, hosts, options and how values are shown."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import texts
from tidemark.plans.registry import D, query

ALLOWED = ["media.example", ".trusted.example"]
AGE_NOW = 789_300_000_000


@query(["v_stream"], "SELECT stream_id, '(?i).*' || group_name || '.*' AS pattern, regexp_matches(name, '^[A-Z |:]+$') AS upper_only, length(regexp_extract(name, '[A-Z]+')) = length(name) AS one_word FROM v_stream")
def name_patterns(streams):
    return streams.select("stream_id", texts.anywhere(F.col("group_name")).alias("pattern"), texts.matches_fully(F.col("name"), "[A-Z |:]+").alias("upper_only"), texts.matches_fully(F.col("name"), "[A-Z]+").alias("one_word"))


@query(["v_url"], """SELECT stream_id, CASE stream_id % 4 WHEN 0 THEN 'empty url' WHEN 1 THEN 'refusing a url that begins with "-"' ELSE '' END AS fault FROM v_url""")
def url_faults(urls):
    url = F.when(F.col("stream_id") % 4 == 0, F.when(F.col("stream_id") % 8 == 0, "  ")).when(F.col("stream_id") % 4 == 1, F.concat(F.lit("-"), "url")).otherwise(F.col("url"))
    return urls.select("stream_id", texts.url_fault(url).alias("fault"))


@query(
    ["v_host"],
    f"""SELECT host_id, h AS host, h IS NULL OR h = '{ALLOWED[0]}' OR suffix(h, '{ALLOWED[1]}') OR (strpos(h, '.') = 0 AND strpos(h, ':') = 0) OR regexp_matches(h, '[.](localhost|local|lan|home|home[.]arpa|internal|localdomain|ts[.]net)$')
  OR regexp_full_match(h, '(::ffff:)?(127|10)[.][0-9]+[.][0-9]+[.][0-9]+') OR regexp_full_match(h, '(::ffff:)?192[.]168[.][0-9]+[.][0-9]+') AND NOT regexp_matches(h, '[.](2[6-9][0-9]|[3-9][0-9][0-9])') OR regexp_full_match(h, '172[.](1[6-9]|2[0-9]|3[01])[.][0-9]+[.][0-9]+') OR regexp_full_match(h, '100[.](6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])[.][0-9]+[.][0-9]+')
  OR regexp_full_match(h, '169[.]254[.][0-9]+[.][0-9]+') OR h IN ('::1', '::') OR regexp_matches(h, '^f[cd][0-9a-f]{{0,2}}:') OR regexp_matches(h, '^fe[89ab][0-9a-f]?:') AS allowed
 FROM (SELECT host_id, CASE WHEN trim(header) = '' THEN NULL WHEN trim(header) LIKE '[%' THEN nullif(lower(regexp_extract(trim(header), '^\\[([^\\]]*)\\]', 1)), '')
  WHEN length(header) - length(replace(header, ':', '')) = 1 THEN nullif(lower(split_part(trim(header), ':', 1)), '') ELSE lower(trim(header)) END AS h FROM v_host)""",
)
def hosts_allowed(hosts):
    h = hosts.select("host_id", texts.host_of(F.col("header")).alias("host"))
    return h.withColumn("allowed", texts.allowed_host(F.col("host"), ALLOWED))


@query(["v_host"], """SELECT host_id, CASE WHEN host_id % 5 = 0 THEN '' WHEN host_id % 5 = 1 THEN NULL WHEN host_id % 5 = 2 THEN '' ELSE 'h' || host_id || '.example' END AS host FROM v_host""")
def origin_hosts(hosts):
    i = F.col("host_id").cast("string")
    origin = F.when(F.col("host_id") % 5 == 0, "null").when(F.col("host_id") % 5 == 1, " ").when(F.col("host_id") % 5 == 2, "no url").when(F.col("host_id") % 5 == 3, F.concat(F.lit("https://H"), i, F.lit(".example:8443/x")))
    return hosts.select("host_id", texts.origin_host(origin.otherwise(F.concat(F.lit("http://u@h"), i, F.lit(".example")))).alias("host"))


@query(["v_group"], "SELECT group_id, ['a.example', 'fe80::1', 'g' || group_id] AS hosts FROM v_group")
def host_lists(groups):
    return groups.select("group_id", texts.host_list(F.concat(F.lit(" A.example:80,\n[FE80::1]:9  ,, G"), F.col("group_id").cast("string"))).alias("hosts"))


@query(["v_profile"], "SELECT profile_id, provider_id || ':' || profile_id AS lane FROM v_profile")
def lane_keys(profiles):
    return profiles.select("profile_id", texts.lane_key(F.col("provider_id"), F.col("profile_id")).alias("lane"))


RATE_SQL = "CASE WHEN {x} >= 1000 THEN (t // 10) || '.' || (t % 10) || ' Mbps' ELSE {x} || ' kbps' END"


@query(
    ["v_verdict_log"],
    f"""SELECT bitrate_kbps, {RATE_SQL.format(x='bitrate_kbps')} AS rate, CASE WHEN d > 0 THEN '+' WHEN d < 0 THEN '−' ELSE '' END || CASE WHEN abs(d) >= 1000 THEN (u // 10) || '.' || (u % 10) || ' Mbps' ELSE abs(d) || ' kbps' END AS delta,
 CASE WHEN d >= 500 THEN 'good' WHEN d <= -500 THEN 'bad' ELSE 'muted' END AS tone, count(*) AS verdicts
 FROM (SELECT *, (bitrate_kbps + 50) // 100 AS t, bitrate_kbps - 3000 AS d, (abs(bitrate_kbps - 3000) + 50) // 100 AS u FROM v_verdict_log) GROUP BY ALL""",
)
def rates_shown(log):
    d = log.groupBy("bitrate_kbps").agg(F.count(F.lit(1)).alias("verdicts"))
    rate, delta = F.col("bitrate_kbps"), F.col("bitrate_kbps") - 3000
    return d.select("bitrate_kbps", texts.shown_rate(rate).alias("rate"), texts.shown_delta(delta).alias("delta"), texts.tone(delta).alias("tone"), "verdicts")


def _half(x: str, unit: int) -> str:
    return f"CAST(floor({x} / {D(unit)} + {D(0.5)}) AS BIGINT)"


@query(
    ["v_run"],
    f"""SELECT run_id, CASE WHEN run_id % 50 = 0 THEN 'never probed' WHEN s < 90 THEN s || 's ago' WHEN s < 5400 THEN {_half('s', 60)} || 'm ago' WHEN s < 172800 THEN {_half('s', 3600)} || 'h ago' ELSE {_half('s', 86400)} || 'd ago' END AS since,
 CASE WHEN a < 60 THEN a || 's ago' WHEN a < 3600 THEN {_half('a', 60)} || 'm ago' ELSE {_half('a', 3600)} || 'h ago' END AS ago,
 CASE WHEN g < 60 THEN g || 's' WHEN g < 3600 THEN (g // 60) || 'm' || CASE WHEN g % 60 > 0 THEN ' ' || (g % 60) || 's' ELSE '' END
  ELSE (g // 3600) || 'h' || CASE WHEN {_half('(g % 3600)', 60)} > 0 THEN ' ' || {_half('(g % 3600)', 60)} || 'm' ELSE '' END END AS gap,
 strftime(make_timestamp(1700000000000000 + run_id * 61000000), '%H:%M') AS clock
 FROM (SELECT run_id, greatest({_half(f'({AGE_NOW} - seen_at)', 1000)}, 0) AS s, greatest({_half('run_id * 700', 1000)}, 0) AS a, {_half('run_id * 411', 1000)} AS g FROM (SELECT *, started_at AS seen_at FROM v_run))""",
)
def times_shown(runs):
    i = F.col("run_id")
    at = F.when(i % 50 != 0, F.col("started_at"))
    return runs.select(
        "run_id", texts.since(at, AGE_NOW).alias("since"), texts.ago(F.lit(AGE_NOW) - i * 700, AGE_NOW).alias("ago"), texts.duration(i * 411).alias("gap"), texts.clock(F.lit(1_700_000_000_000) + i * 61_000).alias("clock"),
    )


@query(
    ["v_stream"],
    """SELECT stream_id, len(w) >= 2 AND list_contains(w, 'green') AS fragment, CASE WHEN regexp_matches(group_name || ' x', '\\s') AND stream_id % 2 = 0 THEN '@"' || group_name || ' x"' ELSE '@' || group_name END AS qualifier
 FROM (SELECT *, list_filter(regexp_split_to_array(lower(name), '\\s+'), lambda x: x <> '') AS w FROM v_stream)""",
)
def search_hints(streams):
    prefix = F.when(F.col("stream_id") % 2 == 0, F.concat("group_name", F.lit(" x"))).otherwise(F.col("group_name"))
    return streams.select("stream_id", texts.is_fragment(" Green ", F.col("name")).alias("fragment"), texts.qualifier(prefix).alias("qualifier"))


@query(
    ["v_group"],
    """SELECT group_id, CASE WHEN group_id % 3 = 0 THEN 'never' ELSE 'never — ' || group_name END AS verdict,
 'Learning from ' || CASE group_id % 4 WHEN 0 THEN 'every probe' WHEN 1 THEN 'channels in groups set to after EPG start or assigned' WHEN 2 THEN 'groups matching ' || group_name || ', B*' ELSE 'channels in groups set to after EPG start or assigned, or groups matching ' || group_name || ', B*' END
 || CASE WHEN group_id % 5 = 0 THEN ' — except groups matching *VOD*' ELSE '' END || '.' AS scope FROM v_group""",
)
def scopes_described(groups):
    i = F.col("group_id")
    none = F.array().cast("array<string>")
    include = F.when(i % 4 >= 2, F.array("group_name", F.lit("B*"))).otherwise(none)
    scope = texts.described_scope(i % 2 == 1, include, F.when(i % 5 == 0, F.array(F.lit("*VOD*"))).otherwise(none))
    return groups.select("group_id", texts.described(F.lit("never"), F.when(i % 3 != 0, F.col("group_name"))).alias("verdict"), scope.alias("scope"))


@query(
    ["v_option"],
    f"""SELECT option_id, CASE WHEN raw IS NULL OR trim(raw) = '' THEN 1 WHEN v IS NULL THEN 20 ELSE CAST(floor(greatest(1, least(100000, v)) + {D(0.5)}) AS BIGINT) END AS min_samples,
 CASE WHEN raw IS NULL OR trim(raw) = '' THEN {D(0)} WHEN v IS NULL THEN {D(5)} ELSE greatest({D(0)}, least({D(10000)}, v)) END AS points_per_mbps
 FROM (SELECT *, CASE WHEN regexp_full_match(trim(raw), '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN CAST(trim(raw) AS DOUBLE) END AS v FROM v_option)""",
)
def options_clamped(options):
    raw = F.col("raw")
    return options.select("option_id", F.floor(texts.clamped(raw, 20, 1, 100_000) + 0.5).cast("bigint").alias("min_samples"), texts.clamped(raw, 5, 0, 10_000).alias("points_per_mbps"))
