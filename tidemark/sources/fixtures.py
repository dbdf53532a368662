"""Input relations of the engine, as fixed projections of the driver's tables (FIXTURES.md, part C).

One text serves Spark and DuckDB. ``{rx}``, ``{ms:x}`` and ``{t:name}`` are the only parts that differ.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "v_provider": "SELECT s_suppkey AS provider_id, s_name AS provider_name, 1 + s_suppkey % 5 AS max_streams FROM {t:supplier}",
    "v_stream": """SELECT p.p_partkey AS stream_id,
 p.p_partkey % (SELECT count(*) FROM {t:supplier}) AS provider_id, p.p_size % 25 AS group_id, p.p_brand AS group_name,
 concat(CASE p.p_partkey % 6 WHEN 0 THEN 'US: ' WHEN 1 THEN 'UK | ' WHEN 2 THEN '|AU| ' WHEN 3 THEN 'Radio: ' ELSE '' END,
  upper(p.p_name),
  CASE (p.p_partkey - p.p_partkey % 6) / 6 % 8 WHEN 0 THEN ' FHD' WHEN 1 THEN ' 4K HEVC' WHEN 2 THEN ' HD 50fps' WHEN 3 THEN ' 1080p' WHEN 4 THEN ' [Multi]' WHEN 5 THEN ' SD TH' WHEN 6 THEN ' +1' ELSE '' END) AS name
 FROM {t:part} p""",
    "v_channel": "SELECT CAST(dense_rank() OVER (ORDER BY p_name) AS BIGINT) AS channel_id, p_name AS name FROM (SELECT DISTINCT p_name FROM {t:part}) d",
    "v_tier": """SELECT s.*, CASE
 WHEN {rx}(upper(name), '(^|[^A-Z0-9])(UHD|4K|2160P|2160I)([^A-Z]|$)') THEN 'uhd'
 WHEN {rx}(upper(name), '(^|[^A-Z0-9])(FHD|1080P|1080I)([^A-Z]|$)') THEN 'fhd'
 WHEN {rx}(upper(name), '(^|[^A-Z0-9])(HD|720P|720I)([^A-Z]|$)') THEN 'hd'
 WHEN {rx}(upper(name), '(^|[^A-Z0-9])(SD|LQ|576P|576I|480P|480I|360P)([^A-Z]|$)') THEN 'sd'
 ELSE 'unknown' END AS tier FROM v_stream s""",
    "v_sample": """SELECT l.l_suppkey AS provider_id, s.s_name AS provider_name, t.tier, t.stream_id, t.name AS stream_name, t.group_id, t.group_name,
 CASE l.l_orderkey % 5 WHEN 0 THEN 'always' WHEN 1 THEN 'after_epg_start' WHEN 2 THEN 'assigned' WHEN 3 THEN 'never' ELSE '' END AS policy_mode,
 (l.l_partkey % 11 = 0) AS audio_only, {ms:l.l_shipdate} AS sampled_at, l.l_orderkey, l.l_linenumber, CAST(floor(l.l_extendedprice * 100) AS BIGINT) AS tie,
 (l.l_returnflag <> 'R' OR l.l_quantity > 20) AS alive, (l.l_linestatus = 'O' AND l.l_quantity > 45) AS black,
 CAST(floor(l.l_extendedprice / 10) AS BIGINT) AS bitrate_kbps, (l.l_discount >= 0.02) AS measured,
 CAST(CASE WHEN l.l_quantity > 40 THEN 2160 WHEN l.l_quantity > 25 THEN 1080 WHEN l.l_quantity > 10 THEN 720 WHEN l.l_quantity > 3 THEN 480 ELSE 0 END AS BIGINT) AS height
 FROM {t:lineitem} l JOIN v_tier t ON t.stream_id = l.l_partkey JOIN {t:supplier} s ON s.s_suppkey = l.l_suppkey""",
    "v_verdict_log": """SELECT l_partkey AS stream_id, concat('h', CAST(l_linenumber % 2 AS VARCHAR(8))) AS stream_hash, l_suppkey % 3 AS variant_id,
 {ms:l_shipdate} AS probed_at, l_orderkey, l_linenumber, CAST(floor(l_extendedprice*100) AS BIGINT) AS tie,
 (l_returnflag <> 'R' OR l_quantity > 20) AS alive, (l_linestatus='O' AND l_quantity > 45) AS black,
 CASE WHEN l_discount < 0.01 THEN CAST(0 AS BIGINT) ELSE CAST(floor(l_extendedprice/10) AS BIGINT) END AS bitrate_kbps,
 CAST(CASE WHEN l_quantity > 40 THEN 2160 WHEN l_quantity > 25 THEN 1080 WHEN l_quantity > 10 THEN 720 WHEN l_quantity > 3 THEN 480 ELSE 0 END AS BIGINT) AS height,
 CAST(CASE WHEN l_linenumber % 2 = 0 THEN 50 ELSE 25 END AS BIGINT) AS fps,
 CASE WHEN l_orderkey % 3 = 0 THEN 'hevc' WHEN l_orderkey % 3 = 1 THEN 'h264' ELSE 'mpeg2video' END AS video_codec,
 CAST(CASE WHEN l_suppkey % 4 = 0 THEN 6 ELSE 2 END AS BIGINT) AS audio_channels FROM {t:lineitem}""",
    "v_run": """SELECT o_orderkey AS run_id, {ms:o_orderdate} AS started_at, o_orderkey % 7 AS probed, CAST(CASE WHEN o_orderkey % 7 > 4 THEN 1 ELSE 0 END AS BIGINT) AS dead,
 CASE WHEN o_orderstatus='P' THEN CAST(0 AS BIGINT) ELSE o_custkey % 3 END AS reordered, CASE WHEN o_orderpriority='1-URGENT' AND o_orderstatus='P' THEN 'timeout' END AS error FROM {t:orders}""",
    "v_epg": """SELECT concat('tvg', CAST(user_id AS VARCHAR(20))) AS tvg_id, {ms:ts} AS start_ms, {ms:ts} + 3600000*(1+event_id % 4) AS end_ms, event_type AS title,
 (event_type IN ('view','purchase')) AS is_live, event_id AS ord FROM {t:events}""",
    "v_group": "SELECT CAST(n_nationkey AS BIGINT) AS group_id, concat('Brand#', CAST(CAST(1 + floor(n_nationkey / 5) AS BIGINT) AS VARCHAR(8)), CAST(1 + n_nationkey % 5 AS VARCHAR(8))) AS group_name FROM {t:nation}",
    "v_policy": """SELECT group_id, CASE group_id % 4 WHEN 0 THEN 'always' WHEN 1 THEN 'never' WHEN 2 THEN 'after_epg_start' ELSE 'assigned' END AS mode,
 CAST(10 * (group_id % 3) AS BIGINT) AS grace_minutes, CAST(60 + 30 * (group_id % 5) AS BIGINT) AS window_minutes, (group_id % 8 = 2) AS require_live FROM v_group WHERE group_id < 16""",
    "v_event_channel": """SELECT e.user_id AS channel_id, concat('tvg', CAST(e.user_id AS VARCHAR(20))) AS tvg_id, g.group_id, g.group_name
 FROM (SELECT DISTINCT user_id FROM {t:events}) e JOIN v_group g ON g.group_id = e.user_id % 25""",
    "v_job": """SELECT DISTINCT l_suppkey AS channel_id, l_partkey AS stream_id, concat('h', CAST(l_partkey % 2 AS VARCHAR(8))) AS stream_hash, l_linenumber % 3 AS variant_id,
 l_partkey % (SELECT count(*) FROM {t:supplier}) AS provider_id FROM {t:lineitem}""",
    "v_assigned": """SELECT o.o_custkey AS channel_id, l.l_partkey AS stream_id, CAST(row_number() OVER (PARTITION BY o.o_custkey ORDER BY l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey) AS BIGINT) AS ord
 FROM {t:lineitem} l JOIN {t:orders} o ON o.o_orderkey = l.l_orderkey WHERE l.l_linenumber <= 2""",
    "v_ranked": """SELECT channel_id, stream_id, CAST(row_number() OVER (PARTITION BY channel_id ORDER BY price DESC, stream_id) AS BIGINT) AS ord FROM (
  SELECT o.o_custkey AS channel_id, l.l_partkey AS stream_id, max(l.l_extendedprice) AS price
  FROM {t:lineitem} l JOIN {t:orders} o ON o.o_orderkey = l.l_orderkey WHERE l.l_linenumber >= 2 GROUP BY o.o_custkey, l.l_partkey) x""",
    "v_probe": """SELECT o_orderkey AS probe_id, CASE o_orderkey % 6 WHEN 0 THEN '25/1' WHEN 1 THEN '30000/1001' WHEN 2 THEN '0/0' WHEN 3 THEN 'bad' WHEN 4 THEN '50' ELSE '1/0' END AS rate,
 concat('{"streams":[', CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE concat('{"codec_type":"video","codec_name":"h264","width":1920,"height":1080,"avg_frame_rate":"25/1","bit_rate":"', CASE WHEN o_orderkey % 3 = 0 THEN 'N/A' ELSE CAST(o_orderkey * 7 AS VARCHAR(20)) END, '"},') END,
  '{"codec_type":"audio","codec_name":"aac","channels":2,"bit_rate":"128000","sample_rate":"44100"},{"codec_type":"audio","codec_name":"ac3","channels":6,"bit_rate":"384000","sample_rate":"48000"}],"format":{"bit_rate":"5000000"}}') AS payload,
 concat('frame=1 bitrate= 12.5kbits/s', chr(13), 'frame=2 bitrate=', CAST(o_orderkey AS VARCHAR(20)), '.5kbits/s', chr(10), 'black_start:0.5 black_end:1.75', chr(10), 'black_start:2 black_end:', CAST(3 + o_orderkey % 4 AS VARCHAR(20)), '.125') AS stderr,
 CASE o_orderkey % 10 WHEN 0 THEN '' WHEN 1 THEN 'spawn failed: ENOENT' WHEN 2 THEN 'refusing a url' WHEN 3 THEN 'Protocol not found' WHEN 4 THEN 'Server returned 403 Forbidden (not found)' WHEN 5 THEN 'HTTP error 404 Not Found'
  WHEN 6 THEN '502 Bad Gateway' WHEN 7 THEN 'Connection timed out' WHEN 8 THEN 'Connection refused' ELSE 'failed at 2024 something' END AS error,
 concat('http://old', CAST(o_orderkey % 3 AS VARCHAR(8)), '.example/live/user/pass/', CAST(o_orderkey AS VARCHAR(20)), '.ts') AS url FROM {t:orders}""",
    "v_url": "SELECT stream_id, provider_id, concat('http://h', CAST(provider_id % 3 AS VARCHAR(8)), '.example/live/user/pass/', CAST(stream_id AS VARCHAR(20)), '.ts') AS url FROM v_stream",
    "v_host": """SELECT user_id AS host_id, CASE user_id % 13 WHEN 0 THEN '' WHEN 1 THEN concat('Media', CASE WHEN user_id % 2 = 0 THEN '.example' ELSE '' END, ':3456') WHEN 2 THEN concat('[FE80::', CAST(user_id AS VARCHAR(8)), ']:80') WHEN 3 THEN concat('192.168.', CAST(user_id * 2 AS VARCHAR(8)), '.1:80')
  WHEN 4 THEN concat('172.', CAST(user_id % 40 AS VARCHAR(8)), '.0.1') WHEN 5 THEN concat('100.', CAST(user_id AS VARCHAR(8)), '.9.9') WHEN 6 THEN concat('a', CAST(user_id AS VARCHAR(8)), '.lan') WHEN 7 THEN concat(' B', CAST(user_id AS VARCHAR(8)), '.trusted.example ')
  WHEN 8 THEN concat('evil', CAST(user_id AS VARCHAR(8)), '.example') WHEN 9 THEN '::ffff:10.0.0.7' WHEN 10 THEN '[open' WHEN 11 THEN concat('fd', CAST(user_id % 90 AS VARCHAR(8)), '::2') ELSE '2001:db8::1' END AS header FROM (SELECT DISTINCT user_id FROM {t:events}) u""",
    "v_option": """SELECT user_id AS option_id, CASE user_id % 9 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN ' ' WHEN 3 THEN CAST(user_id * 10 AS VARCHAR(8)) WHEN 4 THEN '-3' WHEN 5 THEN 'abc' WHEN 6 THEN '1e9' WHEN 7 THEN ' 2.5 ' ELSE '12.5.1' END AS raw
  FROM (SELECT DISTINCT user_id FROM {t:events}) u""",
    "v_setting": """SELECT group_id AS ord, concat('f', CAST(group_id * 3 % 7 AS VARCHAR(8))) AS key, CASE group_id % 8 WHEN 0 THEN '' WHEN 1 THEN ' 12 ' WHEN 2 THEN '-3' WHEN 3 THEN 'YES ' WHEN 4 THEN '1e3' WHEN 5 THEN 'https://up/a//' WHEN 6 THEN '0.5' END AS raw FROM v_group""",
    "v_listed": """SELECT c.channel_id, c.tvg_id AS name, c.group_id, c.group_name, coalesce(p.mode, 'always') AS mode, (c.channel_id % 3 = 0) AS has_rule, (c.channel_id % 11 = 0) AS assignment_only,
 c.channel_id % 4 AS assigned, CASE WHEN c.channel_id % 5 = 0 THEN 0 ELSE c.channel_id % 7 END AS matched, c.channel_id % 2 AS regex_count FROM v_event_channel c LEFT JOIN v_policy p ON p.group_id = c.group_id""",
    "v_account": "SELECT provider_id, CASE WHEN provider_id % 7 = 0 THEN 'XC' ELSE 'STD' END AS account_type, max_streams FROM v_provider",
    "v_profile": " UNION ALL ".join(
        f"""SELECT provider_id, provider_id * 10 + {i} AS profile_id, {i} AS ord, 'login{i}' AS name, (provider_id % 4 = {i}) AS is_default, (provider_id % 5 > 0 AND (provider_id + {i}) % 6 <> 0) AS is_active,
 CASE WHEN provider_id % 3 = {i} THEN 0 ELSE 1 + (provider_id + {i}) % 3 END AS max_streams, provider_id * {i} % 3 AS viewers, {search} AS search, {replace} AS replace FROM v_provider"""
        for i, search, replace in [
            (0, "'^(http://[^/]+)/live/[^/]+/[^/]+/(.*)$'", "'$1/live/u0/p0/$2'"),
            (1, "'^(?P<host>http://[^/]+)/live/[^/]+/[^/]+/'", "concat(chr(92), 'g<host>/live/u1/p$$/')"),
            (2, "CASE WHEN provider_id % 2 = 0 THEN '' ELSE '/user/pass/' END", "CASE WHEN provider_id % 3 = 0 THEN '/u0/p0/' ELSE '/u2/p2/' END"),
        ]
    ),
    "v_raw_channel": """SELECT concat('{"id":', CAST(provider_id AS VARCHAR(20)), ',"uuid":"00-', CAST(provider_id AS VARCHAR(20)), '","name":"', provider_name, '"', CASE provider_id % 3 WHEN 0 THEN ',"effective_name":"Seen"' WHEN 1 THEN ',"effective_name":""' ELSE '' END,
 CASE provider_id % 4 WHEN 0 THEN '' ELSE ',"tvg_id":"t1"' END, CASE provider_id % 5 WHEN 0 THEN ',"effective_channel_group_id":7' WHEN 1 THEN ',"channel_group_id":8,"effective_channel_group_id":null' ELSE '' END, CASE WHEN provider_id % 2 = 0 THEN ',"streams":[3,1,2]' ELSE '' END, '}') AS body FROM v_provider""",
    "v_raw_stream": """SELECT concat('{"id":', CAST(stream_id AS VARCHAR(20)), CASE stream_id % 5 WHEN 0 THEN '' WHEN 1 THEN ',"url":""' ELSE ',"url":"http://s/x"' END, CASE WHEN stream_id % 2 = 0 THEN ',"name":"n","stream_hash":"h"' ELSE '' END,
 CASE stream_id % 3 WHEN 0 THEN ',"m3u_account":null' ELSE ',"m3u_account":4,"current_viewers":2,"channel_group":9' END, '}') AS body FROM v_stream""",
    "v_raw_provider": """SELECT concat('{"id":', CAST(provider_id AS VARCHAR(20)), ',"max_streams":', CASE provider_id % 3 WHEN 0 THEN 'null' WHEN 1 THEN '0' ELSE '6' END, CASE provider_id % 4 WHEN 0 THEN ',"is_active":false' WHEN 1 THEN ',"is_active":true,"name":"P"' ELSE ',"name":""' END,
 ',"profiles":[{"id":1,"name":"a","is_default":true,"max_streams":0},{"id":2,"is_active":false,"current_viewers":3,"search_pattern":"x","replace_pattern":"y","max_streams":2}]}') AS body FROM v_provider""",
    "v_raw_grid": """SELECT event_id, concat(CASE WHEN event_id % 2 = 0 THEN '{"data":' ELSE '' END, '[{"id":', CAST(event_id AS VARCHAR(20)), ',"tvg_id":"t', CAST(event_id AS VARCHAR(20)), '","start_time":"2024-01-01T10:', lpad(CAST(event_id % 60 AS VARCHAR(8)), 2, '0'), ':00Z","end_time":"2024-01-01T11:00:00Z","title":"a","is_live":true,"more":{"x":1}},
 {"id":"dummy-custom-1-2","tvg_id":"d","start_time":"2024-01-01T10:00:00Z","end_time":"2024-01-01T14:00:00Z","title":"filler"},{"id":"odd","tvg_id":"t', CAST(event_id AS VARCHAR(20)), '","start_time":"never","title":"b"}]', CASE WHEN event_id % 2 = 0 THEN '}' ELSE '' END) AS body FROM {t:events}""",
    "v_uuid": "SELECT concat('00-', CAST(provider_id AS VARCHAR(20))) AS uuid, provider_id AS channel_id FROM v_provider",
    "v_raw_status": """SELECT concat('{"count":', CAST(provider_id % 3 AS VARCHAR(20)), ',"channels":[', CASE provider_id % 3 WHEN 0 THEN '' ELSE concat(CAST(provider_id AS VARCHAR(20)), ',"', CAST(provider_id * 10 AS VARCHAR(20)), '","00-', CAST(provider_id AS VARCHAR(20)),
 '","00-none",{"channel_id":"00-none","id":"00-', CAST(provider_id AS VARCHAR(20)), '","m3u_profile_id":"7"},{"channel":', CAST(provider_id * 100 AS VARCHAR(20)), ',"m3u_profile_id":8},{"m3u_profile_id":9},null') END, ']}') AS body FROM v_provider""",
    "v_raw_rules": """SELECT concat('{"channels":[{"channel_id":', CAST(channel_id AS VARCHAR(20)), CASE channel_id % 4 WHEN 0 THEN ',"enabled":false,"aliases":["a"]' WHEN 1 THEN ',"aliases":["a","b"],"exclude_regions":["au"]' WHEN 2 THEN ',"contains":["c"],"providers":"[3,1,3]"' ELSE ',"providers":[2]' END,
 ',"patterns":[{"pattern":"', CASE channel_id % 3 WHEN 0 THEN '(' WHEN 1 THEN '^x' ELSE '' END, '","step_order":4,"m3u_accounts":"null"},{"pattern":"[a"}]}],"groups":{"', CAST(channel_id AS VARCHAR(20)), '":', CASE channel_id % 4 WHEN 0 THEN '"never"' WHEN 1 THEN '"odd"' WHEN 2 THEN '{"mode":"assigned","grace_minutes":9,"require_live":"off","audioOnly":1}' ELSE 'null' END,
 ',"x":"never"},"group_patterns":[{"pattern":" "},{"pattern":" Auto* ","mode":"never","measure_only":true},{"pattern":"B","mode":"odd","require_live":0}]}') AS body FROM v_channel""",
    "v_raw_legacy": """SELECT replace(concat('{"channels":[{"channel_id":"', CAST(channel_id AS VARCHAR(20)), '","name":"', name, '"', CASE channel_id % 6 WHEN 0 THEN ',"patterns":[{"pattern":"(?i)^(?:HBO~s+East|hbo-east|HBO West)~s*$"}]'
  WHEN 1 THEN ',"patterns":[{"pattern":"(?i)^(?!~s*(?:AU|nz)~s*(?:[:|]|~s))(?!.*~+~s*1(?![0-9]))Cub~[4K~]$"}]' WHEN 2 THEN ',"enabled":false,"patterns":[{"pattern":"a(b|c)"}]'
  WHEN 3 THEN ',"patterns":[{"pattern":"[A-Z]x"},{"pattern":"Plain","m3u_accounts":"[2,1]"}]' WHEN 4 THEN ',"patterns":[{"pattern":"Plain","m3u_accounts":[2,1]}]' ELSE '' END, '}]}'), '~', concat(chr(92), chr(92))) AS body FROM v_channel""",
}
NEEDS = {name: [v for v in VIEWS if re.search(rf"\b{v}\b", text) and v != name] for name, text in VIEWS.items()}


def with_views(names: list[str], engine: str, sf_dir: str = "") -> str:
    """A WITH clause for views and those that they read, in the dialect of spark or duckdb."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS[name]:
            add(need)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    text = "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in order)
    if engine == "spark":
        text = text.replace("{rx}", "regexp_like")
        text = re.sub(r"\{ms:([\w.]+)\}", r"(unix_micros(CAST(\1 AS TIMESTAMP)) div 1000)", text)
        return re.sub(r"\{t:(\w+)\}", lambda m: f"parquet.`{sf_dir}/{m[1]}.parquet`", text)
    text = re.sub(r"\{ms:([\w.]+)\}", r"(epoch_us(\1) // 1000)", text.replace("{rx}", "regexp_matches"))
    return re.sub(r"\{t:(\w+)\}", r"\1", text)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(f"{with_views([name], 'spark', sf_dir)} SELECT * FROM {name}")
