"""Queries about settings, writes to the kept tables, and merged probes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import probing
from tidemark.operators import probes, settings, store, verdicts
from tidemark.plans.registry import LATEST_SQL, NOW, D, query
from tidemark.sources.scratch import path
from tidemark.sources.versions import VersionedTable

FIELDS_SCHEMA = "key string, kind string, scale double, least double, most double, fallback string"
FIELDS = [("f0", "number", 1000.0, 1.0, 100.0, "5"), ("f1", "number", None, None, None, "2.5"), ("f2", "boolean", None, None, None, "true"), ("f3", "url", None, None, None, "http://up"), ("f4", "secret", None, None, None, ""), ("f5", "text", None, None, None, "t")]
FIELDS_SQL = f"""fields AS (SELECT * FROM (VALUES {', '.join('(' + ', '.join('NULL' if x is None else repr(x) for x in f) + ')' for f in FIELDS)}) f(key, kind, scale, least, most, fallback))"""
NUMBER_SQL = "regexp_full_match(trim(raw), '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?')"
VALID_SQL = f"""{FIELDS_SQL},
 n AS (SELECT s.ord, s.key, s.raw, trim(s.raw) AS t, kind, scale, least, most, CASE WHEN {NUMBER_SQL} THEN CAST(trim(raw) AS DOUBLE) END AS n FROM v_setting s LEFT JOIN fields f ON f.key = s.key),
 g AS (SELECT *, CASE WHEN kind IS NULL THEN 'not a settable field' WHEN coalesce(raw, '') = '' THEN NULL WHEN kind = 'number' AND (n IS NULL OR n < 0) THEN 'must be a non-negative number' WHEN kind = 'number' AND n < least THEN 'must be at least ' || CAST(least AS BIGINT)
   WHEN kind = 'number' AND n > most THEN 'must be at most ' || CAST(most AS BIGINT) WHEN kind = 'url' AND NOT regexp_matches(lower(t), '^https?://[^/?#]+') THEN 'must be an http(s) URL' END AS fault,
   CASE WHEN scale IS NULL THEN n ELSE floor(n * scale + {D(0.5)}) END AS sv FROM n),
 v AS (SELECT ord, key, fault, CASE WHEN fault IS NOT NULL OR coalesce(raw, '') = '' THEN NULL WHEN kind = 'number' THEN CASE WHEN sv = floor(sv) THEN CAST(CAST(sv AS BIGINT) AS VARCHAR) ELSE CAST(sv AS VARCHAR) END
   WHEN kind = 'boolean' THEN CASE WHEN lower(t) IN ('1', 'true', 'yes', 'on') THEN 'true' ELSE 'false' END WHEN kind = 'url' THEN regexp_replace(t, '/+$', '') ELSE t END AS value FROM g)"""


def _fields(d):
    return d.sparkSession.createDataFrame(FIELDS, FIELDS_SCHEMA)


@query(["v_setting"], f"WITH {VALID_SQL} SELECT key, value, fault, count(*) AS rows FROM v GROUP BY ALL")
def settings_validated(rows):
    d = settings.validated(rows, _fields(rows))
    return d.groupBy("key", "value", "fault").agg(F.count(F.lit(1)).alias("rows"))


STORED_SQL = f"""WITH {VALID_SQL}, old AS (SELECT key, value, ord AS updated_at FROM v WHERE ord < 7 AND value IS NOT NULL),
 new AS (SELECT key, arg_max(coalesce(value, '~'), ord) AS value FROM v WHERE ord >= 12 AND fault IS NULL GROUP BY 1),
 after AS (SELECT * FROM old WHERE key NOT IN (SELECT key FROM new) UNION ALL SELECT key, value, 99 FROM new WHERE value <> '~')"""


def _valid_by_row(rows):
    """Validation row by row, with the row's place: keys repeat in the fixture."""
    named = rows.select(F.concat_ws("#", "key", F.col("ord").cast("string")).alias("key"), "raw")
    fields = _fields(rows)
    wide = rows.select("ord", F.col("key").alias("name")).join(fields.withColumnRenamed("key", "name"), "name").select(F.concat_ws("#", "name", F.col("ord").cast("string")).alias("key"), "kind", "scale", "least", "most", "fallback")
    d = settings.validated(named, wide)
    return d.select(F.substring_index("key", "#", 1).alias("key"), F.substring_index("key", "#", -1).cast("bigint").alias("ord"), "value", "fault")


def _after(rows):
    v = _valid_by_row(rows)
    old = v.filter("ord < 7 AND value IS NOT NULL").select("key", "value", F.col("ord").alias("updated_at"))
    new = v.filter("ord >= 12 AND fault IS NULL").groupBy("key").agg(F.max_by("value", "ord").alias("value"))
    return settings.stored_after(old, new, 99)


@query(["v_setting"], STORED_SQL + " SELECT key, value, CAST(updated_at AS BIGINT) AS updated_at FROM after")
def settings_stored(rows):
    return _after(rows)


@query(["v_setting"], STORED_SQL + " SELECT CAST(coalesce(max(updated_at), 0) AS BIGINT) AS version FROM after")
def settings_version(rows):
    return settings.version(_after(rows))


@query(
    ["v_setting"],
    STORED_SQL + """, env AS (SELECT 'f' || i AS key, CASE i WHEN 1 THEN '' ELSE 'e' || i END AS value FROM (SELECT unnest([1, 2, 4, 5, 9]) AS i)),
 j AS (SELECT f.key, f.kind, f.fallback, e.value AS env, max(a.value) AS own FROM fields f LEFT JOIN env e ON e.key = f.key LEFT JOIN after a ON a.key = f.key GROUP BY ALL)
 SELECT key, CASE WHEN kind = 'secret' THEN '' ELSE coalesce(own, env, '') END AS value, coalesce(own, env, '') <> '' AS is_set, CASE WHEN own IS NOT NULL THEN 'stored' WHEN coalesce(env, '') <> '' THEN 'environment' ELSE 'default' END AS source,
 coalesce(nullif(coalesce(own, env, ''), ''), fallback) AS in_force FROM j""",
)
def settings_effective(rows):
    env = rows.sparkSession.createDataFrame([(f"f{i}", "" if i == 1 else f"e{i}") for i in (1, 2, 4, 5, 9)], "key string, value string")
    stored = _after(rows).groupBy("key").agg(F.max("value").alias("value"))
    return settings.effective(_fields(rows), env, stored)


@query(
    ["v_setting"],
    f"""WITH {FIELDS_SQL} SELECT key, number, flag, count(*) AS rows FROM (SELECT s.key, CASE WHEN kind = 'number' THEN coalesce(CASE WHEN {NUMBER_SQL} THEN CAST(trim(raw) AS DOUBLE) END, CAST(fallback AS DOUBLE)) END AS number,
 CASE WHEN kind = 'boolean' THEN lower(trim(coalesce(nullif(raw, ''), fallback))) IN ('1', 'true', 'yes', 'on') END AS flag FROM v_setting s JOIN fields f ON f.key = s.key) GROUP BY ALL""",
)
def settings_coerced(rows):
    d = settings.coerced(rows.join(_fields(rows), "key"))
    return d.groupBy("key", "number", "flag").agg(F.count(F.lit(1)).alias("rows"))


@query(["v_sample"], f"SELECT provider_id, stream_id, left(stream_name || stream_name, 200) AS stream_name, CAST(floor(bitrate_kbps / {D(3)} + {D(0.5)}) AS BIGINT) AS bitrate_kbps, height, CAST({NOW} AS BIGINT) AS sampled_at, count(*) AS samples FROM v_sample GROUP BY ALL")
def samples_recorded(samples):
    d = samples.select("provider_id", "stream_id", F.concat("stream_name", "stream_name").alias("stream_name"), (F.col("bitrate_kbps") / 3).alias("bitrate_kbps"), "height")
    d = store.recorded(d, NOW)
    return d.groupBy(*d.columns).agg(F.count(F.lit(1)).alias("samples"))


AGES = {"v_sample": ("sampled_at", 90, "samples_young"), "v_verdict_log": ("probed_at", 30, "verdicts_young"), "v_run": ("started_at", 30, "runs_young")}
YOUNG_NOW = 880_000_000_000


def _young(view: str, at: str, days: int):
    def rows_kept(d):
        kept = store.younger(d, at, YOUNG_NOW, days * store.DAY)
        return kept.agg(F.count(F.lit(1)).alias("kept"), F.min(at).alias("oldest"))

    return rows_kept


for _view, (_at, _days, _name) in AGES.items():
    _f = _young(_view, _at, _days)
    _f.__name__ = _name
    query([_view], f"SELECT count(*) AS kept, min({_at}) AS oldest FROM {_view} WHERE {_at} >= {YOUNG_NOW - _days * store.DAY}")(_f)

RUN_NOW = 870_000_000_000


@query(
    ["v_run"],
    f"""WITH n AS (SELECT * FROM v_run WHERE run_id % 10 = 0), a AS (SELECT run_id, started_at, probed, dead, reordered, error FROM v_run WHERE run_id % 10 <> 0 UNION ALL SELECT run_id, {RUN_NOW}, NULL, NULL, NULL, NULL FROM n),
 u AS (SELECT run_id, max(CASE WHEN run_id % 20 = 0 THEN 7 END) AS probed, max(CASE WHEN run_id % 30 = 0 THEN 'late' END) AS error FROM n GROUP BY 1)
 SELECT a.run_id, started_at, CAST(coalesce(u.probed, a.probed) AS BIGINT) AS probed, dead, reordered, coalesce(u.error, a.error) AS error, CASE WHEN u.run_id IS NOT NULL THEN CAST({RUN_NOW} + 5 AS BIGINT) END AS finished_at
 FROM a LEFT JOIN u ON u.run_id = a.run_id WHERE started_at >= {RUN_NOW} - {store.KEPT['runs']}""",
)
def runs_written(runs):
    runs = runs.select("run_id", "started_at", "probed", "dead", "reordered", "error")
    new = runs.filter("run_id % 10 = 0").select("run_id")
    i = F.col("run_id")
    first = new.select("run_id", F.lit(1).alias("seq"), F.lit(3).cast("bigint").alias("probed"), F.lit(None).cast("string").alias("error")).filter(i % 20 == 0)
    then = new.select("run_id", F.lit(2).alias("seq"), F.when(i % 20 == 0, F.lit(7).cast("bigint")).alias("probed"), F.when(i % 30 == 0, "late").alias("error"))
    return store.finished(store.started(runs, new, RUN_NOW), first.unionByName(then), RUN_NOW + 5)


@query(["v_verdict_log"], "SELECT stream_id, stream_hash, CAST(0 AS BIGINT) AS variant_id, count(*) AS verdicts FROM v_verdict_log GROUP BY 1, 2")
def cache_split(log):
    old = log.groupBy("stream_id", "stream_hash").agg(F.count(F.lit(1)).alias("verdicts"))
    return store.split_by_variant(old)


ENTRY_SQL = LATEST_SQL + """ SELECT stream_id, stream_hash, variant_id, probed_at, alive, CAST(dead_streak AS BIGINT) AS dead_streak,
 CASE WHEN bitrate_kbps > 0 THEN bitrate_kbps END AS kbps, bitrate_kbps > 0 AS readable FROM latest WHERE stream_id % 100 = 0 AND stream_hash = 'h1'"""


def _kept(log):
    """The kept verdicts with their result as text; one without bitrate stands for one that was cut off while it was written."""
    whole = F.to_json(F.struct("alive", F.col("bitrate_kbps").alias("bitrateKbps")))
    return verdicts.latest(log).withColumn("result", F.when(F.col("bitrate_kbps") > 0, whole).otherwise(F.substring(whole, 1, 9)))


def _read(found):
    kbps = F.get_json_object("result", "$.bitrateKbps").cast("bigint")
    return found.select("stream_id", "stream_hash", "variant_id", "probed_at", "alive", "dead_streak", kbps.alias("kbps"), F.col("result").isNotNull().alias("readable"))


@query(["v_verdict_log"], ENTRY_SQL)
def cache_entries(log):
    """Point lookups of the streams whose id ends in 00, under hash h1, each by its variant; those that cannot be read keep their age and streak."""
    kept = _kept(log)
    return _read(store.entry(kept, log.filter("stream_id % 100 = 0 AND stream_hash = 'h1'").select("stream_id", "stream_hash", "variant_id")))


@query(["v_verdict_log"], ENTRY_SQL)
def cache_variants(log):
    """The same streams looked up without a variant: every login's verdict."""
    kept = _kept(log)
    return _read(store.entry(kept, log.filter("stream_id % 100 = 0 AND stream_hash = 'h1'").select("stream_id", "stream_hash")))


@query(["v_channel"], "SELECT i.channel_id, c.name FROM (SELECT channel_id * 7 AS channel_id FROM v_channel) i LEFT JOIN v_channel c ON c.channel_id = i.channel_id")
def channel_lookup(channels):
    return store.by_id(channels, "channel_id", channels.select((F.col("channel_id") * 7).alias("channel_id")))


RESET_OF = {
    "probe_cache": ("v_verdict_log", ["stream_id", "variant_id", "probed_at"]), "runs": ("v_run", ["run_id", "started_at"]), "refresh_marks": ("v_group", ["group_id"]),
    "catalogue": ("v_ranked", ["channel_id", "stream_id"]), "catalogue_state": ("v_run", ["run_id"]), "assign_blocks": ("v_assigned", ["channel_id", "stream_id"]), "quality_samples": ("v_sample", ["stream_id", "sampled_at"]),
    "settings": ("v_setting", ["key", "ord"]),
}
RESET_VIEWS = sorted({v for v, _ in RESET_OF.values()})


@query(RESET_VIEWS, " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS before, CASE WHEN '{t}' = 'settings' THEN count(*) ELSE 0 END AS after FROM {v}" for t, (v, _) in RESET_OF.items()))
def data_reset(*views):
    """Rows of the kept tables before and after a reset, read back: seven are emptied, settings stay."""
    by = dict(zip(RESET_VIEWS, views, strict=True))
    spark = views[0].sparkSession
    tables = {name: VersionedTable(spark, path(spark, name)) for name in RESET_OF}
    for name, (v, columns) in RESET_OF.items():
        tables[name].replace(by[v].select(*columns))
    before = {name: t.read() for name, t in tables.items()}
    store.reset(tables)
    count = lambda d, name, when: d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), F.lit(when).alias("at"), "n")
    rows = [count(d, name, when) for name in RESET_OF for when, d in (("before", before[name]), ("after", tables[name].read()))]
    return reduce(DataFrame.unionByName, rows).groupBy("name").pivot("at", ["before", "after"]).agg(F.first("n"))


@query(
    ["v_probe"],
    f"""WITH b AS (SELECT probe_id, probe_id % 5 <> 0 AS v, CASE WHEN probe_id % 3 = 0 THEN {D(384)} ELSE floor((probe_id * 7) / {D(1000)} * 100 + {D(0.5)}) / 100 END AS declared, {D(1.25)} + {D(1.125)} + probe_id % 4 AS black_s, probe_id % 8 = 3 AS truncated, probe_id % 11 AS remaining, probe_id % 13 = 6 AS failed FROM v_probe),
 s AS (SELECT *, v AND remaining > 0 AND NOT failed AS sampled FROM b)
 SELECT probe_id, v AS alive, CASE WHEN NOT v THEN {D(0)} WHEN sampled THEN probe_id + {D(0.5)} ELSE declared END AS bitrate_kbps, CASE WHEN v THEN sampled END AS bitrate_measured,
 CASE WHEN sampled AND (black_s >= {D(4.5)} OR NOT truncated) THEN black_s >= {D(4.5)} END AS black, CASE WHEN sampled THEN floor(black_s * 100 + {D(0.5)}) / 100 END AS black_seconds FROM s""",
)
def probe_verdicts(p):
    """Payload, sample and time left of each probe, merged into one verdict."""
    i = F.col("probe_id")
    d = p.select("probe_id", probing.parsed(F.col("payload")).alias("p"), F.when(i % 13 != 6, probing.sampled(F.col("stderr"))).alias("s"), (i % 8 == 3).alias("truncated"), (i % 11).alias("remaining_ms"))
    return probes.merged(d).select("probe_id", "alive", "bitrate_kbps", "bitrate_measured", "black", "black_seconds")



FAILED_SQL = f"""WITH b AS (SELECT probe_id, probe_id % 5 <> 0 AS v, CASE probe_id % 17 WHEN 1 THEN 'refusing a url that is local' WHEN 2 THEN 'timeout' WHEN 3 THEN 'spawn failed: ' || repeat('x', 186) WHEN 4 THEN 'last line' WHEN 5 THEN 'exit 1'
  WHEN 6 THEN 'unparseable: not JSON' ELSE '' END AS error, CASE WHEN probe_id % 3 = 0 THEN {D(384)} ELSE floor((probe_id * 7) / {D(1000)} * 100 + {D(0.5)}) / 100 END AS declared FROM v_probe)
SELECT probe_id, error, error = '' AND v AS alive, CASE WHEN error <> '' OR NOT v THEN {D(0)} ELSE probe_id + {D(0.5)} END AS bitrate_kbps,
 CASE WHEN error <> '' THEN CASE WHEN starts_with(error, 'spawn') OR starts_with(error, 'unp') THEN 'probe_error' WHEN starts_with(error, 'refusing') THEN 'rejected' WHEN error = 'timeout' THEN 'timeout' ELSE 'other' END WHEN NOT v THEN 'other' END AS reason FROM b"""


@query(["v_probe"], FAILED_SQL)
def probe_failures(p):
    """Probes that were refused, ran out of time, did not start, failed or wrote no JSON, beside those that gave a verdict, and the reason that their error is counted under."""
    i = F.col("probe_id")
    case = i % 17
    d = p.select(
        "probe_id", F.when(case == 1, "refusing a url that is local").alias("refusal"), (case == 2).alias("timed_out"), F.when(case == 3, F.repeat(F.lit("x"), 300)).alias("spawn_error"),
        F.when(case.isin(4, 5), 1).otherwise(0).alias("exit_code"), F.when(case == 4, F.lit("first line\n\nlast line\n")).alias("written"), F.when(case == 6, F.substring("payload", 1, 30)).otherwise(F.col("payload")).alias("payload"),
        probing.sampled(F.col("stderr")).alias("s"), F.lit(False).alias("truncated"), F.lit(1).alias("remaining_ms"),
    )
    return probes.outcomes(d).select("probe_id", "error", "alive", "bitrate_kbps", F.when(~F.col("alive"), probing.dead_reason(F.col("error"))).alias("reason"))
