"""Queries that read a table as a stream, to the end of what it has; the SQL is the batch answer."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import verdict_ttl
from tidemark.plans.registry import QUERIES, SQL, TTL
from tidemark.sources.scratch import path
from tidemark.sources.versions import VersionedTable, newest, update_keys
from tidemark.streaming.barriers import barrier, stateful_session
from tidemark.streaming.incremental import dead_streaks, folder_stream, hourly, verdict_cache


def stream_query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


@stream_query("SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) // 1000 AS start_ms, count(*) AS events, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1")
def stream_hourly_window(spark, sf_dir):
    out = hourly(folder_stream(spark, f"{sf_dir}/events.parque[t]"), "ts", (F.col("event_type") == "error").cast("bigint"))
    return out.select(F.unix_millis(F.col("start").cast("timestamp")).alias("start_ms"), F.col("rows").alias("events"), F.col("total").alias("errors"))


@stream_query("""WITH l AS (SELECT user_id, max((ts, event_id)) FILTER (event_type IN ('view', 'click')) AS seen FROM events GROUP BY 1)
SELECT user_id, count(*) FILTER (seen IS NULL OR (ts, event_id) > seen) AS dead_streak FROM events JOIN l USING (user_id) GROUP BY 1""")
def stream_dead_streak(spark, sf_dir):
    return dead_streaks(folder_stream(spark, f"{sf_dir}/events.parque[t]"), "user_id", F.col("event_type").isin("view", "click"), ["ts", "event_id"])


@stream_query(f"""WITH l AS (SELECT user_id, max((ts, event_id)) FILTER (event_type IN ('view', 'click')) AS seen, arg_max(event_type, (ts, event_id)) IN ('view', 'click') AS alive, max(epoch_us(ts) // 1000) AS at_ms FROM events GROUP BY 1),
 s AS (SELECT l.user_id, alive, at_ms, count(*) FILTER (seen IS NULL OR (ts, event_id) > seen) AS dead_streak FROM events e JOIN l ON l.user_id = e.user_id GROUP BY 1, 2, 3)
SELECT user_id, alive, dead_streak, at_ms + CASE WHEN alive THEN {TTL["live"]} ELSE least(CAST(pow(2, least(greatest(dead_streak - 1, 0), 30)) AS BIGINT) * {TTL["dead"]}, {TTL["most"]}) END AS due_at FROM s""")
def stream_verdict_cache(spark, sf_dir):
    """The last verdict of each key from a stream, kept as state, and when it is due again."""
    d = verdict_cache(folder_stream(spark, f"{sf_dir}/events.parque[t]"), F.col("user_id"), F.col("event_type").isin("view", "click"), F.unix_millis(F.col("ts").cast("timestamp")), F.col("event_id"))
    ttl = verdict_ttl(F.col("alive"), F.lit(1), F.col("dead_streak"), TTL["live"], TTL["dead"], TTL["most"], TTL["unknown"])
    return d.select(F.col("key").alias("user_id"), "alive", "dead_streak", (F.col("at_ms") + ttl).alias("due_at"))


def _barrier_sql(key: str, missing: str) -> str:
    return f"""SELECT {key} AS key, count(*) + CASE WHEN {missing} THEN 1 ELSE 0 END AS parts, count(*) AS landed, count(*) FILTER (event_type <> 'error') AS results,
 -max((value, -event_id)) FILTER (event_type <> 'error')[2] AS best, max(value) FILTER (event_type <> 'error') AS best_score, max(epoch_us(ts) // 1000) AS last_ms, NOT ({missing}) AS settled FROM events GROUP BY {key}"""


def _landed(spark, sf_dir, key, missing):
    """Events as parts of a key that land; errors are skipped ones, and of some keys one part more is awaited than ever lands."""
    session = stateful_session(spark)
    expected = session.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.expr(key).alias("key")).agg((F.count(F.lit(1)) + F.expr(f"CASE WHEN {missing} THEN 1 ELSE 0 END")).alias("parts"))
    stream = folder_stream(session, f"{sf_dir}/events.parque[t]").withColumn("key", F.expr(key))
    return barrier(stream, expected, "key", F.col("event_id"), F.col("value"), F.col("event_type") == "error", F.unix_millis(F.col("ts").cast("timestamp")))


@stream_query(_barrier_sql("user_id", "user_id % 10 = 0"))
def stream_settled(spark, sf_dir):
    """Streams whose probes have all landed, with their best result; the rest are flushed when the stream ends."""
    return _landed(spark, sf_dir, "user_id", "user_id % 10 = 0").drop("flushed")


@stream_query("WITH b AS (" + _barrier_sql("user_id % 37", "user_id % 37 = 5") + ") SELECT key AS channel_id, parts, landed, results, settled FROM b WHERE results > 0")
def stream_channels_done(spark, sf_dir):
    """Channels whose jobs have all landed, in whatever order their streams settle, and those that the end of the pass cuts short; only those with any result count."""
    return _landed(spark, sf_dir, "user_id % 37", "user_id % 37 = 5").filter("results > 0").select(F.col("key").alias("channel_id"), "parts", "landed", "results", "settled")


CATALOGUE_SQL = """WITH old AS (SELECT o_custkey AS channel_id, o_orderkey AS stream_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS slot FROM orders WHERE o_orderkey % 3 > 0),
 new AS (SELECT o_custkey AS channel_id, o_orderkey AS stream_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS slot FROM orders),
 upd AS (SELECT channel_id, stream_id, 100 - slot AS slot FROM new WHERE channel_id % 10 = 1 AND stream_id % 2 = 0)
"""


def _catalogue(spark, sf_dir):
    """A table that holds a catalogue, is replaced by another, then by none, and has the orders of some channels written anew; and the number of its first version."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("channel_id"), F.col("o_orderkey").alias("stream_id"), "o_totalprice")
    place = lambda *by: F.row_number().over(Window.partitionBy("channel_id").orderBy(*by))
    stamp = lambda d: d.select("channel_id", "stream_id", "slot", F.lit(0).cast("bigint").alias("written"), F.lit(False).alias("gone"))
    table = VersionedTable(spark, path(spark, "catalogue"))
    first = table.replace(stamp(orders.filter("stream_id % 3 > 0").withColumn("slot", place("stream_id"))), "pass 1")
    new = orders.withColumn("slot", place(F.desc("o_totalprice"), "stream_id"))
    table.replace(stamp(new), "pass 2")
    table.replace(stamp(new.limit(0)), "pass 3")
    some = new.filter("channel_id % 10 = 1")
    update_keys(table, "channel_id", some, some.filter("stream_id % 2 = 0").select("channel_id", "stream_id", (100 - F.col("slot")).alias("slot")), "reorder")
    return table, first


@stream_query(CATALOGUE_SQL + "SELECT * FROM new WHERE channel_id % 10 <> 1 UNION ALL SELECT * FROM upd")
def catalogue_published(spark, sf_dir):
    """The newest version of a catalogue after a replacement, an empty one that changes nothing, and new orders of some channels, some of them left without streams."""
    table, _ = _catalogue(spark, sf_dir)
    return newest(table.read(), "channel_id")


@stream_query(CATALOGUE_SQL + "SELECT * FROM old")
def catalogue_pinned(spark, sf_dir):
    """What a reader sees that holds on to the first version."""
    table, first = _catalogue(spark, sf_dir)
    return newest(table.read(first), "channel_id")
