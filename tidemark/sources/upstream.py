"""Raw JSON of an upstream catalogue read into rows: channels, streams, groups, providers, programmes and sessions.

Every function takes a DataFrame with one JSON text per row in ``body`` and is a projection, so files of any number and size
are read where they lie. Fields that a body lacks are null and get their defaults here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHANNEL = """id BIGINT, uuid STRING, name STRING, effective_name STRING, tvg_id STRING, effective_tvg_id STRING, streams ARRAY<BIGINT>,
 channel_group_id BIGINT, effective_channel_group_id BIGINT"""
STREAM = "id BIGINT, name STRING, url STRING, m3u_account BIGINT, stream_hash STRING, current_viewers BIGINT, channel_group BIGINT"
PROVIDER = """id BIGINT, name STRING, max_streams BIGINT, is_active BOOLEAN, account_type STRING, profiles ARRAY<STRUCT<id BIGINT, name STRING, is_default BOOLEAN,
 is_active BOOLEAN, max_streams BIGINT, current_viewers BIGINT, search_pattern STRING, replace_pattern STRING>>"""
PROGRAMME = "id STRING, tvg_id STRING, start_time STRING, end_time STRING, title STRING, is_live BOOLEAN"
UNBOUNDED = 4


def _said(*columns: str) -> Column:
    """The first of the columns that is neither null nor empty, else empty."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns], F.lit(""))


def _is_object(text: Column) -> Column:
    """Whether a JSON text is an object; read as an array, it would pass for an array of one."""
    return F.startswith(F.ltrim(text), F.lit("{"))


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of paged listings: files that hold an array, or an object with ``results``, in the order of their names and then of their rows.

    Columns are page (the file's name), ord and body. Files are read whole, one page each, as many at a time as there are cores.
    """
    raw = spark.read.text(folder, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("page"), "value")
    bare = F.from_json("value", "ARRAY<STRING>")
    rows = F.when(_is_object(F.col("value")), F.from_json("value", "results ARRAY<STRING>")["results"]).otherwise(bare)
    return raw.select("page", F.posexplode(rows).alias("ord", "body"))


def channels(rows: DataFrame) -> DataFrame:
    d = rows.select(F.from_json("body", CHANNEL).alias("c")).select("c.*")
    group = F.coalesce("effective_channel_group_id", "channel_group_id")
    return d.select(
        F.col("id").alias("channel_id"), F.coalesce("uuid", F.lit("")).alias("uuid"), _said("effective_name", "name").alias("name"),
        _said("effective_tvg_id", "tvg_id").alias("tvg_id"), F.coalesce("streams", F.array().cast("array<bigint>")).alias("streams"), group.alias("group_id"),
    )


def streams(rows: DataFrame) -> DataFrame:
    """Streams that have a URL."""
    d = rows.select(F.from_json("body", STREAM).alias("s")).select("s.*").filter(_said("url") != "")
    zero, empty = F.lit(0).cast("bigint"), F.lit("")
    return d.select(
        F.col("id").alias("stream_id"), F.coalesce("name", empty).alias("name"), "url", F.coalesce("m3u_account", zero).alias("provider_id"),
        F.coalesce("stream_hash", empty).alias("stream_hash"), F.coalesce("current_viewers", zero).alias("viewers"), F.col("channel_group").alias("group_id"),
    )


def groups(rows: DataFrame) -> DataFrame:
    d = rows.select(F.from_json("body", "id BIGINT, name STRING").alias("g")).select("g.*")
    return d.select(F.col("id").alias("group_id"), F.coalesce(F.nullif("name", F.lit("")), F.col("id").cast("string")).alias("group_name"))


def _active(rows: DataFrame) -> DataFrame:
    return rows.select(F.from_json("body", PROVIDER).alias("p")).select("p.*").filter(F.coalesce("is_active", F.lit(True)))


def providers(rows: DataFrame) -> DataFrame:
    """Active providers; without a bound they get one of four."""
    name = F.coalesce(F.nullif("name", F.lit("")), F.col("id").cast("string"))
    most = F.coalesce(F.nullif("max_streams", F.lit(0)), F.lit(UNBOUNDED).cast("bigint"))
    return _active(rows).select(F.col("id").alias("provider_id"), name.alias("provider_name"), most.alias("max_streams"), F.coalesce("account_type", F.lit("STD")).alias("account_type"))


def profiles(rows: DataFrame) -> DataFrame:
    """Profiles of active providers, in the form that logins are made from."""
    d = _active(rows).select(F.col("id").alias("provider_id"), F.posexplode("profiles").alias("ord", "p"))
    p = F.col("p")
    return d.select(
        "provider_id", p["id"].alias("profile_id"), F.col("ord").cast("bigint").alias("ord"), F.coalesce(F.nullif(p["name"], F.lit("")), p["id"].cast("string")).alias("name"),
        F.coalesce(p["is_default"], F.lit(False)).alias("is_default"), F.coalesce(p["is_active"], F.lit(True)).alias("is_active"), F.nullif(p["max_streams"], F.lit(0)).alias("max_streams"),
        F.coalesce(p["current_viewers"], F.lit(0).cast("bigint")).alias("viewers"), F.coalesce(p["search_pattern"], F.lit("")).alias("search"), F.coalesce(p["replace_pattern"], F.lit("")).alias("replace"),
    )


def programmes(bodies: DataFrame) -> DataFrame:
    """Programmes of whole grids (an array, or an object with ``data``); generated ones, whose id says so, are dropped."""
    kind = f"ARRAY<STRUCT<{_typed(PROGRAMME)}>>"
    rows = F.when(_is_object(F.col("body")), F.from_json("body", f"data {kind}")["data"]).otherwise(F.from_json("body", kind))
    d = bodies.select(F.posexplode(rows).alias("ord", "r")).select("ord", "r.*").filter(~F.coalesce(F.startswith("id", F.lit("dummy-")), F.lit(False)))
    ms = lambda c: F.unix_millis(F.try_to_timestamp(F.col(c)))
    return d.select("tvg_id", ms("start_time").alias("start_ms"), ms("end_time").alias("end_ms"), "title", F.coalesce("is_live", F.lit(False)).alias("is_live"), F.col("ord").cast("bigint").alias("ord"))


def _typed(ddl: str) -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in (f.split() for f in ddl.split(", ")))


def _channel(value: Column, uuid_value: Column, loose: bool) -> Column:
    """A channel's id from a number, a numeric text or a known uuid. A text with a dash is a uuid, unless taken loosely."""
    number = F.when(F.trim(value) != "", value.try_cast("double").cast("bigint"))
    return F.coalesce(number if loose else F.when(~F.contains(value, F.lit("-")) | value.rlike(r"^-?\d+$"), number), uuid_value)


def sessions(bodies: DataFrame, uuids: DataFrame) -> DataFrame:
    """Sessions (channel_id, profile_id) of status bodies: entries are ids, uuids, or objects that name a channel.

    `uuids` has uuid and channel_id. A body that counts sessions of which none names a channel fails the query.
    """
    one = "channel_id STRING, id STRING, channel STRING, m3u_profile_id STRING"
    d = bodies.select(F.monotonically_increasing_id().alias("at"), F.from_json("body", "channels ARRAY<STRING>, count BIGINT").alias("b"))
    d = d.select("at", F.posexplode_outer("b.channels").alias("n", "entry"), F.greatest(F.coalesce("b.count", F.lit(0)), F.coalesce(F.size("b.channels"), F.lit(0))).alias("counted"))
    made = F.startswith("entry", F.lit("{"))
    d = d.withColumn("o", F.when(made, F.from_json("entry", one)))
    names = F.when(made, F.array_compact(F.array("o.channel_id", "o.id", "o.channel"))).otherwise(F.array("entry"))
    d = d.select("at", "n", "counted", made.alias("made"), F.col("o.m3u_profile_id").alias("profile"), F.posexplode_outer(names).alias("k", "value"))
    d = d.join(uuids.select(F.col("uuid").alias("value"), F.col("channel_id").alias("known")), "value", "left")
    found = F.when(F.col("made"), _channel(F.col("value"), F.col("known"), loose=False)).otherwise(_channel(F.col("value"), F.col("known"), loose=True))
    d = d.withColumn("channel_id", found)
    first = d.groupBy("at", "n").agg(F.max("counted").alias("counted"), F.min_by("channel_id", F.when(F.col("channel_id").isNotNull(), F.col("k"))).alias("channel_id"), F.first("profile").alias("profile"))
    some = F.count("channel_id").over(Window.partitionBy("at"))
    checked = F.when((F.col("counted") > 0) & (some == 0), F.raise_error(F.lit("sessions are counted but none names a channel"))).otherwise(F.col("channel_id"))
    profile = F.when(F.trim("profile") != "", F.col("profile").try_cast("double").cast("bigint"))
    return first.withColumn("channel_id", checked).filter(F.col("channel_id").isNotNull()).select("channel_id", profile.alias("profile_id"))


def activity(bodies: DataFrame, found: DataFrame) -> DataFrame:
    """One row about who watches: channels, idle, probe_failed. A status that is missing or cannot be read counts as busy, and says so."""
    state = F.from_json("body", "channels ARRAY<STRING>, count BIGINT")
    broken = F.col("body").isNull() | ~_is_object(F.col("body")) | (F.coalesce(state["channels"].isNull() & state["count"].isNull(), F.lit(True)))
    read = bodies.agg((F.count(F.lit(1)) == 0).alias("missing"), F.coalesce(F.bool_or(broken), F.lit(False)).alias("broken"))
    seen = found.agg(F.count(F.lit(1)).alias("sessions"), F.count_distinct("channel_id").alias("channels"))
    failed = F.col("missing") | F.col("broken")
    d = read.join(seen)  # two single rows
    return d.select(F.when(~failed, F.col("channels")).alias("channels"), (~failed & (F.col("sessions") == 0)).alias("idle"), failed.alias("probe_failed"))


def profile_viewers(found: DataFrame) -> DataFrame:
    """Sessions of each profile that a session names."""
    return found.filter("profile_id IS NOT NULL").groupBy("profile_id").agg(F.count(F.lit(1)).alias("viewers"))


def with_fallback(rows: DataFrame, other: DataFrame) -> DataFrame:
    """The rows of a source, or those of another where it gave none."""
    none = rows.agg((F.count(F.lit(1)) == 0).alias("none")).scalar()
    return rows.unionByName(other.select(rows.columns).filter(none))
