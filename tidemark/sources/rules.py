"""A rules document (JSON) read into rows: channel rules with their lines, policies, patterns of groups and settings.

Documents are rows with the text in ``body``, so that any number of them is read by projections alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

MODES = ["always", "never", "after_epg_start", "assigned"]
RULE = """channel_id BIGINT, name STRING, enabled BOOLEAN, aliases ARRAY<STRING>, contains ARRAY<STRING>, exclude ARRAY<STRING>, providers STRING, exclude_regions ARRAY<STRING>,
 step_order BIGINT, patterns ARRAY<STRUCT<pattern: STRING, m3u_accounts: STRING, step_order: BIGINT>>"""


def scope(raw: Column) -> Column:
    """Sorted ids of providers from a JSON array, or such a text; null where there is none."""
    ids = F.array_sort(F.array_distinct(F.array_compact(F.transform(F.from_json(raw, "ARRAY<STRING>"), lambda i: i.try_cast("bigint")))))
    return F.when(F.size(ids) > 0, ids)


def globs(text: Column) -> Column:
    """Parts of a list with commas or line ends between, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, "[,\n]"), lambda g: F.trim(g)), lambda g: g != "")


def scope_override(event_only: Column, include: Column, asked_events: Column, asked_include: Column) -> list[Column]:
    """A configured scope with what a request says instead; an empty request clears the list, an absent one leaves what is configured."""
    events = F.when(asked_events.isNull(), event_only).otherwise(F.trim(asked_events).isin("1", "true", "yes", "on"))
    return [events.alias("event_only"), F.when(asked_include.isNull(), include).otherwise(globs(asked_include)).alias("include")]


def truth(value: Column, default: bool) -> Column:
    """A switch that arrives as a truth value, number or text; unset keeps the default."""
    low = F.lower(F.trim(value))
    return F.when(value.isNull() | (value == ""), F.lit(default)).otherwise(~low.rlike("^(false|0|0\\.0|no|off)$"))


@F.pandas_udf(BooleanType())
def compiles(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for patterns in batches:
        yield pd.Series([_compiles(p) for p in patterns], dtype=bool)


def _compiles(pattern: str | None) -> bool:
    try:
        re.compile(pattern or "")
    except (re.error, OverflowError):
        return False
    return True


def _policy(p: Column) -> list[Column]:
    mode = F.coalesce(p["mode"], F.lit("always"))
    minutes = lambda name, default: F.coalesce(p[name].try_cast("bigint"), F.lit(default).cast("bigint")).alias(name)
    return [
        F.when(mode.isin(MODES), mode).otherwise("always").alias("mode"), minutes("grace_minutes", 5), minutes("window_minutes", 180),
        truth(p["require_live"], True).alias("require_live"), truth(F.coalesce(p["audio_only"], p["audioOnly"]), False).alias("audio_only"),
        truth(F.coalesce(p["measure_only"], p["measureOnly"]), False).alias("measure_only"),
    ]


FIELDS = "mode STRING, grace_minutes STRING, window_minutes STRING, require_live STRING, audio_only STRING, audioOnly STRING, measure_only STRING, measureOnly STRING"


def policies(docs: DataFrame) -> DataFrame:
    """Policies by group from ``groups``: a mode's name or an object. Keys that are no whole number are dropped, unknown modes are `always`."""
    d = docs.select(F.explode(F.from_json("body", "groups MAP<STRING, STRING>")["groups"]).alias("key", "value"))
    d = d.filter(F.trim("key").rlike(r"^-?\d+$") & F.col("value").isNotNull())
    p = F.when(F.startswith("value", F.lit("{")), F.from_json("value", FIELDS)).otherwise(F.from_json(F.to_json(F.struct(F.col("value").alias("mode"))), FIELDS))
    return d.select(F.col("key").try_cast("bigint").alias("group_id"), p.alias("p")).select("group_id", *_policy(F.col("p")))


def group_patterns(docs: DataFrame) -> DataFrame:
    """Policies by name pattern from ``group_patterns``, with their order; blank patterns are dropped."""
    d = docs.select(F.posexplode(F.from_json("body", "group_patterns ARRAY<STRING>")["group_patterns"]).alias("ord", "row"))
    d = d.select(F.col("ord").cast("bigint").alias("ord"), F.from_json("row", f"pattern STRING, {FIELDS}").alias("p")).withColumn("pattern", F.trim("p.pattern"))
    return d.filter(F.coalesce("pattern", F.lit("")) != "").select("ord", "pattern", *_policy(F.col("p")))


def _entries(docs: DataFrame) -> DataFrame:
    d = docs.select(F.explode(F.from_json("body", "channels ARRAY<STRING>")["channels"]).alias("row")).select(F.from_json("row", RULE).alias("r")).select("r.*")
    return d.filter(F.coalesce("enabled", F.lit(True)))


def patterns(docs: DataFrame) -> DataFrame:
    """Patterns of enabled rules, in their order, with `usable` for those that compile."""
    d = _entries(docs).select("channel_id", F.posexplode("patterns").alias("ord", "p")).filter(F.coalesce("p.pattern", F.lit("")) != "")
    step = F.coalesce("p.step_order", F.lit(0).cast("bigint"))
    return d.select("channel_id", F.col("ord").cast("bigint").alias("ord"), F.col("p.pattern").alias("pattern"), step.alias("step"), scope(F.col("p.m3u_accounts")).alias("providers"), compiles("p.pattern").alias("usable"))


def rules(docs: DataFrame) -> DataFrame:
    """Enabled rules that have an alias, a needle or a pattern that compiles."""
    hits = patterns(docs).filter("usable").groupBy("channel_id").agg(F.count(F.lit(1)).alias("patterns"))
    none = F.array().cast("array<string>")
    d = _entries(docs).drop("patterns").join(hits, "channel_id", "left")
    d = d.select(
        "channel_id", F.coalesce("name", F.lit("")).alias("name"), *[F.coalesce(c, none).alias(c) for c in ("aliases", "contains", "exclude")], scope(F.col("providers")).alias("providers"),
        F.coalesce("step_order", F.lit(0).cast("bigint")).alias("step_order"), F.transform("exclude_regions", lambda r: F.upper(r)).alias("exclude_regions"), F.coalesce("patterns", F.lit(0).cast("bigint")).alias("patterns"),
    )
    return d.filter((F.size("aliases") > 0) | (F.size("contains") > 0) | (F.col("patterns") > 0))
