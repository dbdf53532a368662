"""Settings as rows: validation of a patch, upserts, and the overlay of stored values, environment and defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.texts import NUMBER, TRUE_WORDS, number

# fields: key, kind (number, boolean, url, secret, text), scale, least, most (null where there is none), fallback


def validated(patch: DataFrame, fields: DataFrame) -> DataFrame:
    """key, value, fault of each row of a patch (key, raw): what would be stored, null to hand the key back, or why not.

    Numbers are given in shown units: bounds apply to those, the stored value is scaled and rounded.
    """
    text = F.trim("raw")
    n = F.when(text.rlike(NUMBER), text.try_cast("double"))
    stored = F.when(F.col("scale").isNotNull(), F.floor(n * F.col("scale") + 0.5).cast("double")).otherwise(n)
    shown = F.when(stored == F.floor(stored), stored.cast("bigint").cast("string")).otherwise(stored.cast("string"))
    bound = lambda c: F.col(c).cast("bigint").cast("string")
    url = text.rlike("^(?i)https?://[^/?#]+")
    fault = (
        F.when(F.col("kind").isNull(), "not a settable field")
        .when(F.coalesce("raw", F.lit("")) == "", None)
        .when((F.col("kind") == "number") & (n.isNull() | (n < 0)), "must be a non-negative number")
        .when((F.col("kind") == "number") & (n < F.col("least")), F.concat(F.lit("must be at least "), bound("least")))
        .when((F.col("kind") == "number") & (n > F.col("most")), F.concat(F.lit("must be at most "), bound("most")))
        .when((F.col("kind") == "url") & ~url, "must be an http(s) URL")
    )
    value = (
        F.when(F.coalesce("raw", F.lit("")) == "", None)
        .when(F.col("kind") == "number", shown)
        .when(F.col("kind") == "boolean", F.when(F.lower(text).isin(TRUE_WORDS), "true").otherwise("false"))
        .when(F.col("kind") == "url", F.regexp_replace(text, "/+$", ""))
        .otherwise(text)
    )
    d = patch.join(fields.select("key", "kind", "scale", "least", "most"), "key", "left").withColumn("fault", fault)
    return d.select("key", F.when(F.col("fault").isNull(), value).alias("value"), "fault")


def stored_after(stored: DataFrame, values: DataFrame, now: int) -> DataFrame:
    """Stored rows (key, value, updated_at) after a write of values (key, value); a null value takes its key away."""
    kept = stored.join(values.select("key"), "key", "left_anti").select("key", "value", "updated_at")
    return kept.unionByName(values.filter("value IS NOT NULL").select("key", "value", F.lit(now).cast("bigint").alias("updated_at")))


def version(rows: DataFrame, at: str = "updated_at") -> DataFrame:
    """When rows last changed, 0 for none."""
    return rows.agg(F.coalesce(F.max(at), F.lit(0)).cast("bigint").alias("version"))


def effective(fields: DataFrame, environment: DataFrame, stored: DataFrame) -> DataFrame:
    """Each field's value and source: stored over environment over fallback; only known fields, and secrets as set or not."""
    d = fields.join(environment.select("key", F.col("value").alias("env")), "key", "left").join(stored.select("key", F.col("value").alias("own")), "key", "left")
    given = F.coalesce("own", "env", F.lit(""))
    source = F.when(F.col("own").isNotNull(), "stored").when(F.coalesce("env", F.lit("")) != "", "environment").otherwise("default")
    return d.select("key", F.when(F.col("kind") == "secret", "").otherwise(given).alias("value"), (given != "").alias("is_set"), source.alias("source"), F.coalesce(F.nullif(given, F.lit("")), "fallback").alias("in_force"))


def coerced(in_force: DataFrame) -> DataFrame:
    """Numbers and flags as typed columns: what cannot be read falls back; in_force: key, kind, raw, fallback."""
    as_number = F.when(F.col("kind") == "number", number(F.coalesce("raw", F.lit("")), F.col("fallback").try_cast("double")))
    raw = F.coalesce(F.nullif(F.col("raw"), F.lit("")), "fallback")
    flag = F.when(F.col("kind") == "boolean", F.coalesce(F.lower(F.trim(raw)).isin(TRUE_WORDS), F.lit(False)))
    return in_force.select("key", as_number.alias("number"), flag.alias("flag"))
