"""Writes and lookups on the tables of verdicts, samples and passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.versions import VersionedTable

DAY = 86_400_000
NAME_CHARS = 200
KEPT = {"verdicts": 30 * DAY, "runs": 30 * DAY, "samples": 90 * DAY}


def younger(rows: DataFrame, at: str, now: int, most: int) -> DataFrame:
    """Rows no older than `most`."""
    return rows.filter(F.col(at) >= now - most)


def recorded(samples: DataFrame, now: int) -> DataFrame:
    """Samples as they are appended: names cut, numbers rounded, stamped."""
    half_up = lambda c: F.floor(F.col(c) + 0.5).cast("bigint")
    return samples.withColumns(
        {"stream_name": F.substring("stream_name", 1, NAME_CHARS), "bitrate_kbps": half_up("bitrate_kbps"), "height": half_up("height"), "sampled_at": F.lit(now).cast("bigint")}
    )


def started(runs: DataFrame, new: DataFrame, now: int) -> DataFrame:
    """Passes after some begin: a new row replaces one of its id, and those past their time go."""
    fresh = new.withColumn("started_at", F.lit(now).cast("bigint"))
    fresh = fresh.select(*[F.col(c) if c in fresh.columns else F.lit(None).cast(runs.schema[c].dataType).alias(c) for c in runs.columns])
    return younger(runs.join(new.select("run_id"), "run_id", "left_anti").select(*runs.columns).unionByName(fresh), "started_at", now, KEPT["runs"])


def finished(runs: DataFrame, updates: DataFrame, now: int) -> DataFrame:
    """Passes after some end: of an update (run_id, seq and any columns) only what is not null is written, later ones over earlier ones; others stay."""
    names = [c for c in updates.columns if c not in ("run_id", "seq")]
    last = updates.groupBy("run_id").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"u_{c}") for c in names])
    d = runs.join(last.withColumn("ended", F.lit(now).cast("bigint")), "run_id", "left")
    was = F.col("finished_at") if "finished_at" in runs.columns else F.lit(None).cast("bigint")
    kept = [F.coalesce(f"u_{c}", c).alias(c) if c in names else F.col(c) for c in runs.columns if c != "finished_at"]
    return d.select(*kept, F.coalesce("ended", was).alias("finished_at"))


#: Tables that a reset empties; settings and rules stay.
RESET = ["probe_cache", "runs", "refresh_marks", "catalogue", "catalogue_state", "assign_blocks", "quality_samples"]


def reset(tables: dict[str, VersionedTable]) -> None:
    """Publishes an empty version of each of the tables that a reset is about; readers of older versions keep theirs."""
    for name in RESET:
        if name in tables:
            tables[name].empty("reset")


def split_by_variant(cache: DataFrame) -> DataFrame:
    """Verdicts with a variant in their key: those that were kept before variants belong to variant 0."""
    return cache if "variant_id" in cache.columns else cache.withColumn("variant_id", F.lit(0).cast("bigint"))


def entry(cache: DataFrame, key: DataFrame) -> DataFrame:
    """The kept verdicts of given keys (stream_id and stream_hash, with variant_id or of all variants): probed_at, alive, dead_streak and the result as JSON.

    A result that cannot be read is null, while the row's age and streak still hold: the probe that wrote it did happen.
    """
    readable = F.get_json_object("result", "$").isNotNull()
    found = cache.join(key.distinct(), key.columns, "left_semi")
    return found.select("stream_id", "stream_hash", "variant_id", "probed_at", "alive", F.coalesce("dead_streak", F.lit(0)).alias("dead_streak"), F.when(readable, F.col("result")).alias("result"))


def by_id(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Rows of given ids; ids that nothing has give null columns, as a lookup that finds nothing does."""
    return ids.select(column).distinct().join(rows, column, "left")
