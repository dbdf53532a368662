"""Quality samples: scope, buckets with index percentiles, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import half_up


def scope_verdict(event_only: bool, include: list[str], exclude: list[str], group: Column, mode: Column) -> Column:
    """Why a sample counts or not; exclude globs win over include globs, those over the event rule. Globs know * and ?."""

    def any_of(globs: list[str]) -> Column:
        out = F.lit(False)
        for g in globs:
            like = g.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%").replace("?", "_")
            out = out | ((group != "") & group.ilike(like))
        return F.coalesce(out, F.lit(False))

    verdict = F.when(any_of(exclude), "excluded").when(any_of(include), "in")
    if not event_only:
        return verdict.otherwise("not-included" if include else "in")
    return verdict.when(mode == "", "unrecorded").when(mode.isin("after_epg_start", "assigned"), "in").otherwise("not-event")


CELL = ["provider_id", "group_id", "tier", "audio_only"]


def at_fraction(value: str, fraction: float) -> Column:
    """Aggregate: the value at floor(fraction * n) in order, the last one at most; 0 without values.

    It is the discrete percentile from the other end. Spark holds counts of distinct values for it, map-side first, and never a cell's rows.
    """
    return F.coalesce(F.expr(f"percentile_disc({1 - fraction!r}D) WITHIN GROUP (ORDER BY {value} DESC)"), F.lit(0)).cast("bigint")


def buckets(samples: DataFrame) -> DataFrame:
    """One row per provider, group, tier and audio flag: rates, index percentiles and the effective bitrate, in one aggregation."""
    alive, black = F.col("alive"), F.col("black")
    rated = alive & F.col("measured") & ~black & (F.col("bitrate_kbps") > 0)
    own = {"rate": F.when(rated, F.col("bitrate_kbps")), "seen_height": F.when(alive & (F.col("height") > 0), F.col("height"))}
    n, n_alive = F.count(F.lit(1)), F.count_if(alive)
    out = samples.withColumns(own).groupBy(*CELL).agg(
        n.alias("samples"),
        (n_alive / n).alias("alive_rate"),
        F.when(n_alive == 0, F.lit(0.0)).otherwise(F.count_if(alive & black) / F.greatest(n_alive, F.lit(1))).alias("black_rate"),
        F.max("sampled_at").alias("last_sampled_at"),
        F.count("rate").alias("measured_samples"),
        at_fraction("rate", 0.5).alias("median_kbps"),
        at_fraction("rate", 0.9).alias("p90_kbps"),
        at_fraction("seen_height", 0.5).alias("median_height"),
    )
    return out.withColumn("effective_kbps", half_up(F.col("median_kbps") * F.col("alive_rate") * (1 - F.col("black_rate"))))


def trimmed(samples: DataFrame, newest: int) -> DataFrame:
    """The newest samples of each provider, tier and policy mode."""
    w = Window.partitionBy("provider_id", "tier", "policy_mode").orderBy(F.desc("sampled_at"), F.desc("l_orderkey"), F.desc("l_linenumber"), F.desc("tie"))
    return samples.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= newest).drop("rn")
