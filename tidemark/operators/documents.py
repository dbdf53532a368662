"""Edits of a rules document as rows: lists, orderings and channels' rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODES = ["quality", "provider", "alias"]


def clean_list(values: Column) -> Column:
    """Trimmed parts in their order, without empty ones and repeats."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.trim(v)), lambda v: v != ""))


def ordering(mode: Column, preference: Column, weights: dict[str, Column]) -> list[Column]:
    """What is stored of an ordering: a known mode, a clean list of providers, and weights where what is given is a finite number."""
    known = F.when(mode.isin(*MODES), mode).otherwise("quality")
    finite = lambda w: F.coalesce(F.when(F.abs(w) < float("inf"), w), F.lit(0.0))
    return [known.alias("mode"), clean_list(preference).alias("provider_preference"), *[finite(w).alias(k) for k, w in weights.items()]]


def rules_edited(rules: DataFrame, edits: DataFrame) -> DataFrame:
    """Channels' rules (channel_id, enabled, aliases, contains, exclude, providers) after edits of some.

    An edit's lists replace the rule's. Its providers do where `providers_given`: an empty list there takes the scope away. A channel without a rule gets one. Of
    edits of one channel the last (by `ord`) counts.
    """
    lists = ["aliases", "contains", "exclude"]
    last = edits.groupBy("channel_id").agg(F.max_by(F.struct(*lists, "providers", "providers_given"), "ord").alias("e"))
    d = rules.withColumn("known", F.lit(True)).join(last, "channel_id", "full")
    edited = F.col("e").isNotNull()
    scope = F.when(F.size("e.providers") > 0, F.col("e.providers"))
    providers = F.when(edited & F.col("e.providers_given"), scope).otherwise(F.col("providers"))
    return d.select(
        "channel_id", F.coalesce("enabled", F.lit(True)).alias("enabled"), *[F.when(edited, clean_list(F.col(f"e.{c}"))).otherwise(F.col(c)).alias(c) for c in lists], providers.alias("providers"),
    )
