"""Additive effects of tier, group and provider on quality, and rules made from them."""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import half_up
from tidemark.sources.scratch import folder

FACTORS = ["tier", "group_name", "provider_name"]


#: Cells of tier, group and provider up to which the fit is solved from its pair sums on the driver; beyond, each round is a Spark job.
MOST_CELLS = 2_000_000


def fitted(buckets: DataFrame, rounds: int = 20, least_move: float = 1.0, most_cells: int = MOST_CELLS) -> DataFrame:
    """factor, key, samples, effective_kbps, delta_kbps, baseline_kbps: weighted backfitting over tier, group, provider in turn.

    buckets: the three factors, effective_kbps and samples (the weight). Each level is the weighted mean of what the others leave,
    then each factor is centred; it ends when no level moved by least_move before centring. A round needs nothing but the weights of pairs of levels
    and each level's weighted sum, which one aggregation over the cells gives; they are as many as an installation has providers times groups,
    whatever its samples. Where there are more than most_cells, rounds run on Spark.
    """
    folder(buckets.sparkSession)
    d = buckets.groupBy(*FACTORS).agg(F.sum("samples").cast("double").alias("w"), (F.sum(F.col("effective_kbps") * F.col("samples")) / F.sum("samples")).alias("y"))
    d = d.checkpoint()
    if d.count() > most_cells:
        return _fitted_on_spark(d, rounds, least_move)
    cells = d.toPandas()
    w, y = cells["w"].to_numpy(float), cells["y"].to_numpy(float)
    grand = float((w * y).sum() / w.sum()) if len(w) else 0.0
    codes, keys = zip(*[pd.factorize(cells[f]) for f in FACTORS], strict=True)
    weight = [np.bincount(c, w) for c in codes]
    own = [np.bincount(c, w * (y - grand)) for c in codes]
    pairs = {}
    for a, b in permutations(range(len(FACTORS)), 2):
        both, at = np.unique(codes[a].astype(np.int64) * len(keys[b]) + codes[b], return_inverse=True)
        pairs[a, b] = both // max(len(keys[b]), 1), both % max(len(keys[b]), 1), np.bincount(at, w)
    effect = [np.zeros(len(k)) for k in keys]
    for _ in range(rounds):
        moved = 0.0
        for f in range(len(FACTORS)):
            left = own[f].copy()
            for o in range(len(FACTORS)):
                if o != f and len(keys[f]):
                    mine, theirs, sums = pairs[f, o]
                    left -= np.bincount(mine, sums * effect[o][theirs], len(keys[f]))
            new = left / weight[f] if len(left) else left
            moved = max(moved, float(np.abs(new - effect[f]).max(initial=0)))
            effect[f] = new - (new * weight[f]).sum() / max(weight[f].sum(), 1e-300)
        if moved < least_move:
            break
    rows = [(f, k, int(n), float(e)) for f, ks, ns, es in zip(FACTORS, keys, weight, effect, strict=True) for k, n, e in zip(ks, ns, es, strict=True)]
    out = buckets.sparkSession.createDataFrame(rows, "factor string, key string, samples bigint, effect double")
    base = half_up(F.lit(grand))
    delta = half_up(F.col("effect"))
    return out.select("factor", "key", "samples", (base + delta).alias("effective_kbps"), delta.alias("delta_kbps"), base.alias("baseline_kbps"))


def _fitted_on_spark(d: DataFrame, rounds: int, least_move: float) -> DataFrame:
    """The same fit with effects as columns of the cells: one number a factor and round comes to the driver, and a checkpoint cuts lineage."""
    w, y = F.col("w"), F.col("y")
    grand = d.agg((F.sum(w * y) / F.sum(w)).alias("g")).first()["g"]
    if grand is None:
        grand = 0.0
    d = d.select("*", *[F.lit(0.0).alias(f"e_{f}") for f in FACTORS])
    for _ in range(rounds):
        moved = F.lit(0.0)
        for f in FACTORS:
            others = sum((F.col(f"e_{o}") for o in FACTORS if o != f), F.lit(0.0))
            level = d.groupBy(f).agg((F.sum((y - grand - others) * w) / F.sum(w)).alias("new"), F.sum("w").alias("lw"), F.first(f"e_{f}").alias("old"))
            centre = level.agg((F.sum(F.col("new") * F.col("lw")) / F.sum("lw")).alias("centre"), F.max(F.abs(F.col("new") - F.col("old"))).alias(f"m_{f}"))
            level = level.join(F.broadcast(centre)).select(f, (F.col("new") - F.col("centre")).alias(f"e_{f}"), f"m_{f}")
            d = d.drop(f"e_{f}", f"m_{f}").join(level, f)
        d = d.checkpoint()
        moved = d.agg(F.max(F.greatest(*[f"m_{f}" for f in FACTORS])).alias("m")).first()["m"]
        if moved is None or moved < least_move:
            break
    base = half_up(F.lit(float(grand)))
    out = None
    for f in FACTORS:
        part = d.groupBy(F.col(f).alias("key")).agg(F.sum("w").cast("bigint").alias("samples"), half_up(F.first(f"e_{f}")).alias("delta_kbps"))
        part = part.select(F.lit(f).alias("factor"), "key", "samples", (base + F.col("delta_kbps")).alias("effective_kbps"), "delta_kbps", base.alias("baseline_kbps"))
        out = part if out is None else out.unionByName(part)
    return out


def points(delta: Column, per_mbps: float = 5, most: int = 15) -> Column:
    return F.greatest(F.lit(-most), F.least(F.lit(most), half_up(delta / 1000 * F.lit(float(per_mbps))))).cast("bigint")


def rules(effects: DataFrame, tier_patterns: dict[str, str], min_samples: int = 20) -> DataFrame:
    """One rule a provider, group and tier with enough samples and points other than 0; the unknown tier is the reference and has none."""
    kind = F.when(F.col("factor") == "provider_name", "m3u").when(F.col("factor") == "group_name", "group").otherwise("regex")
    value = F.col("key")
    for tier, pattern in tier_patterns.items():
        value = F.when((F.col("factor") == "tier") & (F.col("key") == tier), F.lit(pattern)).otherwise(value)
    d = effects.filter((F.col("samples") >= min_samples) & (F.trim("key") != "") & ~((F.col("factor") == "tier") & (F.col("key") == "unknown")))
    d = d.select(kind.alias("type"), value.alias("value"), F.lit(99).alias("priority"), F.lit("score").alias("mode"), points(F.col("delta_kbps")).alias("points"))
    return d.filter("points <> 0")


def merged(existing: DataFrame, generated: DataFrame) -> DataFrame:
    """Existing rules with those of the same (type, value, mode) replaced, then the generated ones that none had; both have `ord`.

    Values compare trimmed and in lower case, a null mode counts as priority. Of generated rules with one key the last holds.
    """
    key = [F.col("type").alias("k_type"), F.lower(F.trim("value")).alias("k_value"), F.coalesce("mode", F.lit("priority")).alias("k_mode")]
    names = ["k_type", "k_value", "k_mode"]
    body = ["type", "value", "priority", "mode", "points"]
    new = generated.select(*key, "ord", F.struct(*body).alias("new"))
    new = new.groupBy(*names).agg(F.max_by("new", "ord").alias("new"), F.min("ord").alias("new_ord"))
    old = existing.select(*key, F.col("ord").alias("old_ord"), F.struct(*body).alias("old"))
    d = old.join(new, names, "full_outer")
    rule = F.coalesce("new", "old")
    return d.select(F.col("old_ord").isNull().alias("appended"), F.coalesce("old_ord", "new_ord").alias("ord"), (F.col("old").isNotNull() & F.col("new").isNotNull()).alias("replaced"), *[rule[c].alias(c) for c in body])
