"""Exact medians of whole numbers by narrowing histograms, so that no group's rows are ever gathered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.scratch import written

#: Bins of a group's histogram.
BINS = 1 << 16


def medians(rows: DataFrame, by: str, value: Column, bins: int = BINS) -> DataFrame:
    """by, median (the mean of the two middle values), most: of whole numbers that are not null, exact for any number of rows.

    A pass counts each group's values by bin, map-side first, and goes on within the bin that a middle rank lies in; bins of one value end it. Spans of
    49 days of milliseconds take two passes. A group holds `bins` counts a middle rank at most.
    """
    d = written(rows.select(by, value.cast("bigint").alias("v")).filter("v IS NOT NULL"), "values")
    spans = d.groupBy(by).agg(F.min("v").alias("lo"), F.max("v").alias("most"), F.count(F.lit(1)).alias("n"))
    ranks = F.explode(F.array(F.expr("(n - 1) div 2"), F.expr("n div 2"))).alias("rank")
    zero = F.lit(0).cast("bigint")
    left = written(spans.select(by, "most", ranks, "lo", F.expr(f"(most - lo) div {bins} + 1").alias("width"), zero.alias("below")).withColumn("half", F.row_number().over(Window.partitionBy(by).orderBy("rank"))), "ranks")
    widest = left.agg(F.max("width")).first()[0] or 0
    while widest > 0:
        at = left.select(by, "lo", "width").distinct()
        binned = d.join(at, by).filter(f"v >= lo AND v - lo < width * {bins}").withColumn("bin", F.expr("(v - lo) div width"))
        counts = binned.groupBy(by, "lo", "width", "bin").agg(F.count(F.lit(1)).alias("k"))
        ahead = F.sum("k").over(Window.partitionBy(by, "lo", "width").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
        counts = counts.withColumn("ahead", F.coalesce(ahead, zero))
        met = left.join(counts, [by, "lo", "width"]).filter("rank >= below + ahead AND rank < below + ahead + k")
        done = widest == 1
        narrower = F.expr(f"(width - 1) div {bins} + 1")
        left = written(met.select(by, "most", "rank", (F.col("lo") + F.col("bin") * F.col("width")).alias("lo"), narrower.alias("width"), (F.col("below") + F.col("ahead")).alias("below"), "half"), "ranks")
        if done:
            break
        widest = left.agg(F.max("width")).first()[0]
    return left.groupBy(by).agg(F.avg("lo").alias("median"), F.max("most").alias("most"))
