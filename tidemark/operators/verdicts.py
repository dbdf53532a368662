"""Verdicts of streams: dead streaks, cache health, scores and ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import audio_score, audio_term, verdict_ttl, video_usable

KEY = ["stream_id", "stream_hash", "variant_id"]
ORDER = ["probed_at", "l_orderkey", "l_linenumber", "tie"]


def latest(log: DataFrame) -> DataFrame:
    """The last verdict of each key, with how many failures in a row it ends: those after the last that was alive. One exchange and one sort."""
    whole = Window.partitionBy(*KEY)
    d = log.withColumn("rn", F.row_number().over(whole.orderBy(*ORDER)))
    d = d.withColumns({"n": F.count(F.lit(1)).over(whole), "seen": F.max(F.when(F.col("alive"), F.col("rn"))).over(whole)})
    return d.filter("rn = n").withColumn("dead_streak", F.col("n") - F.coalesce("seen", F.lit(0))).drop("rn", "n", "seen")


def due_at(v: DataFrame, now: int, forced: int, live: int, dead: int, most: int, unknown: int) -> Column:
    ttl = verdict_ttl(F.col("alive"), F.col("bitrate_kbps"), F.col("dead_streak"), live, dead, most, unknown)
    return F.when(F.col("probed_at") <= forced, F.lit(now).cast("bigint")).otherwise(F.col("probed_at") + ttl)


def cache_health(v: DataFrame, now: int, forced: int, **ttl: int) -> DataFrame:
    """One row about all streams: how many, alive, due, and by age."""
    per = v.withColumn("due", due_at(v, now, forced, **ttl)).groupBy("stream_id")
    per = per.agg(F.max(F.col("alive").cast("int")).alias("alive"), F.min("probed_at").alias("at"), F.min("due").alias("due"))
    age = F.lit(now) - F.col("at")
    return per.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("alive") == 1).alias("alive"), F.min("at").alias("oldest"), F.max("at").alias("newest"),
        F.min("due").alias("next_due"), F.count_if(F.col("due") <= now).alias("due"), F.count_if(age < 3_600_000).alias("hour"),
        F.count_if((age >= 3_600_000) & (age < 21_600_000)).alias("six_hours"), F.count_if((age >= 21_600_000) & (age < 86_400_000)).alias("day"),
        F.count_if(age >= 86_400_000).alias("older"),
    )


def scored(v: DataFrame, floor_kbps: int = 500, weights: tuple[float, ...] = (0.35, 0.4, 0.15, 0.1, 0.0), prefer_h265: bool = True) -> DataFrame:
    """Verdicts with usable and score: height, bitrate, fps, codec and audio terms, weighted, normalised, to four places half up."""
    share = lambda c, most: F.least(F.col(c) / F.lit(float(most)), F.lit(1.0))
    best, other = ("hevc", "h264") if prefer_h265 else ("h264", "hevc")
    codec = F.when(F.col("video_codec") == best, 1.0).when(F.col("video_codec") == other, 0.5).otherwise(0.25)
    audio = audio_term(F.col("audio_channels"), F.col("audio_bitrate_kbps") if "audio_bitrate_kbps" in v.columns else F.lit(0))
    terms = [share("height", 2160), share("bitrate_kbps", 12000), share("fps", 60), codec, audio]
    total = sum((t * F.lit(w) for t, w in zip(terms[1:], weights[1:], strict=True)), terms[0] * F.lit(weights[0])) / F.lit(sum(weights))
    usable = video_usable(F.col("alive"), F.col("black"), F.col("bitrate_kbps"), floor_kbps)
    score = F.when(usable, F.floor(F.least(total, F.lit(1.0)) * 10000 + 0.5) / 10000).otherwise(F.lit(0.0))
    return v.withColumn("usable", usable).withColumn("score", score)


def audio_scored(v: DataFrame) -> DataFrame:
    """Verdicts of streams that are sound alone, with usable and score; any sign of sound makes one usable."""
    sound = (F.col("audio_bitrate_kbps") > 0) | (F.col("bitrate_kbps") > 0) | (F.col("audio_channels") > 0)
    usable = F.col("alive") & ~F.col("black") & sound
    score = audio_score(*[F.col(c) for c in ("audio_channels", "audio_bitrate_kbps", "bitrate_kbps", "audio_sample_rate", "audio_codec")])
    return v.withColumn("usable", usable).withColumn("score", F.when(usable, score).otherwise(F.lit(0.0)))


def best_of_stream(v: DataFrame) -> DataFrame:
    """The best verdict of each stream: usable, measured, score, then the smallest variant."""
    keys = [F.desc("usable"), F.desc(F.col("bitrate_kbps") > 0), F.desc("score"), "variant_id", "stream_hash"]
    w = Window.partitionBy("stream_id").orderBy(*keys)
    return v.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def ranked(v: DataFrame, by: list[str], first: list[Column]) -> DataFrame:
    """Places within a partition: usable ones first, then `first`, known bitrates, score and stream id."""
    w = Window.partitionBy(*by).orderBy(F.desc("usable"), *first, F.desc(F.col("bitrate_kbps") > 0), F.desc("score"), "stream_id")
    return v.withColumn("place", F.row_number().over(w).cast("bigint"))


def without_outside(v: DataFrame, keep: DataFrame, least_share: float = 0.2, least_rows: int = 50) -> DataFrame:
    """Verdicts of kept streams only. Nothing goes where `keep` is empty, or where it is suspiciously small for that many rows."""
    rows = v.agg(F.count(F.lit(1)).alias("rows"))
    kept = keep.select("stream_id").distinct()
    held = kept.agg(F.count(F.lit(1)).alias("kept"))
    sane = rows.join(held).select(((F.col("kept") > 0) & ((F.col("rows") <= least_rows) | (F.col("kept") >= F.col("rows") * least_share))).alias("sane"))
    d = v.join(kept.withColumn("inside", F.lit(True)), "stream_id", "left").join(F.broadcast(sane))
    return d.filter(~F.col("sane") | F.col("inside")).drop("inside", "sane")
