"""What is published of verdicts and of learned rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import half_up
from tidemark.operators import effects


def stats(verdicts: DataFrame, by: str, probed_at: Column) -> dict[str, Column]:
    """The published fields of scored verdicts, by name; a verdict's bitrate is published under both names that readers know."""
    c = lambda name, none: F.coalesce(F.col(name), F.lit(none))
    kbps = half_up(F.col("bitrate_kbps"))
    size = F.when((F.col("width") > 0) & (F.col("height") > 0), F.concat_ws("x", F.col("width").cast("string"), F.col("height").cast("string"))).otherwise("0x0")
    error = F.when(c("error", "") == "", "dead").otherwise(F.col("error"))
    return {
        "width": F.col("width"), "height": F.col("height"), "resolution": size, "source_fps": F.col("fps"), "video_codec": F.col("video_codec"), "audio_codec": F.col("audio_codec"),
        "pixel_format": F.col("pixel_format"), "audio_channels": F.col("audio_channels"), "channel_layout": F.col("channel_layout"), "audio_bitrate": half_up(F.col("audio_bitrate_kbps")),
        "sample_rate": F.col("audio_sample_rate"), "video_bitrate": kbps, "ffmpeg_output_bitrate": kbps, "bitrate_measured": c("bitrate_measured", False), "blank_detected": c("black", False),
        "blank_seconds": c("black_seconds", 0.0), "quality_score": F.col("score"), "alive": F.col("alive"),
        "quality_reason": F.when(~F.col("alive"), error).when(c("black", False), "black screen").otherwise("ok"), "probed_by": F.lit(by), "probed_at": probed_at,
    }


def payloads(verdicts: DataFrame, key: str, by: str, probed_at: Column) -> DataFrame:
    """key and the published fields as a JSON text."""
    fields = stats(verdicts, by, probed_at)
    return verdicts.select(key, F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()])).alias("payload"))


def envelope(existing: DataFrame, generated: DataFrame) -> DataFrame:
    """One row: how many existing rules were read and skipped, generated and replaced, and the merged rules as a JSON array in their order.

    A rule without type or value is skipped. The document holds rules, so it is as large as a configuration, not as the samples.
    """
    whole = F.col("type").isNotNull() & F.col("value").isNotNull()
    merged = effects.merged(existing.filter(whole), generated)
    order = F.struct("appended", "ord", F.struct("type", "value", "priority", "mode", "points").alias("rule"))
    rules = merged.agg(F.to_json(F.transform(F.array_sort(F.collect_list(order)), lambda r: r["rule"])).alias("rules"), F.count(F.lit(1)).alias("merged"))
    counts = existing.agg(F.count_if(whole).alias("existing"), F.count_if(~whole).alias("skipped"))
    made = generated.agg(F.count(F.lit(1)).alias("generated"))
    d = rules.join(counts).join(made)  # three single rows
    return d.select("existing", "skipped", "generated", (F.col("existing") + F.col("generated") - F.col("merged")).alias("replaced"), "rules")
