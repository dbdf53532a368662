"""The verdict of a probe: what its payload declares, merged with what a sample measured."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import probing


def errors() -> Column:
    """Why a probe gave no verdict, empty where it did: a refused URL, no answer in time, a program that did not start, one that failed (the last line that it wrote, or its code), or output
    that is not JSON. Texts are cut at 200 characters.

    Columns: refusal, timed_out, spawn_error, exit_code, written (standard error), payload.
    """
    lines = F.filter(F.split(F.trim(F.regexp_replace(F.coalesce("written", F.lit("")), r"\r", "")), "\n"), lambda x: x != "")
    detail = F.when(F.size(lines) > 0, F.element_at(lines, -1)).otherwise(F.concat(F.lit("exit "), F.col("exit_code").cast("string")))
    unread = F.get_json_object("payload", "$").isNull()
    error = F.when(F.coalesce("refusal", F.lit("")) != "", F.col("refusal")).when(F.col("timed_out"), "timeout")
    error = error.when(F.col("spawn_error").isNotNull(), F.concat(F.lit("spawn failed: "), "spawn_error")).when(F.col("exit_code") != 0, detail)
    return F.substring(error.when(unread, "unparseable: not JSON").otherwise(""), 1, 200)


def outcomes(probes: DataFrame) -> DataFrame:
    """Probes (those columns, and `s`, truncated, remaining_ms as merged() takes them) with error and the merged verdict; a failed one is dead and nothing of it is measured."""
    d = probes.withColumn("error", errors())
    d = d.withColumn("p", probing.parsed(F.when(F.col("error") == "", F.col("payload"))))
    return merged(d)


def merged(probes: DataFrame, measure: bool = True, black_check: bool = True, seconds: float = 5, black_ratio: float = 0.9) -> DataFrame:
    """Probes with bitrate_kbps, bitrate_measured, black, black_seconds.

    probes: `p` (a parsed payload), `s` (a sample: bitrate_kbps, black_seconds; null where it failed), truncated, remaining_ms. A sample's bitrate
    counts if it is over 0. Seconds of black are judged only where there is video; a sample that was cut short can say that a stream is black, not that it
    isn't. Without time left, or a sample, the payload stays and its bitrate is unmeasured. Nothing is sampled of a dead stream.
    """
    video = (F.col("p.width") > 0) | (F.col("p.height") > 0) | (F.col("p.video_codec") != "")
    detects = F.lit(black_check) & video
    asked = F.col("p.alive") & (F.lit(measure) | detects)
    sampled = asked & (F.col("remaining_ms") > 0) & F.col("s").isNotNull()
    found = sampled & F.lit(measure) & (F.col("s.bitrate_kbps") > 0)
    enough = F.col("s.black_seconds") >= seconds * black_ratio
    cents: Column = F.floor(F.col("s.black_seconds") * 100 + 0.5) / 100
    return probes.withColumns(
        {
            "alive": F.col("p.alive"),
            "bitrate_kbps": F.when(found, F.col("s.bitrate_kbps")).otherwise(F.col("p.bitrate_kbps")),
            "bitrate_measured": F.when(asked, F.coalesce(found, F.lit(False))),
            "black": F.when(sampled & detects & (enough | ~F.col("truncated")), enough),
            "black_seconds": F.when(sampled & detects, cents),
        }
    )
