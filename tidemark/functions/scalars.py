"""Column functions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    """Rounding half towards plus infinity."""
    return F.floor(x + F.lit(0.5)).cast("bigint")


def dead_ttl(streak: Column, dead: int, most: int) -> Column:
    """Back-off of a dead verdict: doubled for each further failure, between dead and most."""
    power = F.pow(F.lit(2.0), F.least(F.greatest(streak - 1, F.lit(0)), F.lit(30))).cast("bigint")
    return F.least(power * F.lit(dead).cast("bigint"), F.lit(max(dead, most)).cast("bigint"))


def verdict_ttl(alive: Column, bitrate: Column, streak: Column, live: int, dead: int, most: int, unknown: int) -> Column:
    out = F.when(~alive, dead_ttl(streak, dead, most))
    if unknown > 0:
        out = out.when(F.coalesce(bitrate, F.lit(0)) <= 0, F.lit(min(live, unknown)).cast("bigint"))
    return out.otherwise(F.lit(live).cast("bigint"))


def video_usable(alive: Column, black: Column, bitrate: Column, floor_kbps: int) -> Column:
    known = (bitrate > 0) & F.lit(floor_kbps > 0)
    return alive & ~black & (~known | (bitrate >= floor_kbps))


def _share(x: Column, most: float) -> Column:
    return F.least(x / F.lit(float(most)), F.lit(1.0))


def _known(*columns: Column | int) -> Column:
    """The first that is neither null nor zero."""
    return F.coalesce(*[F.nullif(c, F.lit(0)) if isinstance(c, Column) else F.lit(c) for c in columns])


def audio_term(channels: Column, bitrate: Column) -> Column:
    """How good the sound of a video is: channels first, then its bitrate; 0 without channels."""
    n, rate = F.coalesce(channels, F.lit(0)), F.coalesce(bitrate, F.lit(0))
    return F.when(n > 0, _share(n, 6) * 0.75 + _share(rate, 256) * 0.25).otherwise(F.lit(0.0))


def audio_score(channels: Column, audio_bitrate: Column, bitrate: Column, sample_rate: Column, codec: Column) -> Column:
    """Score of a stream that is sound alone, with defaults for what is not known, to four places half up."""
    name = F.lower(F.coalesce(codec, F.lit("")))
    worth = F.when(name.isin("flac", "alac"), 1.0).when(name.isin("eac3", "ac3", "aac"), 0.8).when(name == "mp3", 0.6).otherwise(0.5)
    total = _share(_known(channels, 2), 6) * 0.4 + _share(_known(audio_bitrate, bitrate, 128), 256) * 0.4 + _share(_known(sample_rate, 44100), 48000) * 0.1 + worth * 0.1
    return F.floor(total * 10000 + 0.5) / 10000
