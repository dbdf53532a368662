"""What a probe wrote, read into columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

PAYLOAD = """streams ARRAY<STRUCT<codec_type STRING, codec_name STRING, width BIGINT, height BIGINT, avg_frame_rate STRING, r_frame_rate STRING, bit_rate STRING,
 pix_fmt STRING, channels BIGINT, channel_layout STRING, sample_rate STRING>>, format STRUCT<bit_rate STRING>"""

# Why a stream is dead, by what its error says in lower case; the first that holds.
REASONS = [
    ("probe_error", "^(spawn failed|unparseable)"),
    ("rejected", "^(empty url$|refusing a url)"),
    ("unsupported", "protocol not found|could not find codec"),
    ("auth", r"\b(401|403)\b|unauthorized|forbidden"),
    ("not_found", r"\b(404|410)\b|not found"),
    ("server_error", r"\b5[0-9][0-9]\b|bad gateway|service unavailable|server error"),
    ("timeout", "timed? ?out|etimedout"),
    ("unreachable", "connection refused|econnrefused|connection reset|network is unreachable|no route to host|name or service not known|failed to resolve|temporary failure in name resolution"),
    ("unsupported", "invalid data found|unknown format|does not contain any stream|end of file|immediate exit"),
]
# End of fixed values.


def dead_reason(error: Column) -> Column:
    text = F.lower(F.coalesce(error, F.lit("")))
    return reduce(lambda out, r: out.when(text.rlike(r[1]), r[0]), REASONS, F.when(text == "", "other")).otherwise("other")


def cents(x: Column) -> Column:
    """Rounded half up to two places."""
    return F.floor(x * 100 + 0.5) / 100


def frames(rate: Column) -> Column:
    """Frames a second from a number or a fraction; 0 where there is none."""
    part = lambda k: F.trim(F.get(F.split(rate, "/"), F.lit(k))).try_cast("double")
    value = F.when(F.contains(rate, F.lit("/")), F.when(part(1) != 0, part(0) / part(1))).otherwise(part(0))
    return F.coalesce(cents(value), F.lit(0.0))


def parsed(payload: Column, audio_only: bool = False) -> Column:
    """A struct of a probe's JSON: the first video, the audio with the most channels (the first of equals), the first readable bitrate.

    What cannot be read, or has no stream of the wanted kind, is not alive.
    """
    p = F.from_json(payload, PAYLOAD)
    streams = F.coalesce(p["streams"], F.array())
    video = F.get(F.filter(streams, lambda s: s["codec_type"] == "video"), F.lit(0))
    audios = F.filter(streams, lambda s: s["codec_type"] == "audio")
    most = F.array_max(F.transform(audios, lambda s: F.coalesce(s["channels"], F.lit(0))))
    audio = F.get(F.filter(audios, lambda s: F.coalesce(s["channels"], F.lit(0)) == most), F.lit(0))
    alive = (video.isNotNull() | audio.isNotNull()) & (video.isNotNull() | F.lit(audio_only))
    bits = F.coalesce(*[c.try_cast("double") for c in (video["bit_rate"], audio["bit_rate"], p["format"]["bit_rate"])], F.lit(0.0))
    fields = {
        "alive": alive,
        "width": F.coalesce(video["width"], F.lit(0)),
        "height": F.coalesce(video["height"], F.lit(0)),
        "fps": frames(F.coalesce(video["avg_frame_rate"], video["r_frame_rate"])),
        "bitrate_kbps": cents(bits / 1000),
        "video_codec": F.coalesce(video["codec_name"], F.lit("")),
        "audio_codec": F.coalesce(audio["codec_name"], F.lit("")),
        "audio_channels": F.coalesce(audio["channels"], F.lit(0)),
        "audio_bitrate_kbps": cents(F.coalesce(audio["bit_rate"].try_cast("double"), F.lit(0.0)) / 1000),
        "audio_sample_rate": F.coalesce(audio["sample_rate"].try_cast("bigint"), F.lit(0)),
        "pixel_format": F.coalesce(video["pix_fmt"], F.lit("")),
        "channel_layout": F.coalesce(audio["channel_layout"], F.lit("")),
    }
    zero = {"alive": F.lit(False)} | {c: F.lit("") for c in ("video_codec", "audio_codec", "pixel_format", "channel_layout")}
    return F.struct(*[F.when(F.coalesce(alive, F.lit(False)), c).otherwise(zero.get(n, F.lit(0))).alias(n) for n, c in fields.items()])


def sampled(stderr: Column) -> Column:
    """The last bitrate that a sample reported, and how many seconds were black."""
    rates = F.regexp_extract_all(stderr, F.lit(r"bitrate=\s*([0-9.]+)\s*kbits/s"))
    black = lambda k: F.transform(F.regexp_extract_all(stderr, F.lit(r"black_start:([0-9.]+)\s+black_end:([0-9.]+)"), F.lit(k)), lambda s: s.try_cast("double"))
    seconds = F.aggregate(F.zip_with(black(1), black(2), lambda a, b: b - a), F.lit(0.0), lambda a, b: a + F.coalesce(b, F.lit(0.0)))
    rate = F.coalesce(F.get(rates, F.size(rates) - 1).try_cast("double"), F.lit(0.0))
    return F.struct(rate.alias("bitrate_kbps"), (F.floor(seconds * 1000 + 0.5) / 1000).alias("black_seconds"))


def playback_url(stored: Column, rewritten: Column) -> Column:
    """base/live/user/pass/file from the rewritten URL's base and credentials and the stored file; the stored URL where a part is missing."""
    parts = F.split(rewritten, "/")
    tail = F.regexp_extract(stored, "([^/]+)$", 1)
    at = lambda k: F.get(parts, F.size(parts) - k)
    base = F.regexp_extract(rewritten, "^([a-z]+://[^/]+)", 1)
    made = F.concat_ws("/", base, F.lit("live"), at(3), at(2), tail)
    return F.when((base != "") & (F.size(parts) >= 6) & (tail != ""), made).otherwise(stored)
