"""Parsing of what probes write, and streams in several batches."""

from pyspark.sql import functions as F

from tidemark.functions import probing
from tidemark.streaming.incremental import dead_streaks, folder_stream

REASONS = {
    "": "other", None: "other", "spawn failed: x": "probe_error", "empty url": "rejected", "empty url here": "other", "Protocol not found": "unsupported",
    "403 Forbidden (not found)": "auth", "HTTP 410": "not_found", "error 503": "server_error", "failed at 2024 something": "other", "ETIMEDOUT": "timeout",
    "No route to host": "unreachable", "End of file": "unsupported",
}


def test_reasons(spark):
    df = spark.createDataFrame([(k, v) for k, v in REASONS.items()], "e string, want string")
    assert df.filter(probing.dead_reason(F.col("e")) != F.col("want")).collect() == []


def test_payloads(spark):
    texts = ["not json", "{}", None, '{"streams":[{"codec_type":"audio","channels":2}]}', '{"streams":[{"codec_type":"video","r_frame_rate":"24/1"}],"format":{"bit_rate":"1234567"}}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    rows = [r.p for r in df.select("i", probing.parsed(F.col("t")).alias("p")).orderBy("i").collect()]
    assert [r.alive for r in rows] == [False] * 4 + [True]
    assert (rows[4].fps, rows[4].bitrate_kbps, rows[4].audio_channels) == (24.0, 1234.57, 0)
    assert df.select(probing.parsed(F.col("t"), True).alias("p")).filter("p.alive").count() == 2


def test_samples(spark):
    r = spark.createDataFrame([("",), (None,)], "s string").select(probing.sampled(F.col("s")).alias("p")).collect()
    assert (r[0].p.bitrate_kbps, r[0].p.black_seconds) == (0.0, 0.0)


def test_streaks_over_batches(spark, tmp_path):
    attempts = [[("a", 1, False), ("b", 1, True), ("a", 2, False)], [("b", 2, False), ("a", 3, False)], [("a", 5, False), ("a", 4, True), ("b", 3, False)]]
    for i, rows in enumerate(attempts):
        spark.createDataFrame(rows, "k string, t int, ok boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if i == 0:
            first = dead_streaks(folder_stream(spark, str(tmp_path / "in")), "k", F.col("ok"), ["t"])
            assert {r.k: r.dead_streak for r in first.collect()} == {"a": 2, "b": 0}
    out = dead_streaks(folder_stream(spark, str(tmp_path / "in"), files_a_batch=1), "k", F.col("ok"), ["t"])
    assert {r.k: r.dead_streak for r in out.collect()} == {"a": 1, "b": 2}
