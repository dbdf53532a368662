"""Streams of several batches, in any order and again after a stop, against the answer over all rows."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.sources.scratch import path
from tidemark.sources.versions import VersionedTable, newest, update_keys
from tidemark.streaming import incremental
from tidemark.streaming.barriers import barrier, stateful_session
from tidemark.streaming.incremental import dead_streaks, folder_stream, hourly, kept_up, verdict_cache

ATTEMPT = "key bigint, alive boolean, at_ms bigint, seq bigint"


def write(spark, at, *parts, schema=ATTEMPT):
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(at)


@pytest.fixture(scope="module")
def attempts(spark):
    """Many small files of attempts, dealt without regard to their time."""
    at = path(spark, "attempts")
    rng = random.Random(1)
    rows = [(k % 7, k % 7 != 5 and (k % 3 == 0 or k % 7 == 2), 1000 * (k // 2), k) for k in range(200)]
    mixed = rng.sample(rows, len(rows))
    write(spark, at, *[mixed[k : k + 17] for k in range(0, 200, 17)])
    return at, rows


def last_streaks(rows):
    out = {}
    for key in {r[0] for r in rows}:
        own = sorted((at, seq, alive) for k, alive, at, seq in rows if k == key)
        streak = 0
        for _, _, alive in own:
            streak = 0 if alive else streak + 1
        out[key] = (own[-1][2], own[-1][0], own[-1][1], streak)
    return out


def cached(spark, at, files=1, **more):
    d = verdict_cache(folder_stream(spark, at, files_a_batch=files), F.col("key"), F.col("alive"), F.col("at_ms"), F.col("seq"), **more)
    return {r.key: (r.alive, r.at_ms, r.seq, r.dead_streak) for r in d.collect()}


@pytest.mark.parametrize("files", [1, 5, 100])
def test_verdicts_and_streaks_follow_the_order_of_events(spark, attempts, files):
    at, rows = attempts
    assert cached(spark, at, files) == last_streaks(rows)
    d = dead_streaks(folder_stream(spark, at, files_a_batch=files), "key", F.col("alive"), ["at_ms", "seq"])
    assert {r.key: r.dead_streak for r in d.collect()} == {k: v[3] for k, v in last_streaks(rows).items()}


def test_a_success_that_arrives_late_counts_where_it_belongs(spark):
    at = path(spark, "late")
    write(spark, at, [(1, True, 10, 1), (2, False, 3, 1), (2, False, 8, 2)], [(1, False, 5, 0), (2, True, 5, 3)])
    assert cached(spark, at) == {1: (True, 10, 1, 0), 2: (False, 8, 2, 1)}


def test_failures_beyond_the_lateness_become_a_number(spark, monkeypatch):
    at, folder = path(spark, "failing"), path(spark, "state")
    monkeypatch.setattr(incremental, "MOST_PARTS", 2)
    rows = [(1, False, 10 * k, k) for k in range(60)] + [(2, k == 30, 10 * k, k) for k in range(60)]
    write(spark, at, *[[r for r in rows if r[3] // 10 == k] for k in range(6)])
    folded = []
    fold, real = None, incremental.runs_of
    monkeypatch.setattr(incremental, "runs_of", lambda d, closed=None: folded.append(closed is not None) or real(d, closed))
    assert cached(spark, at, lateness_ms=100, folder=folder) == last_streaks(rows) and fold is None and any(folded)


def test_a_stream_goes_on_where_it_stopped(spark, monkeypatch):
    at, folder = path(spark, "more"), path(spark, "state")
    rows = [(k % 5, k % 4 == 0, 100 * k, k) for k in range(120)]
    mixed = random.Random(3).sample(rows, 120)
    for k in range(0, 120, 40):
        write(spark, at, *[mixed[j : j + 5] for j in range(k, k + 40, 5)])
        assert cached(spark, at, folder=folder) == last_streaks(mixed[: k + 40])
    table = VersionedTable(spark, f"{folder}/kept")
    assert len(table.manifest()["parts"]) < incremental.MOST_PARTS and len(table.versions()) <= 2 * incremental.MOST_PARTS


def test_a_batch_that_runs_again_counts_once(spark, attempts):
    at, rows = attempts
    folder = path(spark, "again")
    each = lambda d: d.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    fold = lambda d: d.groupBy("key").agg(F.sum("n").alias("n"))
    first = kept_up(folder_stream(spark, at, 1), folder, each, fold).agg(F.sum("n")).first()[0]
    table = VersionedTable(spark, f"{folder}/kept")
    # the stream's own progress is lost, as after a failure between the manifest and the commit: all batches run again
    table._files.delete(table._path(f"{folder}/progress"), True)
    again = kept_up(folder_stream(spark, at, 1), folder, each, fold).agg(F.sum("n")).first()[0]
    assert first == again == len(rows)


def test_silent_keys_are_forgotten(spark):
    at = path(spark, "silent")
    write(spark, at, [(1, True, 1_000, 1), (2, False, 2_000, 2)], [(2, False, 70_000, 3)], [(3, True, 71_000, 4)])
    assert {(k, v[3]) for k, v in cached(spark, at, retention_ms=60_000).items()} == {(2, 2), (3, 0)}


def test_hourly_windows_are_merged_batch_by_batch(spark, attempts):
    at, rows = attempts
    stream = folder_stream(spark, at, files_a_batch=1).withColumn("ts", F.timestamp_millis(F.col("at_ms") * 60))
    found = {r.start.timestamp(): (r.rows, r.total) for r in hourly(stream, "ts", F.lit(1)).collect()}
    want = {}
    for _, _, ms, _ in rows:
        start = ms * 60 // 3_600_000 * 3600
        want[start] = want.get(start, 0) + 1
    assert found == {k: (v, v) for k, v in want.items()}


PART = "key bigint, part bigint, score double, skipped boolean, at_ms bigint"


def reported(spark, at, expected, files=1, **more):
    session = stateful_session(spark)
    parts = session.createDataFrame(expected, "key bigint, parts bigint")
    d = barrier(folder_stream(session, at, files), parts, "key", F.col("part"), F.col("score"), F.col("skipped"), F.col("at_ms"), **more)
    return {r.key: (r.landed, r.results, r.best, r.settled, r.flushed) for r in d.collect()}


def test_a_key_settles_when_its_last_part_lands(spark):
    at, folder = path(spark, "parts"), path(spark, "state")
    write(spark, at, [(1, 1, 0.5, False, 10), (2, 1, 0.1, False, 11)], [(1, 2, 0.9, True, 12), (3, 1, 0.2, True, 13)], [(2, 2, 0.1, False, 9), (1, 3, 0.5, False, 14)], schema=PART)
    expected = [(1, 3), (2, 3), (3, 1), (4, 2)]
    want = {1: (3, 2, 1, True, False), 2: (2, 2, 1, False, True), 3: (1, 0, None, True, False), 4: (0, 0, None, False, True)}
    assert reported(spark, at, expected) == reported(spark, at, expected, files=10) == reported(spark, at, expected, folder=folder) == want
    assert reported(spark, at, expected, folder=folder) == want  # nothing new
    # after a stop the missing part of 2 lands, and one of 1 that nobody awaits
    write(spark, at, [(2, 3, 0.7, False, 20), (1, 4, 1.0, False, 21)], schema=PART)
    assert reported(spark, at, expected, folder=folder) == want | {2: (3, 3, 3, True, False)}


def test_a_key_whose_time_is_up_is_flushed_once(spark):
    at = path(spark, "parts")
    parts = [[(1, 1, 0.5, False, 1_000)], [(2, 1, 0.5, False, 50_000)], [(2, 2, 0.4, False, 51_000)], [(1, 2, 0.9, False, 52_000)]]
    write(spark, at, *parts, schema=PART)
    expected = [(1, 2), (2, 2)]
    assert reported(spark, at, expected) == {1: (2, 2, 2, True, False), 2: (2, 2, 1, True, False)}
    assert reported(spark, at, expected, wait_ms=10_000) == {1: (1, 1, 1, False, True), 2: (2, 2, 1, True, False)}


def test_readers_see_whole_versions(spark):
    table = VersionedTable(spark, path(spark, "versions"))
    rows = lambda *ids: spark.createDataFrame([(i, i * 10) for i in ids], "id bigint, v bigint")
    ids = lambda d: sorted(r.id for r in d.collect())
    assert table.read() is None and table.manifest()["version"] == -1
    assert table.replace(rows().limit(0)) == -1 and table.replace(rows(1, 2), "a") == 0
    old = table.read()
    broken = rows(7, 8).withColumn("v", F.raise_error(F.lit("probe failed")).cast("bigint"))
    with pytest.raises(Exception, match="probe failed"):
        table.replace(broken)
    assert ids(table.read()) == [1, 2] and table.manifest()["mark"] == "a"
    table.replace(rows(3, 4, 5), "b")
    assert ids(old) == [1, 2] and ids(table.read(0)) == [1, 2] and ids(table.read()) == [3, 4, 5]
    assert table.append(rows(6)) == 2 and ids(table.read()) == [3, 4, 5, 6]
    assert table.compact(lambda d: d.filter("id > 4")) == 3 and ids(table.read()) == [5, 6] and len(table.manifest()["parts"]) == 1
    table.clear(keep=1)
    assert table.versions() == [3] and ids(table.read()) == [5, 6]
    with pytest.raises(RuntimeError, match="another writer"):
        table.manifest = lambda version=None: {"version": 2, "parts": [], "mark": None}
        table.replace(rows(9))


def test_keys_written_anew_hide_their_older_rows(spark):
    table = VersionedTable(spark, path(spark, "versions"))
    schema = "channel_id bigint, slot int, written bigint, gone boolean"
    table.replace(spark.createDataFrame([(1, 1, 0, False), (1, 2, 0, False), (2, 1, 0, False), (3, 1, 0, False)], schema))
    keys = spark.createDataFrame([(1,), (3,)], "channel_id bigint")
    update_keys(table, "channel_id", keys, spark.createDataFrame([(1, 9)], "channel_id bigint, slot int"))
    assert sorted(map(tuple, newest(table.read(), "channel_id").collect())) == [(1, 9), (2, 1)]
    update_keys(table, "channel_id", keys, spark.createDataFrame([(3, 5)], "channel_id bigint, slot int"))
    assert sorted(map(tuple, newest(table.read(), "channel_id").collect())) == [(2, 1), (3, 5)]
