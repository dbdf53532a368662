"""Streams of attempts: hourly windows, dead streaks and verdicts, kept up batch by batch.

What is kept is a summary that can be merged in any order, in a versioned table. A micro-batch appends its summary and notes its number in the
same manifest, so a batch that runs again after a failure is passed over; after some batches the parts are merged into one. An answer
reads a bounded number of parts however many batches there were, and a stream that starts again in the same folder goes on from there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.scratch import path
from tidemark.sources.versions import VersionedTable

#: Parts of a summary that are merged into one, once there are so many.
MOST_PARTS = 8


def kept_up(stream: DataFrame, at: str, each: Callable[[DataFrame], DataFrame], fold: Callable[[DataFrame], DataFrame], most_parts: int = MOST_PARTS) -> DataFrame:
    """fold() over the summaries that `each` makes of all batches that the stream has now, and of those that earlier runs in the folder `at` kept."""
    table = VersionedTable(stream.sparkSession, f"{at}/kept")

    def part(batch: DataFrame, batch_id: int) -> None:
        mark = table.manifest()["mark"]
        if mark is not None and batch_id <= mark:
            return
        table.append(each(batch), batch_id)
        if len(table.manifest()["parts"]) >= most_parts:
            table.compact(fold)
            table.clear()

    query = stream.writeStream.foreachBatch(part).option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    kept = table.read()
    return fold(each(stream.sparkSession.createDataFrame([], stream.schema)) if kept is None else kept)


def folder_stream(spark: SparkSession, at: str, files_a_batch: int = 100) -> DataFrame:
    """A folder of Parquet as a stream of its files. Of a single file give a pattern (x.parque[t]): streams refuse its plain path."""
    return spark.readStream.schema(spark.read.parquet(at).schema).option("maxFilesPerTrigger", files_a_batch).parquet(at)


def hourly(stream: DataFrame, at: str, measure: Column, width: str = "1 hour", slide: str | None = None, folder: str | None = None) -> DataFrame:
    """Tumbling (or, with slide, sliding) windows: start, rows and the sum of a measure. Late rows count, however late."""
    window = F.window(at, width, slide) if slide else F.window(at, width)

    def each(batch: DataFrame) -> DataFrame:
        return batch.groupBy(window.alias("w")).agg(F.count(F.lit(1)).alias("rows"), F.sum(measure).alias("total")).select(F.col("w.start").alias("start"), "rows", "total")

    merged = lambda d: d.groupBy("start").agg(F.sum("rows").alias("rows"), F.sum("total").alias("total"))
    return kept_up(stream, folder or path(stream.sparkSession, "hourly"), each, merged)


def runs_of(attempts: DataFrame, closed: Column | None = None) -> DataFrame:
    """The summary of attempts (key, alive, at, n): of each key the last success and the failures after it, in order of `at`.

    Summaries merge by union and this function again, in any order and any grouping, as what a success hides stays hidden. Failures where `closed` holds, before which no
    attempt can arrive any more, become one row with their number; the others stay apart, since a success that arrives late may lie between them.
    """
    last = attempts.filter("alive").groupBy("key").agg(F.max("at").alias("last"))
    d = attempts.join(last, "key", "left").filter(F.col("last").isNull() | F.when(F.col("alive"), F.col("at") == F.col("last")).otherwise(F.col("at") > F.col("last")))
    apart = F.col("at") if closed is None else F.when(F.col("alive") | ~closed, F.col("at"))
    return d.groupBy("key", "alive", apart.alias("apart")).agg(F.max("at").alias("at"), F.sum("n").alias("n")).select("key", "alive", "at", F.when(F.col("alive"), 1).otherwise(F.col("n")).cast("bigint").alias("n"))


def verdicts_of(stream: DataFrame, key: Column, alive: Column, order: list[Column], lateness: int | None, folder: str | None) -> DataFrame:
    """key, alive, at, dead_streak: the last attempt of each key by `order`, and the failures in a row that it ends."""

    def each(batch: DataFrame) -> DataFrame:
        at = F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)])
        return runs_of(batch.select(key.alias("key"), alive.alias("alive"), at.alias("at"), F.lit(1).cast("bigint").alias("n")))

    def fold(kept: DataFrame) -> DataFrame:
        if lateness is None:
            return runs_of(kept)
        now = kept.agg(F.max("at.o0").alias("now")).scalar()
        return runs_of(kept, F.col("at.o0") < now - lateness)

    kept = kept_up(stream, folder or path(stream.sparkSession, "runs"), each, fold)
    last = F.max(F.struct("at", "alive")).alias("last")
    streak = F.coalesce(F.sum(F.when(~F.col("alive"), F.col("n"))), F.lit(0)).alias("dead_streak")
    return kept.groupBy("key").agg(last, streak).select("key", "last.alive", "last.at", "dead_streak")


def dead_streaks(stream: DataFrame, key: str, alive: Column, order: list[str], folder: str | None = None) -> DataFrame:
    """How many failures in a row each key ends on, in the attempts' own order, in whatever order and batches they arrive."""
    found = verdicts_of(stream, F.col(key), alive, [F.col(c) for c in order], None, folder)
    return found.select(F.col("key").alias(key), "dead_streak")


def verdict_cache(
    stream: DataFrame, key: Column, alive: Column, at_ms: Column, seq: Column, retention_ms: int | None = None, lateness_ms: int | None = None, folder: str | None = None
) -> DataFrame:
    """key, alive, at_ms, seq, dead_streak of each key after all that the stream has now.

    With retention_ms a key is forgotten whose last attempt lies further back than that from the latest of all. With lateness_ms failures that lie further back are
    kept as a number: no success may arrive later than that.
    """
    found = verdicts_of(stream, key, alive, [at_ms, seq], lateness_ms, folder).select("key", "alive", F.col("at.o0").alias("at_ms"), F.col("at.o1").alias("seq"), "dead_streak")
    if retention_ms is None:
        return found
    now = found.agg(F.max("at_ms").alias("now")).scalar()
    return found.filter(F.col("at_ms") >= now - retention_ms)
