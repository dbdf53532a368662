"""Barriers over streams: a key is reported once, when all its parts have landed or its time is up."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.sources.scratch import path

REPORT = "parts bigint, landed bigint, results bigint, best bigint, best_score double, last_ms bigint, settled boolean, reported boolean"


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session beside spark's for streams with state, so that queries of spark keep their own settings."""
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        session.conf.set(name, spark.conf.get(name))
    return session


class Barrier(StatefulProcessor):
    """Counts what has landed of a key and keeps its best result; reports the key once, and tells of it unreported while parts are missing.

    A part that was skipped lands without a result. A timer of the stream's time reports what there is after wait_ms from the first part; what comes after the report is
    passed over, until the key's mark is dropped after as much again.
    """

    def __init__(self, wait_ms: int | None):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "parts bigint, landed bigint, results bigint, best bigint, best_score double, last_ms bigint, reported boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        parts, landed, results, best, score, last, reported = self.kept.get() if self.kept.exists() else (0, 0, 0, None, None, 0, False)
        if reported:
            for _ in rows:
                pass
            return
        first = landed == 0
        for d in rows:
            parts, landed, last = int(d["parts"].iloc[0]), landed + len(d), max(last, int(d["at_ms"].max()))
            good = d[~d["skipped"].astype(bool)]
            results += len(good)
            if len(good):
                top = good.sort_values(["score", "part"], ascending=[False, True]).iloc[0]
                own = (float(top["score"]), -int(top["part"]))
                if best is None or own > (score, -best):
                    score, best = own[0], -own[1]
        settled = landed >= parts
        self.kept.update((parts, landed, results, best, score, last, settled))
        if first and self.wait_ms is not None:
            self.handle.registerTimer(last + self.wait_ms)
        yield self._row(key, (parts, landed, results, best, score, last), settled, settled)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        if not self.kept.exists():
            return
        *state, reported = self.kept.get()
        if reported:
            self.kept.clear()
            return
        self.kept.update((*state, True))
        self.handle.registerTimer(int(expiredTimerInfo.getExpiryTimeInMs()) + self.wait_ms)
        yield self._row(key, tuple(state), False, True)

    def _row(self, key: tuple, state: tuple, settled: bool, reported: bool) -> pd.DataFrame:
        parts, landed, results, best, score, last = state
        row = {"key": key[0], "parts": parts, "landed": landed, "results": results, "best": pd.array([best], "Int64")[0], "best_score": score, "last_ms": last, "settled": settled, "reported": reported}
        return pd.DataFrame([row]).astype({"best": "Int64", "best_score": "float64"})

    def close(self) -> None:
        pass


def barrier(
    landed: DataFrame, expected: DataFrame, key: str, part: Column, score: Column, skipped: Column, at_ms: Column, wait_ms: int | None = None, folder: str | None = None
) -> DataFrame:
    """One row a key of `expected` (key, parts): parts, landed, results, best, best_score, last_ms, settled, flushed.

    `landed` is a stream of parts in any order, from a stateful_session(). A key with all its parts is settled. With wait_ms a key is reported without the rest once the stream's time,
    which is that of the latest part so far, has passed its first batch by so much, and parts after that are not counted. At the end of what the stream has, keys that
    were not reported are flushed with what has landed, as are keys of which nothing did. Parts without result count as landed, but give no best one.

    State is a row a key in the state store. Each batch writes what it reports under its number, so a batch that runs again replaces it; in the same folder a later run goes on
    with the state and the reports of the one before.
    """
    spark = landed.sparkSession
    at = folder or path(spark, "barrier")
    rows = landed.select(F.col(key).alias("key"), part.cast("bigint").alias("part"), score.cast("double").alias("score"), skipped.alias("skipped"), at_ms.cast("bigint").alias("at_ms"))
    rows = rows.join(expected.select(F.col(key).alias("key"), F.col("parts").cast("bigint").alias("parts")), "key")
    kind = rows.schema["key"].dataType.simpleString()
    mode = "none"
    if wait_ms is not None:
        rows, mode = rows.withColumn("at", F.timestamp_millis("at_ms")).withWatermark("at", "0 seconds"), "eventTime"
    states = rows.groupBy("key").transformWithStateInPandas(Barrier(wait_ms), f"key {kind}, {REPORT}", "update", mode)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/reports/batch={batch_id}")

    running = states.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).start()
    running.awaitTermination()
    fields = [f.split()[0] for f in REPORT.split(", ")]
    reported = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/reports")
    if reported.getFileSystem(spark._jsc.hadoopConfiguration()).exists(reported):
        reports = spark.read.option("basePath", f"{at}/reports").parquet(f"{at}/reports")
    else:  # nothing has landed yet
        reports = spark.createDataFrame([], f"key {kind}, {REPORT}, batch int")
    last = reports.groupBy("key").agg(F.max_by(F.struct(*fields), F.struct("reported", "batch")).alias("last")).select("key", "last.*")
    d = expected.select(F.col(key).alias("key"), F.col("parts").cast("bigint").alias("parts")).join(last.drop("parts"), "key", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("landed", "results")}
    d = d.withColumns(zero).withColumn("settled", F.coalesce("settled", F.lit(False)))
    return d.select(F.col("key").alias(key), "parts", "landed", "results", "best", "best_score", "last_ms", "settled", (~F.col("settled")).alias("flushed"))
