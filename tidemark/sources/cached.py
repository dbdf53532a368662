"""Tables that a driver reads again only when they are old, or when their file has changed."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class TimedTable:
    """A table that is loaded once and served until it is `ttl` seconds old. Callers that come while it loads wait for that load.

    Where a later load finds nothing, the table from before is served on, and `stale` says so.
    """

    def __init__(self, load: Callable[[], DataFrame], ttl: float, clock: Callable[[], float] = time.time):
        self.load, self.ttl, self.clock = load, ttl, clock
        self.held: DataFrame | None = None
        self.expires_at, self.stale = float("-inf"), False
        self._lock = threading.Lock()

    def get(self, force: bool = False) -> DataFrame:
        with self._lock:
            if force or self.held is None or self.clock() >= self.expires_at:
                fresh = self.load().persist()
                self.stale = self.held is not None and fresh.isEmpty()
                if self.stale:
                    fresh.unpersist()
                else:
                    if self.held is not None:
                        self.held.unpersist()
                    self.held = fresh
                self.expires_at = self.clock() + self.ttl
            return self.held


class WatchedFile:
    """What `parse` makes of a file, made again when the file's time or size changes; the file is looked at through Spark, wherever it lies."""

    def __init__(self, spark: SparkSession, path: str, parse: Callable[[DataFrame], DataFrame]):
        self.spark, self.path, self.parse = spark, path, parse
        self.seen: tuple | None = None
        self.made: DataFrame | None = None

    def get(self) -> DataFrame:
        files = self.spark.read.format("binaryFile").load(self.path).select("path", "modificationTime", "length")
        seen = tuple(files.agg(F.max("modificationTime"), F.sum("length"), F.count(F.lit(1))).first())
        if seen != self.seen:
            self.made = self.parse(self.spark.read.text(self.path, wholetext=True).withColumnRenamed("value", "body"))
            self.seen = seen
        return self.made
