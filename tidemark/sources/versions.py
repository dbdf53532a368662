"""Tables that are replaced and extended in versions: data first, a manifest last.

A version is a list of Parquet folders and a mark. Writers put data into a folder of its own and then publish the next manifest by one
rename, so readers see the version before or the version after, and a write that fails leaves nothing that they read. A reader that keeps a
version's number reads the same rows however often the table is replaced meanwhile, until that version is cleared away.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class VersionedTable:
    """A table under a folder that the driver and all executors share; one writer at a time."""

    def __init__(self, spark: SparkSession, at: str):
        self.spark, self.at = spark, at.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.at).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Numbers of the published versions that have not been cleared away, oldest first."""
        folder = self._path(f"{self.at}/manifests")
        if not self._files.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def manifest(self, version: int | None = None) -> dict:
        """parts: folders, oldest first; mark: what the writer noted, such as a pass or a batch. The newest version's unless one is given."""
        known = self.versions()
        if not known or version is not None and version not in known:
            return {"version": -1, "parts": [], "mark": None}
        version = known[-1] if version is None else version
        stream = self._files.open(self._path(self._name(version)))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")) | {"version": version}
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame | None:
        """All rows of a version; None where nothing was ever published."""
        parts = self.manifest(version)["parts"]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [self.spark.read.parquet(p) for p in parts]) if parts else None

    def replace(self, rows: DataFrame, mark: object = None) -> int:
        """The rows as the next version; without rows nothing changes."""
        part = self._written(rows)
        return self._publish([part], mark) if part else self.manifest()["version"]

    def empty(self, mark: object = None) -> int:
        """A version with the columns of the newest and no rows."""
        rows = self.read()
        if rows is None:
            return -1
        part = f"{self.at}/data/{uuid.uuid4().hex}"
        rows.limit(0).write.parquet(part)
        return self._publish([part], mark)

    def append(self, rows: DataFrame, mark: object = None) -> int:
        """The newest version's rows and these as the next version."""
        part = self._written(rows)
        before = self.manifest()
        return self._publish(before["parts"] + ([part] if part else []), mark)

    def compact(self, fold: Callable[[DataFrame], DataFrame]) -> int:
        """What `fold` makes of the newest version's rows as the next version, in one part; its mark stays."""
        before = self.manifest()
        part = self._written(fold(self.read()))
        return self._publish([part] if part else [], before["mark"])

    def clear(self, keep: int = 2) -> None:
        """Takes away all but the last `keep` versions, and the data that none of these name."""
        known = self.versions()
        named = {p for v in known[-keep:] for p in self.manifest(v)["parts"]}
        for v in known[:-keep]:
            self._files.delete(self._path(self._name(v)), False)
        folder = self._path(f"{self.at}/data")
        for s in self._files.listStatus(folder) if self._files.exists(folder) else []:
            if f"{self.at}/data/{s.getPath().getName()}" not in named:
                self._files.delete(s.getPath(), True)

    def _name(self, version: int) -> str:
        return f"{self.at}/manifests/{version:012d}.json"

    def _written(self, rows: DataFrame) -> str | None:
        part = f"{self.at}/data/{uuid.uuid4().hex}"
        rows.write.parquet(part)
        return part if self.spark.read.parquet(part).head(1) else None

    def _publish(self, parts: list[str], mark: object) -> int:
        version = self.manifest()["version"] + 1
        draft = self._path(f"{self.at}/manifests/.{uuid.uuid4().hex}")
        out = self._files.create(draft, True)
        out.write(bytearray(json.dumps({"parts": parts, "mark": mark}).encode()))
        out.close()
        if self._files.exists(self._path(self._name(version))) or not self._files.rename(draft, self._path(self._name(version))):
            raise RuntimeError(f"version {version} of {self.at} was published by another writer")
        return version


def newest(rows: DataFrame, key: str, written: str = "written") -> DataFrame:
    """Of each key the rows of its latest write; a write that only says that a key has none (`gone`) leaves none."""
    latest = F.max(written).over(Window.partitionBy(key))
    return rows.withColumn("latest", latest).filter((F.col(written) == F.col("latest")) & ~F.col("gone")).drop("latest", "gone", written)


def update_keys(table: VersionedTable, key: str, keys: DataFrame, rows: DataFrame, mark: object = None) -> int:
    """The rows of some keys written anew, as one part beside the others: what is written grows with these keys, not with the table; read by newest()."""
    written = F.lit(table.manifest()["version"] + 1).cast("bigint")
    stamp = lambda d, gone: d.withColumns({"written": written, "gone": F.lit(gone)})
    none = keys.select(key).distinct().join(rows.select(key).distinct(), key, "left_anti")
    return table.append(stamp(rows, False).unionByName(stamp(none, True), allowMissingColumns=True), mark)
