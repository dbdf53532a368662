"""A paged listing as a data source of Spark: each page is a partition, planned from the count that the first page states."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


class Page(InputPartition):
    def __init__(self, number: int):
        super().__init__(number)


class PagedReader(DataSourceReader):
    """Pages from 1 on: a bare list is the only page; with a count pages are planned from it, without one `next` is followed page by page."""

    def __init__(self, schema: StructType, options: dict[str, str]):
        self.fields = schema.fieldNames()
        self.at, self.size = options["path"].rstrip("/"), int(options.get("page_size", "500"))

    def _page(self, number: int) -> object:
        store, root = fs.FileSystem.from_uri(self.at) if "://" in self.at or self.at.startswith("file:") else (fs.LocalFileSystem(), self.at)
        files = [f.path for f in store.get_file_info(fs.FileSelector(f"{root}/page={number}")) if f.is_file and not f.base_name.startswith(("_", "."))]
        with store.open_input_stream(sorted(files)[0]) as stream:
            return json.loads(stream.read())

    def partitions(self) -> list[Page]:
        first = self._page(1)
        if isinstance(first, list) or not first.get("next"):
            return [Page(1)]
        if isinstance(first.get("count"), int):
            return [Page(n) for n in range(1, -(-first["count"] // self.size) + 1)]
        out = [Page(1), Page(2)]
        while isinstance(body := self._page(out[-1].value), dict) and body.get("next"):
            out.append(Page(out[-1].value + 1))
        return out

    def read(self, partition: Page) -> Iterator[tuple]:
        body = self._page(partition.value)
        for ord_, row in enumerate(body if isinstance(body, list) else body.get("results") or []):
            own = {"page": partition.value, "ord": ord_, "body": json.dumps(row) if "body" in self.fields else None}
            yield tuple(own[f] if f in own else (row.get(f) if isinstance(row, dict) else None) for f in self.fields)


class Paged(DataSource):
    """spark.read.format("paged").schema(...).load(folder of page=N/<one JSON file>); option page_size (500).

    Columns page and ord say where a row stood and body holds it as JSON; any other column of the given schema is a field of the rows, so that only
    what is asked for leaves the reader. Rows come in page order within and across partitions.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "page int, ord int, body string"

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(schema, self.options)
