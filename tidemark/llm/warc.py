"""WARC archives: one gzip member a record, and a reader that inflates them one after the other and verifies digests."""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut
from tidemark.llm.exact_dedup import exact_dedup, row_name

#: An archive is closed and the next one begun after so many bytes of payload.
ARCHIVE_BYTES = 64 << 20


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(url: str, page_id: str, payload: bytes, refers_to: str | None) -> bytes:
    """One record as a gzip member; a revisit holds the HTTP header only, which still tells the payload's length."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>",
        "WARC-Target-URI": url,
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Page-ID": page_id,
        "WARC-Payload-Digest": f"sha1:{digest(payload)}",
        "WARC-Block-Digest": f"sha1:{digest(block)}",
    }
    if refers_to is not None:
        fields["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        fields["WARC-Refers-To"] = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>"
        fields["WARC-Refers-To-Page-ID"] = refers_to
    fields |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in fields.items())
    return gzip.compress(f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n", 6, mtime=0)


def members(stream: BinaryIO, chunk: int = 1 << 16) -> Iterator[bytes]:
    """Each gzip member of a stream, inflated bit by bit; the stream is read once, front to back."""
    data = stream.read(chunk)
    while data:
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            if not data:
                raise ValueError("the archive ends within a record")
            parts.append(inflate.decompress(data))
            data = inflate.unused_data if inflate.eof else stream.read(chunk)
        yield b"".join(parts)
        data = data or stream.read(chunk)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(fields, block) of a record; its framing and block digest are verified."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    size = int(fields["Content-Length"])
    block = rest[:size]
    if not version.startswith("WARC/") or len(block) != size or rest[size:] != b"\r\n\r\n":
        raise ValueError("a record is framed wrongly")
    if fields["WARC-Block-Digest"] != f"sha1:{digest(block)}":
        raise ValueError(f"a block does not match its digest: {fields['WARC-Record-ID']}")
    return fields, block


def read_records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], int, bytes | None]]:
    """(fields, bytes of the full payload, payload or None for a revisit) of each record."""
    for raw in members(stream):
        fields, block = parse(raw)
        head, _, payload = block.partition(b"\r\n\r\n")
        size = int(next(x for x in head.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
        if fields["WARC-Type"] == "revisit":
            yield fields, size, None
        elif len(payload) == size and fields["WARC-Payload-Digest"] == f"sha1:{digest(payload)}":
            yield fields, size, payload
        else:
            raise ValueError(f"a payload does not match its digest: {fields['WARC-Record-ID']}")


def write_warc(
    pages: DataFrame, folder: str, keep: str = "max", least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", body_col: str = "html"
) -> DataFrame:
    """Writes archives into a shared folder and returns their paths and record counts.

    Of records with equal payloads of at least least_bytes, the one with the largest id (``keep``) is a response; the
    others are revisits that refer to it. Which is which is the exact de-duplication of the payloads; the bodies move once, to their decision.
    A task writes under a temporary name and renames, and names come from the task's partition, so a task
    that runs again replaces its own file.

    Defined results: a null body is an empty payload, a null url an empty one. Records that repeat both id and payload are all responses if that id
    is the one kept; ids are of any type with an order. A null id is written without a value and never kept over another, and a
    payload of null ids only is a response each time. An empty table gives no archive. Other columns aren't read.
    """
    rows = pages.select(F.col(id_col).cast("string").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(body_col), F.lit("")).alias("body"), F.col(id_col).alias("key"))
    long_enough = rows.filter(F.octet_length("body") >= least_bytes)
    decided = exact_dedup(long_enough, "key", "body", keep).filter(~F.col("key").eqNullSafe(F.col("keep_id")))
    revisits = decided.select(row_name(F.col("key"), F.col("text_sha256")).alias("at"), F.coalesce(F.col("keep_id").cast("string"), F.lit("")).alias("refers_to")).distinct()
    placed = rows.withColumn("at", row_name(F.col("key"), F.sha2("body", 256)))
    decided = placed.join(revisits, "at", "left").select("id", "url", "body", "refers_to")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        context = TaskContext.get()
        part, attempt, number, out = context.partitionId(), context.taskAttemptId(), 0, None

        def close() -> pa.RecordBatch:
            out.close()
            path = f"{root}/part-{part:06d}-{number:04d}.warc.gz"
            store.move(f"{root}/.{part}-{number}-{attempt}", path)
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([records], pa.int64())], ["path", "records"])

        for batch in batches:
            for page, url, body, refers in zip(*(c for c in batch.columns), strict=True):
                if out is None:
                    out, records, size = store.open_output_stream(f"{root}/.{part}-{number}-{attempt}"), 0, 0
                payload = body.as_py().encode()
                out.write(record(url.as_py() or "", page.as_py() if page.is_valid else "", payload, refers.as_py()))
                records, size = records + 1, size + len(payload)
                if size >= ARCHIVE_BYTES:
                    yield close()
                    out, number = None, number + 1
        if out is not None:
            yield close()

    return cut(decided.mapInArrow(write, "path string, records bigint"))


def read_warc(archives: DataFrame, folder: str, bodies: bool = False) -> DataFrame:
    """page_id (text), payload_bytes, payload_digest, record_type, refers_to (text), url and, if asked for, payload of every record.

    Each archive is a task, so that reading widens with the archives. It is read once, in order, in chunks; framing, block digests and
    payload digests are verified, and a mismatch is an error. An empty list of archives gives an empty result.
    """

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with store.open_input_stream(path, compression=None) as stream:
                    held: list[tuple] = []
                    for fields, size, payload in read_records(stream):
                        own = fields["WARC-Page-ID"] or None, size, fields["WARC-Payload-Digest"][5:], fields["WARC-Type"], fields.get("WARC-Refers-To-Page-ID"), fields["WARC-Target-URI"], payload if bodies else None
                        held.append(own)
                        if len(held) == (64 if bodies else 4096):
                            yield rows(held)
                            held = []
                    if held:
                        yield rows(held)

    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary()]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]

    def rows(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held, strict=True), kinds, strict=True)], names)

    schema = "page_id string, payload_bytes bigint, payload_digest string, record_type string, refers_to string, url string, payload binary"
    return archives.select("path").repartition(max(1, archives.count())).mapInArrow(read, schema)
