"""Packed captured responses as a Spark data source: many responses in one file, read by byte ranges with pushed filters.

A pack begins with its own 16-byte marker and holds records one after the other: the marker, the length of the head, the
head (JSON: url, status, headers, sha256 of the body, lengths) and the body, compressed. Any stretch of bytes can be read
by itself: it owns the records whose marker starts in it, and finds the first by searching for the marker. Filters on
``url`` and ``status`` are answered from the heads, so the bodies of other records are skipped, neither decompressed nor
handed on. Bodies that no longer match their digest, or do not decompress, come back as null with ``intact`` false.

    packs.register(spark)
    responses.write.format("response_pack").mode("append").save(folder)
    spark.read.format("response_pack").load(folder).where("status = 200 and url like 'https:%'")

A write leaves its files under hidden names until all tasks are done; a task that runs twice leaves one file. Folders are
local paths or URIs that pyarrow's file systems open, on the driver and on every executor. An empty or missing folder has
no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith, WriterCommitMessage

SCHEMA = "url string, status int, headers map<string,string>, body binary, sha256 string, intact boolean"
MAGIC, MARKER = b"TWPACK1\n", 16
#: Bytes of a file that one task reads, of a batch of rows, and of what is read ahead at once.
SPLIT_BYTES, BATCH_BYTES, AHEAD = 64 << 20, 8 << 20, 1 << 20
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)


@dataclass
class Stretch(InputPartition):
    path: str
    start: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    hidden: str | None
    name: str | None


COMPARISONS: dict[type, Callable] = {
    EqualTo: lambda v, w: v == w, In: lambda v, w: v in w, GreaterThan: lambda v, w: v > w, GreaterThanOrEqual: lambda v, w: v >= w,
    LessThan: lambda v, w: v < w, LessThanOrEqual: lambda v, w: v <= w, StringStartsWith: lambda v, w: v.startswith(w), IsNotNull: lambda v, w: True,
}


class PackReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.split = options["path"], int(options.get("splitbytes", SPLIT_BYTES))
        self.tests: list[tuple[type, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take what the heads can answer; what is yielded is left to Spark."""
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else None
            if type(f) in COMPARISONS and name in ("url", "status"):
                self.tests.append((type(f), name, getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[Stretch]:
        system, path = opened(self.path)
        found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
        files = [f for f in found if f.type == fs.FileType.File and f.base_name.endswith(".pack") and not f.base_name.startswith((".", "_"))]
        return [Stretch(f.path, at, min(at + self.split, f.size)) for f in files for at in range(0, f.size, self.split)] or [Stretch("", 0, 0)]

    def fits(self, head: dict) -> bool:
        """Null meets no filter."""
        return all(head[name] is not None and COMPARISONS[kind](head[name], value) for kind, name, value in self.tests)

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        system, _ = opened(self.path)
        with system.open_input_file(partition.path) as f:
            marker = f.read(len(MAGIC) + MARKER)[len(MAGIC) :]
            at = first_marker(f, marker, max(partition.start, len(MAGIC) + MARKER), partition.end)
            rows, held = [], 0
            while at is not None and at < partition.end:
                f.seek(at)
                lead = f.read(MARKER + 4)
                if len(lead) < MARKER + 4 or lead[:MARKER] != marker:  # a torn record: go on at the next one
                    at = first_marker(f, marker, at + 1, partition.end)
                    continue
                head_bytes = f.read(int.from_bytes(lead[MARKER:], "big"))
                after = at + MARKER + 4 + len(head_bytes)
                try:
                    head = json.loads(head_bytes)
                    after += head["stored"]
                except (ValueError, KeyError, TypeError):
                    at = first_marker(f, marker, at + 1, partition.end)
                    continue
                if self.fits(head):
                    body = unpacked(f.read(head["stored"]), head)
                    rows.append((head["url"], head["status"], list((head["headers"] or {}).items()) if head["headers"] is not None else None, body, head["sha256"], body is not None or head["sha256"] is None))
                    held += len(body or b"") + len(head_bytes)
                at = after
                if held >= BATCH_BYTES:
                    yield batch_of(rows)
                    rows, held = [], 0
            if rows:
                yield batch_of(rows)


def first_marker(f: pa.NativeFile, marker: bytes, start: int, end: int) -> int | None:
    """Where the marker first stands from ``start``, if it begins before ``end``."""
    at = start
    while at < end:
        f.seek(at)
        piece = f.read(AHEAD + MARKER)
        if (k := piece.find(marker)) >= 0:
            return at + k if at + k < end else None
        if len(piece) < AHEAD + MARKER:
            return None
        at += AHEAD
    return None


def unpacked(stored: bytes, head: dict) -> bytes | None:
    """The body, if it is whole."""
    if head["sha256"] is None or len(stored) != head["stored"]:
        return None
    try:
        body = zlib.decompress(stored)
    except zlib.error:
        return None
    return body if hashlib.sha256(body).hexdigest() == head["sha256"] else None


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"url": pa.string(), "status": pa.int32(), "headers": pa.map_(pa.string(), pa.string()), "body": pa.binary(), "sha256": pa.string(), "intact": pa.bool_()}
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))


class PackWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.path, self.overwrite = options["path"], overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, path = opened(self.path)
        name = f"{uuid.uuid4().hex}.pack"
        out = None
        for batch in iterator:
            for url, status, headers, body in zip(*[batch.column(c).to_pylist() for c in ("url", "status", "headers", "body")], strict=True):
                if out is None:
                    system.create_dir(path, recursive=True)
                    out, marker = system.open_output_stream(f"{path}/.{name}"), uuid.uuid4().bytes
                    out.write(MAGIC + marker)
                stored = b"" if body is None else zlib.compress(body, 6)
                head = {"url": url, "status": status, "headers": None if headers is None else dict(headers), "sha256": None if body is None else hashlib.sha256(body).hexdigest(), "stored": len(stored)}
                head_bytes = json.dumps(head).encode()
                out.write(marker + len(head_bytes).to_bytes(4, "big") + head_bytes + stored)
        if out is None:
            return Written(None, None)
        out.close()
        return Written(f"{path}/.{name}", f"{path}/{name}")

    def commit(self, messages: list[Written | None]) -> None:
        system, path = opened(self.path)
        system.create_dir(path, recursive=True)
        before = [f.path for f in system.get_file_info(fs.FileSelector(path)) if f.base_name.endswith(".pack") and not f.base_name.startswith(".")]
        for m in messages:
            if m is not None and m.name:
                system.move(m.hidden, m.name)
        for old in before if self.overwrite else ():
            system.delete_file(old)

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = opened(self.path)
        for m in messages:
            if m is not None and m.hidden:
                system.delete_file(m.hidden)


class ResponsePack(DataSource):
    @classmethod
    def name(cls) -> str:
        return "response_pack"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> PackReader:
        return PackReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema: object, overwrite: bool) -> PackWriter:
        return PackWriter({k.lower(): v for k, v in self.options.items()}, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with filters handed to it."""
    spark.dataSource.register(ResponsePack)
    spark.conf.set(PUSHDOWN, "true")
