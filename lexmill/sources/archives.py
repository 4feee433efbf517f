"""A ZIP archive as a data source: many tasks read one archive, each a range of its members, none the whole file.

``spark.read.format("context_zip").option("tasks", 16).load("corpus.zip")`` has the columns ``source_name, content``. The
planner reads the archive's directory, a line for each member, as Spark lists files; tasks seek to their members.
"""

from __future__ import annotations

import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lexmill.sources.stores import open_seekable

MEMBER = re.compile(r"context_(\d+)\.json")


def members(archive: zipfile.ZipFile) -> list[tuple[str, zipfile.ZipInfo]]:
    """``(base name, entry)`` in the order of base names; unsafe, encrypted, linked, foreign or repeated entries are errors."""
    out: dict[str, zipfile.ZipInfo] = {}
    for e in archive.infolist():
        path = PurePosixPath(e.filename)
        if path.is_absolute() or ".." in path.parts or "\\" in e.filename:
            raise ValueError(f"unsafe path: {e.filename}")
        if e.flag_bits & 1 or (e.external_attr >> 16) & 0o170000 == 0o120000:
            raise ValueError(f"encrypted or linked: {e.filename}")
        if e.is_dir():
            continue
        if not MEMBER.fullmatch(path.name) or path.name in out:
            raise ValueError(f"foreign or repeated name: {path.name}")
        out[path.name] = e
    return sorted(out.items())


@dataclass
class Members(InputPartition):
    """Some members of one archive: base name, place of the local header, packed and unpacked size, CRC, method."""

    path: str
    entries: list[tuple[str, int, int, int, int, int]]


def unpack(file, entry: tuple[str, int, int, int, int, int]) -> bytes:
    """One member's bytes, read at its place; a wrong header, size or checksum is an error."""
    name, at, packed, size, crc, method = entry
    file.seek(at)
    head = file.read(30)
    if len(head) < 30 or head[:4] != b"PK\x03\x04":
        raise ValueError(f"{name}: no member at {at}")
    file.seek(at + 30 + sum(struct.unpack("<HH", head[26:30])))
    data = file.read(packed)
    if method == zipfile.ZIP_DEFLATED:
        inflate = zlib.decompressobj(-15)
        data = inflate.decompress(data, size + 1)  # never more than the directory promises
    elif method != zipfile.ZIP_STORED:
        raise ValueError(f"{name}: packed by method {method}")
    if len(data) != size or zlib.crc32(data) != crc:
        raise ValueError(f"{name}: size or checksum is wrong")
    return data


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.tasks = options["path"], int(options.get("tasks", 32))

    def partitions(self) -> list[Members]:
        """Members in the order of their names, cut into ranges of about equal packed size."""
        with open_seekable(self.path) as file, zipfile.ZipFile(file) as z:
            found = [(n, e.header_offset, e.compress_size, e.file_size, e.CRC, e.compress_type) for n, e in members(z)]
        total, sofar, parts = sum(e[2] + 64 for e in found), 0, [[] for _ in range(max(1, self.tasks))]
        for e in found:
            parts[sofar * len(parts) // total].append(e)
            sofar += e[2] + 64
        return [Members(self.path, p) for p in parts if p] or [Members(self.path, [])]

    def read(self, partition: Members) -> Iterator[pa.RecordBatch]:
        with open_seekable(partition.path) as file:
            held, size = [], 0
            for e in partition.entries:
                held.append((e[0], unpack(file, e)))
                size += len(held[-1][1])
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*held)], names=["source_name", "content"])
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*held)], names=["source_name", "content"])


class ContextZip(DataSource):
    @classmethod
    def name(cls) -> str:
        return "context_zip"

    def schema(self) -> str:
        return "source_name string, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(ContextZip)
    return spark
