"""Zipped exports as a data source: the members of archives are its partitions.

The driver reads each archive's directory (a few bytes per member, at its end)
and deals members to tasks by their packed size.  A task opens the archive
where it lies, goes to its member and streams lines out of it in Arrow batches:
neither a packed archive nor an unpacked member is ever held as a whole, one
archive of many members is several tasks, and a lost task reads its own members
again.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NAME = "archive_lines"
#: packed bytes that one task takes together
TASK_BYTES = 32 << 20
BATCH_LINES = 50_000
_SCHEMA = pa.schema([("value", pa.string()), ("file", pa.string()), ("member", pa.string())])


@dataclass
class Members(InputPartition):
    """(archive, member) pairs of one task."""

    parts: list[tuple[str, str]]


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path for a URI or a local path."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def archives(path: str) -> tuple[fs.FileSystem, list[str]]:
    """The zip files at a path: itself, or those of the folder."""
    system, where = opened(path)
    info = system.get_file_info(where)
    if info.type == fs.FileType.Directory:
        found = [i.path for i in system.get_file_info(fs.FileSelector(where, recursive=True)) if i.type == fs.FileType.File]
        return system, sorted(p for p in found if p.lower().endswith(".zip"))
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    return system, [where]


class ArchiveReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path = options.get("path")
        self.task_bytes = int(options.get("taskBytes", str(TASK_BYTES)))
        self.batch_lines = int(options.get("batchLines", str(BATCH_LINES)))

    def partitions(self) -> list[Members]:
        system, files = archives(self.path)
        out, now, size = [], [], 0
        for file in files:
            with system.open_input_file(file) as f, zipfile.ZipFile(f) as z:
                members = [(m.filename, m.compress_size) for m in z.infolist() if not m.is_dir()]
            for name, packed in members:
                if now and size + packed > self.task_bytes:
                    out.append(Members(now))
                    now, size = [], 0
                now.append((file, name))
                size += packed
        return [*out, Members(now)] if now or not out else out

    def read(self, partition: Members) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.path)
        for file, member in partition.parts:
            with system.open_input_file(file) as f, zipfile.ZipFile(f) as z, z.open(member) as raw:
                lines: list[str] = []
                for line in io.TextIOWrapper(raw, encoding="utf-8", errors="replace"):
                    lines.append(line.rstrip("\r\n"))
                    if len(lines) >= self.batch_lines:
                        yield self._batch(lines, file, member)
                        lines = []
                if lines:
                    yield self._batch(lines, file, member)

    @staticmethod
    def _batch(lines: list[str], file: str, member: str) -> pa.RecordBatch:
        n = len(lines)
        return pa.RecordBatch.from_pydict({"value": lines, "file": [file] * n, "member": [member] * n}, schema=_SCHEMA)


class ArchiveLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "value string, file string, member string"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def read_archive_lines(spark: SparkSession, path: str, task_bytes: int = TASK_BYTES, batch_lines: int = BATCH_LINES) -> DataFrame:
    """Lines of all members of the zip files at ``path`` as (value, file, member)."""
    spark.dataSource.register(ArchiveLines)
    return spark.read.format(NAME).option("taskBytes", task_bytes).option("batchLines", batch_lines).load(path)
