"""A folder of source files as a data source of Spark, for batches and streams.

Files are listed when a read is planned; conditions on path and size are met before any file is opened, and files are dealt to partitions by size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith,
)

from tessera.operators.text import with_language
from tessera.sources.corpus import MOST_BYTES, SKIPPED_DIRS, is_link

NAME = "tessera_folder"
SCHEMA = "file_path string, byte_size long, content string"
#: What opening a file counts as, in bytes, when files are dealt to partitions.
OPEN_COST = 1 << 16
TESTS: dict[type, Callable] = {
    EqualTo: lambda x, v: x == v, EqualNullSafe: lambda x, v: x == v, In: lambda x, v: x in v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v, LessThan: lambda x, v: x < v,
    LessThanOrEqual: lambda x, v: x <= v, StringStartsWith: lambda x, v: x.startswith(v), StringEndsWith: lambda x, v: x.endswith(v), StringContains: lambda x, v: v in x,
}


@dataclass
class Found:
    """A file: its path below the root, size, and time of change in nanoseconds."""

    path: str
    size: int
    changed: int


@dataclass
class Part(InputPartition):
    """Files that one task reads."""

    files: list[Found]


def listed(root: str) -> list[Found]:
    """The files below ``root`` that are read: none in skipped directories, hidden, linked, or over ``MOST_BYTES``."""
    fs, base = pafs.FileSystem.from_uri(root)
    base, out, folders = base.rstrip("/"), [], [""]
    while folders:
        folder = folders.pop()
        for e in fs.get_file_info(pafs.FileSelector(f"{base}/{folder}".rstrip("/"))):
            path = e.path[len(base) :].lstrip("/")
            if is_link(fs, e.path):
                continue
            if e.type == pafs.FileType.Directory:
                if e.base_name not in SKIPPED_DIRS:
                    folders.append(path)
            elif not e.base_name.startswith(".") and (e.size or 0) <= MOST_BYTES:
                out.append(Found(path, e.size or 0, e.mtime_ns or 0))
    return sorted(out, key=lambda f: f.path)


def dealt(files: list[Found], most: int) -> list[Part]:
    """Files in order, in partitions of about ``most`` bytes."""
    parts, size = [], most
    for f in files:
        if size + f.size + OPEN_COST > most or not parts:
            parts.append(Part(0))
            parts[-1].files, size = [], 0
        parts[-1].files.append(f)
        size += f.size + OPEN_COST
    return parts


class _Folder:
    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.most = options["path"], int(options.get("partitionBytes", 1 << 26))

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        """Batches of some megabytes; files that aren't UTF-8, or are gone, are left out."""
        fs, base = pafs.FileSystem.from_uri(self.root)
        rows, size = [], 0
        for f in part.files if part else []:
            try:
                with fs.open_input_stream(f"{base.rstrip('/')}/{f.path}") as s:
                    rows.append((f.path, f.size, s.read().decode()))
            except (UnicodeDecodeError, FileNotFoundError):
                continue
            size += f.size
            if size > 1 << 23:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    path, size, content = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(size, pa.int64()), pa.array(content, pa.string())], ["file_path", "byte_size", "content"])


class FolderReader(_Folder, DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        super().__init__(options)
        self.wanted: list[tuple[str, Filter]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Take the conditions on path and size; the others stay with Spark."""
        for f in filters:
            column = f.attribute[0] if type(f) in TESTS and len(f.attribute) == 1 else ""
            if column in ("file_path", "byte_size"):
                self.wanted.append((column, f))
            else:
                yield f

    def partitions(self) -> list[Part]:
        meets = lambda f: all(TESTS[type(t)](f.path if c == "file_path" else f.size, t.value) for c, t in self.wanted)
        return dealt([f for f in listed(self.root) if meets(f)], self.most)


class FolderStream(_Folder, DataSourceStreamReader):
    """Files in order of their time of change, then path; an offset is the last one. A file that lands with an older time than what was read is not seen."""

    def initialOffset(self) -> dict:  # noqa: N802
        return {"changed": -1, "path": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        last = max(((f.changed, f.path) for f in listed(self.root)), default=(-1, ""))
        return {"changed": last[0], "path": last[1]}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        key = lambda o: (o["changed"], o["path"])
        return dealt([f for f in listed(self.root) if key(start) < (f.changed, f.path) <= key(end)], self.most)

    def commit(self, end: dict) -> None:
        pass


class FolderSource(DataSource):
    """Format ``tessera_folder``: ``file_path, byte_size, content`` of the text files below ``path``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options)

    def streamReader(self, schema) -> FolderStream:  # noqa: N802
        return FolderStream(self.options)


def _ready(spark: SparkSession) -> None:
    spark.dataSource.register(FolderSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_folder(spark: SparkSession, root: str, partition_bytes: int = 1 << 26) -> DataFrame:
    """``file_path, byte_size, content, language`` of the text files below ``root``. Conditions on path and size are met before files are opened."""
    _ready(spark)
    return with_language(spark.read.format(NAME).option("partitionBytes", partition_bytes).load(root))


def stream_folder(spark: SparkSession, root: str, partition_bytes: int = 1 << 26) -> DataFrame:
    """The same as a stream of files that land below ``root``."""
    _ready(spark)
    return with_language(spark.readStream.format(NAME).option("partitionBytes", partition_bytes).load(root))
