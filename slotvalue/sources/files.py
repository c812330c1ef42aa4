"""Binary files as tables: byte ranges on reading, two-phase commit on writing.

``spark.read.format("file_ranges")`` gives ``path, length, start, data``: every file in ranges of ``range_bytes``, or with
``header`` only its first bytes.  A range is read by itself, so a file may be larger than a row may be, and looking at
headers does not read the files.

``df.write.format("file_store").mode("append")`` writes rows ``(name, content)`` as files below a folder.  Tasks write
into a staging folder of their own; the driver moves whole task folders into place once all tasks are done, so a
reader sees no half-written file, and neither a failed nor a repeated attempt leaves one behind.

Paths go to the Arrow file systems: local ones, ``s3a://`` and ``s3://``, ``gs://``, and ``hdfs://`` where its native
client is installed.  Other schemes are refused when the table is opened.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

RANGE_BYTES = 8 << 20
# Bytes and files of a task.
TASK_BYTES = 128 << 20
TASK_FILES = 2_000
_STAGING = "_staged-"

RANGES = "path string, length bigint, start bigint, data binary"
# Names of schemes in the two worlds.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "gcs": "gs"}


def store_uri(path: str) -> str:
    """The path with its scheme as Arrow names it; local paths without one."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return path
    return "/" + rest.lstrip("/") if scheme == "file" else f"{_SCHEMES.get(scheme, scheme)}:{rest}"


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system of a Spark path, and the path in it."""
    try:
        return pafs.FileSystem.from_uri(store_uri(path))
    except (pa.ArrowInvalid, OSError) as e:
        raise ValueError(f"files below {path} cannot be reached by tasks: {e}") from e


@dataclass
class _Piece:
    path: str
    length: int
    start: int
    size: int


@dataclass
class _Share(InputPartition):
    """What one task reads."""

    pieces: list[_Piece]


class _RangeReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"]
        self.header = int(options.get("header", 0))
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))
        self.suffix = options.get("suffix", "")
        open_store(self.root)

    def _pieces(self) -> Iterator[_Piece]:
        fs, root = open_store(self.root)
        if fs.get_file_info(root).type == pafs.FileType.NotFound:
            return
        selector = pafs.FileSelector(root, recursive=True)
        for info in sorted(fs.get_file_info(selector), key=lambda i: i.path):
            inner = posixpath.relpath(info.path, root)
            if info.type != pafs.FileType.File or any(p[0] in "._" for p in inner.split("/")) or not inner.endswith(self.suffix):
                continue
            if self.header:
                yield _Piece(info.path, info.size, 0, min(self.header, info.size))
                continue
            for start in range(0, max(1, info.size), self.range_bytes):
                yield _Piece(info.path, info.size, start, min(self.range_bytes, info.size - start))

    def partitions(self) -> list[InputPartition]:
        shares, size = [_Share([])], 0
        for piece in self._pieces():
            if shares[-1].pieces and (size + piece.size > TASK_BYTES or len(shares[-1].pieces) >= TASK_FILES):
                shares.append(_Share([]))
                size = 0
            shares[-1].pieces.append(piece)
            size += piece.size
        return shares

    def read(self, partition: _Share) -> Iterator[tuple]:
        fs, _ = open_store(self.root)
        for p in partition.pieces:
            with fs.open_input_file(p.path) as file:
                yield p.path, p.length, p.start, bytes(file.read_at(p.size, p.start))


class FileRanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_ranges"

    def schema(self) -> str:
        return RANGES

    def reader(self, schema: StructType) -> DataSourceReader:
        return _RangeReader(self.options)


@dataclass
class _Staged(WriterCommitMessage):
    """The folder of a task, if it wrote anything."""

    folder: str | None


class _StoreWriter(DataSourceWriter):
    def __init__(self, options):
        self.root = options["path"]
        self.job = uuid.uuid4().hex
        open_store(self.root)

    def _staging(self) -> tuple[pafs.FileSystem, str, str]:
        fs, root = open_store(self.root)
        return fs, root, posixpath.join(root, _STAGING + self.job)

    def write(self, iterator) -> WriterCommitMessage:
        fs, _, staging = self._staging()
        folder, made = posixpath.join(staging, uuid.uuid4().hex), set()
        for name, content in iterator:
            parts = name.split("/")
            if any(not p or p[0] in "._" for p in parts):
                raise ValueError(f"not a file name: {name!r}")
            target = posixpath.join(folder, name)
            parent = posixpath.dirname(target)
            if parent not in made:
                fs.create_dir(parent, recursive=True)
                made.add(parent)
            with fs.open_output_stream(target, compression=None) as out:
                out.write(content or b"")
        return _Staged(folder if made else None)

    def commit(self, messages) -> None:
        fs, root, staging = self._staging()
        for m in messages:
            if m is not None and m.folder:
                fs.move(m.folder, posixpath.join(root, "part-" + posixpath.basename(m.folder)))
        self._clear(fs, staging)

    def abort(self, messages) -> None:
        fs, _, staging = self._staging()
        self._clear(fs, staging)

    @staticmethod
    def _clear(fs: pafs.FileSystem, staging: str) -> None:
        if fs.get_file_info(staging).type != pafs.FileType.NotFound:
            fs.delete_dir(staging)


class FileStore(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_store"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("files are only added; use mode append")
        return _StoreWriter(self.options)


def register(spark: SparkSession) -> SparkSession:
    """Make both formats known to a session."""
    for source in (FileRanges, FileStore):
        spark.dataSource.register(source)
    return spark


def write_files(files: DataFrame, path: str) -> None:
    """Rows ``(name, content)`` as files below ``path``; a name may have folders."""
    register(files.sparkSession)
    files.select("name", F.col("content").cast("binary")).write.format("file_store").mode("append").save(path)


def read_headers(spark: SparkSession, path: str, size: int, suffix: str = "") -> DataFrame:
    """The first ``size`` bytes of every file; the rest is not read."""
    return register(spark).read.format("file_ranges").option("header", size).option("suffix", suffix).load(path)


def read_ranges(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, suffix: str = "") -> DataFrame:
    reader = register(spark).read.format("file_ranges").option("range_bytes", range_bytes)
    return reader.option("suffix", suffix).load(path)


def stored_name() -> Column:
    """The name that a file was written under."""
    return F.regexp_extract("path", "/part-[0-9a-f]{32}/(.+)$", 1)


def tree_digests(ranges: DataFrame) -> DataFrame:
    """``(path, length, sha256)`` of files of any size, from their ranges.

    A file of one range has the SHA-256 of its bytes; otherwise that of the digests of its ranges, one in a line.  No task
    holds more than a range, or than the 64 characters of each range of a file.
    """
    each = ranges.select("path", "length", "start", F.sha2("data", 256).alias("digest"))
    listed = each.groupBy("path").agg(F.max("length").alias("length"), F.array_sort(F.collect_list(F.struct("start", "digest"))).alias("d"))
    whole = F.when(F.size("d") == 1, F.col("d")[0]["digest"]).otherwise(F.sha2(F.array_join(F.col("d.digest"), "\n"), 256))
    return listed.select("path", "length", whole.alias("sha256"))
