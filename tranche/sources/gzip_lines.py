"""Lines of gzip files in tasks of their own size.

A gzip file may be many members one after another (files appended to each other, block gzip). A task gets a range of a file's
bytes and reads the members that begin in it; the first is found by its magic bytes and believed once it inflates whole, with
its checksum. A line belongs to the task in whose members it begins: a task passes over what precedes its first line feed, and
reads on past its range to the end of its last line. A file of one member is thus read by its first task, and by no other.

Files are opened by pyarrow (local, hdfs, s3 and gs paths), with its own credentials and not Spark's Hadoop settings.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

MAGIC = b"\x1f\x8b\x08"
#: Compressed bytes read at once, and most bytes inflated at once.
CHUNK, STEP = 1 << 16, 1 << 20
#: Compressed bytes of a task unless asked otherwise; lines handed on at once; lines of a member that is written.
SPLIT, BATCH, MEMBER = 64 << 20, 10_000, 5000
SCHEMA = "file string, piece long, n long, value string"


def opened(path: str) -> tuple[FileSystem, str]:
    return FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (FileSystem.from_uri(f"file://{path}")[0], path)


class Broken(ValueError):
    """Bytes that aren't a whole gzip member."""


class Members:
    """Inflates the members of a file from a place on, a piece at a time."""

    def __init__(self, file, at: int):
        self.file, self.at, self.data = file, at, b""  # at: the place of data's first byte
        file.seek(at)

    def more(self) -> bool:
        got = self.file.read(CHUNK)
        self.data += got
        return bool(got)

    def go(self, at: int) -> None:
        self.at, self.data = at, b""
        self.file.seek(at)

    def found(self, end: int) -> bool:
        """Goes to the first whole member from here on that begins before end."""
        while self.at < end:
            spot = self.data.find(MAGIC)
            if spot < 0:
                self.at, self.data = self.at + max(0, len(self.data) - 2), self.data[-2:]
                if not self.more():
                    return False
                continue
            self.at, self.data = self.at + spot, self.data[spot:]
            begin = self.at
            try:
                for _ in self.member():
                    pass
                self.go(begin)
                return begin < end
            except Broken:
                self.go(begin + 1)
        return False

    def member(self) -> Iterator[bytes]:
        """What the member here holds; afterwards this stands behind it. Zeros that pad a file are passed over."""
        inflate = zlib.decompressobj(31)
        while not inflate.eof:
            if not self.data and not inflate.unconsumed_tail and not self.more():
                raise Broken(f"a gzip member ends early at {self.at}")
            given = inflate.unconsumed_tail or self.data
            try:
                out = inflate.decompress(given, STEP)
            except zlib.error as e:
                raise Broken(f"no gzip member at {self.at}") from e
            left = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
            self.at, self.data = self.at + len(given) - len(left), left if inflate.eof else b""
            if out:
                yield out
        while (self.data or self.more()) and not self.data.lstrip(b"\0"):
            self.at, self.data = self.at + len(self.data), b""
        padding = len(self.data) - len(self.data.lstrip(b"\0"))
        self.at, self.data = self.at + padding, self.data[padding:]


def lines(file, begin: int, end: int) -> Iterator[bytes]:
    """The lines that begin in members from begin to end."""
    members = Members(file, begin)
    if begin and not members.found(end):
        return
    left, passing = b"", bool(begin)
    while members.data or members.more():
        beyond = members.at >= end  # only the line that was begun before, or begins here, is still ours
        for data in members.member():
            parts = (left + data).split(b"\n")
            left = parts.pop()
            for line in parts:
                if passing:
                    passing = False
                else:
                    yield line
                if beyond:
                    return
    if left and not passing:
        yield left


@dataclass
class Range(InputPartition):
    path: str
    begin: int
    end: int


class Reader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> list[Range]:
        fs, root = opened(self.path)
        info = fs.get_file_info(root)
        files = [info] if info.type == FileType.File else fs.get_file_info(FileSelector(root, recursive=True))
        return [Range(f.path, i, min(i + self.split, f.size)) for f in files if f.type == FileType.File and f.base_name.endswith(".gz") and f.base_name[0] not in "._" for i in range(0, f.size, self.split)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = opened(self.path)
        held: list[str] = []
        done = 0

        def batch() -> pa.RecordBatch:
            k = len(held)
            return pa.RecordBatch.from_arrays([pa.array([partition.path] * k, pa.string()), pa.array([partition.begin] * k, pa.int64()), pa.array(range(done, done + k), pa.int64()), pa.array(held, pa.string())], ["file", "piece", "n", "value"])

        with fs.open_input_file(partition.path) as file:
            for line in lines(file, partition.begin, partition.end):
                held.append(line.removesuffix(b"\r").decode("utf-8", "replace"))
                if len(held) == BATCH:
                    yield batch()
                    done, held = done + BATCH, []
        if held:
            yield batch()


@dataclass
class Written(WriterCommitMessage):
    path: str


class Writer(DataSourceWriter):
    """A file a task, members of so many lines. Files get their names when all are whole."""

    def __init__(self, path: str, member: int):
        self.path, self.member = path, member

    def write(self, rows: Iterator) -> Written:
        from pyspark import TaskContext

        fs, root = opened(self.path)
        context = TaskContext.get()
        path = f"{root}/_{context.partitionId():05d}-{context.taskAttemptId()}"
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(path, compression=None) as out:
            held: list[str] = []
            for row in rows:
                held.append(row[0])
                if len(held) == self.member:
                    out.write(self.packed(held))
                    held = []
            if held:
                out.write(self.packed(held))
        return Written(path)

    @staticmethod
    def packed(held: list[str]) -> bytes:
        deflate = zlib.compressobj(wbits=31)
        return deflate.compress("".join(f"{x}\n" for x in held).encode()) + deflate.flush()

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = opened(self.path)
        for m in messages:
            if m:
                fs.move(m.path, f"{root}/part-{m.path.rsplit('/_', 1)[1].split('-')[0]}.gz")

    def abort(self, messages: list[Written | None]) -> None:
        fs, _ = opened(self.path)
        for m in messages:
            if m:
                fs.delete_file(m.path)


class GzipLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gzip_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], int(self.options.get("split", SPLIT)))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], int(self.options.get("member", MEMBER)))


def read_gzip_lines(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """file, piece, n and value of the lines of a .gz file, or of those of a folder; split: compressed bytes of a task."""
    spark.dataSource.register(GzipLines)
    return spark.read.format("gzip_lines").option("path", path).option("split", split).load()


def write_gzip_lines(lines: DataFrame, path: str, member: int = MEMBER) -> None:
    """Writes lines (value) to a new folder, a file a task, each of members that can be read apart."""
    lines.sparkSession.dataSource.register(GzipLines)
    lines.select("value").write.format("gzip_lines").option("path", path).option("member", member).mode("append").save()
