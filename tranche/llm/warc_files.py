"""WARC files in and out, as a Spark data source.

`spark.read.format("warc").load(folder)` gives a row per record: file, at (its place in the file, or that of its gzip member),
record (bytes) and error (null). Files ending in .gz usually hold a gzip member per record; a member of several is cut into them
by their lengths. A file is read by one task, a record or member at a time, so that is what a task holds. Option `split` cuts .gz files into parts of so many bytes, a part beginning with the first member
of a record that starts in it: right as long as no record holds, uncompressed, gzip members of records itself.
`df.write.format("warc").save(folder)` writes a .warc.gz file per task, a member per record; files appear when the job ends.

Defined results: an empty folder has no records; null records aren't written. What follows a broken record in a plain file, a
gzip member that isn't whole, and one that doesn't end with a record, raise; with option `mode` set to `permissive` each of them
gives a row without a record that has the reason in `error`, and reading goes on with the next gzip member that can be found.
"""

from __future__ import annotations

import gzip
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

CHUNK, STEP = 1 << 20, 1 << 16
MEMBER = b"\x1f\x8b\x08"


def folder_of(path: str) -> tuple[FileSystem, str]:
    scheme, found, rest = path.partition(":")
    return FileSystem.from_uri(path if not found or rest.startswith("//") else f"{scheme}://{rest}")


@dataclass
class Part(InputPartition):
    path: str
    begin: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    name: str
    records: int


class View:
    """Bytes of a file from a place on, read in chunks: data[pos:] follows what was done with."""

    def __init__(self, file, at: int):
        file.seek(at)
        self.file, self.start, self.pos, self.data, self.over = file, at, 0, b"", False

    @property
    def at(self) -> int:
        return self.start + self.pos

    def more(self) -> bool:
        left = self.data[self.pos :]
        got = self.file.read(CHUNK + len(left))  # twice as much each time, so that long records stay linear
        self.start, self.pos, self.data, self.over = self.at, 0, left + got, not got
        return not self.over

    def member(self) -> tuple[bytes, int] | None:
        """The gzip member that follows and its size; None if it isn't whole yet. zlib.error if there is none."""
        inflate, out, at = zlib.decompressobj(31), [], self.pos
        while at < len(self.data) and not inflate.eof:
            piece = self.data[at : at + STEP]
            out.append(inflate.decompress(piece))
            at += len(piece)
        return (b"".join(out), at - len(inflate.unused_data) - self.pos) if inflate.eof else None


class Broken(ValueError):
    """What can't be read as a record."""


def record_size(data: bytes, at: int) -> int | None:
    """Bytes of the record that begins at a place; None if its header isn't whole. Broken if none begins there."""
    head = data.find(b"\r\n\r\n", at)
    if head < 0:
        return None
    lines = data[at:head].split(b"\r\n")
    size = next((int(v) for k, _, v in (x.partition(b":") for x in lines) if k.strip().lower() == b"content-length" and v.strip().isdigit()), None)
    if size is None or not lines[0].startswith(b"WARC/"):
        raise Broken("no record")
    return size + head - at + 8


def cut(member: bytes) -> Iterator[bytes]:
    """The records of a gzip member. One alone is given as it is, whatever its header says of its length."""
    at = 0
    while at < len(member):
        size = record_size(member, at)
        rest = len(member) - at
        if at == 0 and (size is None or size >= rest):
            yield member
            return
        if size is None or size > rest:
            raise Broken("no whole record at the end of a gzip member")
        yield member[at : at + size]
        at += size


def gzip_records(file, begin: int, end: int, lenient: bool = False) -> Iterator[tuple[int, bytes | None, str | None]]:
    """Records of the members that start from begin to end, with errors if lenient. Past the file's start, the first member is
    the first place that inflates to a record."""
    view, aligned = View(file, begin), begin == 0
    while view.at < end:
        if len(view.data) - view.pos < len(MEMBER):
            if view.more():
                continue
            return
        if not aligned:
            spot = view.data.find(MEMBER, view.pos)
            view.pos = spot if spot >= 0 else len(view.data) - len(MEMBER) + 1
            if spot < 0 or view.at >= end:
                continue
        try:
            found = view.member()
            while found is None and view.more():
                found = view.member()
            real = found is not None and found[0].startswith(b"WARC/")
        except zlib.error:
            real = False
        if real:
            try:
                for record in cut(found[0]):
                    yield view.at, record, None
            except Broken as e:
                if not lenient:
                    raise Broken(f"{e} at {view.at}") from e
                yield view.at, None, str(e)
            view.pos, aligned = view.pos + found[1], True
        elif aligned:
            if not lenient:
                raise Broken(f"no whole gzip member of a record at {view.at}")
            yield view.at, None, "no whole gzip member of a record"
            view.pos, aligned = view.pos + 1, False
        else:
            view.pos += 1


def plain_records(file, lenient: bool = False) -> Iterator[tuple[int, bytes | None, str | None]]:
    view = View(file, 0)
    try:
        while True:
            while (size := record_size(view.data, view.pos)) is None or len(view.data) - view.pos < size:
                if not view.more():
                    if view.data[view.pos :].strip():
                        raise Broken("no whole record")
                    return
            yield view.at, view.data[view.pos : view.pos + size], None
            view.pos += size
    except Broken as e:
        if not lenient:
            raise Broken(f"{e} at {view.at}") from e
        yield view.at, None, str(e)


class Reader(DataSourceReader):
    def __init__(self, path: str, split: int, lenient: bool):
        self.path, self.split, self.lenient = path, split, lenient

    def partitions(self) -> list[Part]:
        fs, root = folder_of(self.path)
        parts = []
        for f in fs.get_file_info(FileSelector(root, recursive=True)):
            if f.type == FileType.File and f.path.endswith((".warc", ".warc.gz")) and "/_" not in f.path[len(root) :]:
                step = self.split if self.split and f.path.endswith(".gz") else max(1, f.size)
                parts += [Part(f.path, i, min(i + step, f.size)) for i in range(0, f.size, step)]
        return parts or [Part("", 0, 0)]

    def read(self, part: Part) -> Iterator[tuple]:
        if part.path:
            fs, _ = folder_of(self.path)
            with fs.open_input_file(part.path) as file:
                for at, record, error in gzip_records(file, part.begin, part.end, self.lenient) if part.path.endswith(".gz") else plain_records(file, self.lenient):
                    yield part.path.rsplit("/", 1)[-1], at, record, error


class Writer(DataSourceWriter):
    """Each try of a task writes a file of its own below _writing; those of the tries that count are moved in the end."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, rows) -> Written:
        fs, root = folder_of(self.path)
        fs.create_dir(f"{root}/_writing-{self.job}")
        name, n = f"records-{uuid.uuid4().hex}.warc.gz", 0
        with fs.open_output_stream(f"{root}/_writing-{self.job}/{name}", compression=None) as out:
            for r in rows:
                if r["record"] is not None:
                    out.write(gzip.compress(bytes(r["record"]), mtime=0))
                    n += 1
        return Written(name, n)

    def _discard(self, fs: FileSystem, root: str) -> None:
        if fs.get_file_info(f"{root}/_writing-{self.job}").type == FileType.Directory:
            fs.delete_dir(f"{root}/_writing-{self.job}")

    def commit(self, messages) -> None:
        """New files get their names first, then the old ones go: a failure between leaves both, and loses none."""
        fs, root = folder_of(self.path)
        fs.create_dir(root)
        old = [f.path for f in fs.get_file_info(FileSelector(root)) if f.type == FileType.File and f.path.endswith((".warc", ".warc.gz"))] if self.overwrite else []
        for m in messages:
            if m is not None and m.records:
                fs.move(f"{root}/_writing-{self.job}/{m.name}", f"{root}/{m.name}")
        for f in old:
            fs.delete_file(f)
        self._discard(fs, root)

    def abort(self, messages) -> None:
        self._discard(*folder_of(self.path))


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return "file string, at long, record binary, error string"

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], int(self.options.get("split", 0)), self.options.get("mode", "").lower() == "permissive")

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format "warc" known to a session."""
    spark.dataSource.register(WarcSource)
