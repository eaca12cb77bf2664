"""Zip archives as a Spark data source, ``filing_archive``: many tasks read one archive, tasks write archives of their own.

Reading: the central directory at the end of an archive lists its members. The driver streams through it once and keeps
only where to cut it; a task gets one piece of the directory, seeks to the members named there and inflates them one by
one. No task opens a whole archive, and its share is bounded by ``memberBytes`` and ``members``.

Files are reached through ``pyarrow.fs``, on the driver and in the tasks, so paths are local ones or URIs that it knows
(``file``, ``hdfs``, ``s3``, ``gs``).
"""

from __future__ import annotations

import bz2
import os
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "filing_archive"
SCHEMA = "archive string, path string, content binary, error string"
TEXT_SCHEMA = SCHEMA.replace("content binary", "text string")
MEMBER_BYTES, MEMBERS = 64 << 20, 100_000  # packed bytes and members of one task
ARCHIVE_BYTES = 1 << 30  # packed bytes of one written archive
BATCH_BYTES, BATCH_ROWS, READ_BYTES = 8 << 20, 20_000, 4 << 20
# Fixed values of the format: signatures and sizes of its records, the marker for a field that is in the 64-bit extension.
END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
END_SIZE, END64_SIZE, LOCATOR64_SIZE, ENTRY_SIZE, LOCAL_SIZE, MAX_COMMENT = 22, 56, 20, 46, 30, 0xFFFF
WIDE = 0xFFFFFFFF
STORED, DEFLATED, BZIPPED = 0, 8, 12


def open_path(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path[len("file:"):])
    return pafs.LocalFileSystem(), os.path.abspath(path)


class Window:
    """A file that is read ahead in pieces; small reads that follow each other cost one request."""

    def __init__(self, file):
        self.file, self.size, self.at, self.held = file, file.size(), 0, b""

    def read(self, at: int, n: int) -> bytes:
        if not (self.at <= at and at + n <= self.at + len(self.held)):
            self.at, self.held = at, self.file.read_at(min(max(n, READ_BYTES), max(self.size - at, 0)), at)
        start = at - self.at
        return self.held[start:start + n]


@dataclass(slots=True)
class Member:
    """One entry of a central directory; ``width``: bytes that it takes there."""

    name: str
    flags: int
    method: int
    crc: int
    packed: int
    size: int
    header: int
    width: int

    @classmethod
    def parse(cls, data: bytes, at: int) -> Member | None:
        """The entry at ``at``, or None if ``data`` ends before it does."""
        if len(data) < at + ENTRY_SIZE:
            return None
        if data[at:at + 4] != ENTRY:
            raise ValueError("no entry of a central directory where one should be")
        flags, method, _, _, crc, packed, size, n_name, n_extra, n_comment, _, _, _, header = struct.unpack_from("<HHHHIIIHHHHHII", data, at + 8)
        width = ENTRY_SIZE + n_name + n_extra + n_comment
        if len(data) < at + width:
            return None
        begin = at + ENTRY_SIZE
        name = data[begin:begin + n_name].decode("utf-8" if flags & 0x800 else "cp437", "replace")
        extra, i = data[begin + n_name:begin + n_name + n_extra], 0
        while i + 4 <= len(extra):
            kind, length = struct.unpack_from("<HH", extra, i)
            if kind == 1:  # the 64-bit values, in this order, of the fields that are marked
                field = i + 4
                if size == WIDE:
                    size, field = struct.unpack_from("<Q", extra, field)[0], field + 8
                if packed == WIDE:
                    packed, field = struct.unpack_from("<Q", extra, field)[0], field + 8
                if header == WIDE:
                    header = struct.unpack_from("<Q", extra, field)[0]
            i += 4 + length
        return cls(name, flags, method, crc, packed, size, header, width)


def directory(file: Window) -> tuple[int, int, int]:
    """Place of the central directory, its size, and by how much places in it are too small (bytes before the archive)."""
    tail_at = max(0, file.size - END_SIZE - MAX_COMMENT)
    tail = file.read(tail_at, file.size - tail_at)
    end = tail.rfind(END)
    while end >= 0 and (len(tail) < end + END_SIZE or end + END_SIZE + struct.unpack_from("<H", tail, end + 20)[0] > len(tail)):
        end = tail.rfind(END, 0, end)  # the signature may stand in the comment
    if end < 0:
        raise ValueError("not a zip archive")
    size, start = struct.unpack_from("<II", tail, end + 12)
    behind = end_at = tail_at + end
    if end_at >= LOCATOR64_SIZE and (locator := file.read(end_at - LOCATOR64_SIZE, LOCATOR64_SIZE))[:4] == LOCATOR64:
        end64_at = struct.unpack_from("<Q", locator, 8)[0]
        record = file.read(end64_at, END64_SIZE)
        if record[:4] != END64:  # bytes before the archive: the record lies right before its locator
            end64_at = end_at - LOCATOR64_SIZE - END64_SIZE
            record = file.read(end64_at, END64_SIZE)
        size, start = struct.unpack_from("<QQ", record, 40)
        behind = end64_at
    return behind - size, size, behind - size - start


@dataclass
class Piece(InputPartition):
    """Entries of one stretch of a central directory."""

    archive: str
    at: int
    size: int
    shift: int

    def __init__(self, archive: str, at: int, size: int, shift: int):
        self.archive, self.at, self.size, self.shift = archive, at, size, shift


def pieces(archive: str, file: Window, suffix: str, member_bytes: int, members: int) -> Iterator[Piece]:
    """Cuts of the directory so that a piece holds about ``member_bytes`` of packed members, at most ``members`` of them."""
    at, size, shift = directory(file)
    begin, done, end = at, at, at + size
    held, total, count = b"", 0, 0
    read_at = at
    while done < end:
        entry, offset = None, done - read_at
        if held:
            entry = Member.parse(held, offset)
        if entry is None:
            read_at, held = done, file.read(done, min(READ_BYTES, end - done))
            entry = Member.parse(held, 0)
            if entry is None:
                raise ValueError(f"{archive} ends inside its central directory")
        if entry.name.endswith(suffix):
            if count and (total + entry.packed > member_bytes or count >= members):
                yield Piece(archive, begin, done - begin, shift)
                begin, total, count = done, 0, 0
            total, count = total + entry.packed, count + 1
        done += entry.width
    if count:
        yield Piece(archive, begin, end - begin, shift)


def inflated(file: Window, member: Member, shift: int) -> bytes:
    """Bytes of one member, checked."""
    if member.flags & 1:
        raise ValueError("encrypted")
    at = member.header + shift
    local = file.read(at, LOCAL_SIZE)
    if local[:4] != LOCAL:
        raise ValueError("no local header")
    n_name, n_extra = struct.unpack_from("<HH", local, 26)
    data = file.read(at + LOCAL_SIZE + n_name + n_extra, member.packed)
    if member.method == DEFLATED:
        data = zlib.decompressobj(-zlib.MAX_WBITS).decompress(data, member.size + 1)
    elif member.method == BZIPPED:
        data = bz2.decompress(data)
    elif member.method != STORED:
        raise ValueError(f"unknown compression method {member.method}")
    if len(data) != member.size or zlib.crc32(data) != member.crc:
        raise ValueError("size or checksum differs")
    return data


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        options = {k.lower(): v for k, v in options.items()}
        if not options.get("path"):
            raise ValueError("give the folder or the archive as path")
        self.path, self.suffix = options["path"], options.get("suffix", "")
        self.text = options.get("text", "false").lower() == "true"
        self.member_bytes, self.members = int(options.get("memberbytes", MEMBER_BYTES)), int(options.get("members", MEMBERS))

    def archives(self) -> list[str]:
        fs, path = open_path(self.path)
        info = fs.get_file_info(path)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if info.type == pafs.FileType.File:
            return [self.path]
        found = fs.get_file_info(pafs.FileSelector(path))
        names = sorted(f.base_name for f in found if f.type == pafs.FileType.File and f.base_name.endswith(".zip") and f.base_name[0] not in "._")
        return [f"{self.path.rstrip('/')}/{n}" for n in names]

    def partitions(self) -> list[Piece]:
        out = []
        for archive in self.archives():
            fs, path = open_path(archive)
            with fs.open_input_file(path) as file:
                out += pieces(archive, Window(file), self.suffix, self.member_bytes, self.members)
        return out

    def read(self, partition: Piece | None) -> Iterator[pa.RecordBatch]:
        """Members of one piece. One that cannot be read has its reason in ``error`` and no content."""
        if partition is None:  # no archive
            return
        fs, path = open_path(partition.archive)
        with fs.open_input_file(path) as file:
            window = Window(file)
            listed, at, members = window.read(partition.at, partition.size), 0, []
            while at < len(listed):
                member = Member.parse(listed, at)
                at += member.width
                if member.name.endswith(self.suffix) and not member.name.endswith("/"):
                    members.append(member)
            rows, held = [], 0
            for member in sorted(members, key=lambda m: m.header):
                try:
                    content, error = inflated(window, member, partition.shift), None
                except (ValueError, EOFError, OSError, struct.error, zlib.error) as e:
                    content, error = None, str(e) or type(e).__name__
                held += len(content or b"")
                if self.text and content is not None:
                    content = content.decode("utf-8", "ignore")
                rows.append((partition.archive, member.name, content, error))
                if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                    yield _batch(rows, self.text)
                    rows, held = [], 0
            if rows:
                yield _batch(rows, self.text)


def _batch(rows: list[tuple], text: bool = False) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.string() if text else pa.binary(), pa.string()]
    names = ["archive", "path", "text" if text else "content", "error"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class ArchiveWriter(DataSourceArrowWriter):
    """Writes ``path`` and ``content`` (binary or text) as members. Each task fills archives of its own under names that readers
    pass over; they are renamed when all tasks have ended, so files of lost attempts are never read."""

    def __init__(self, options: dict, overwrite: bool):
        options = {k.lower(): v for k, v in options.items()}
        self.path, self.archive_bytes = options["path"], int(options.get("archivebytes", ARCHIVE_BYTES))
        self.overwrite = overwrite
        fs, path = open_path(self.path)
        fs.create_dir(path, recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, folder = open_path(self.path)
        part, names, stream, archive = TaskContext.get().partitionId(), [], None, None

        def close() -> None:
            archive.close()
            stream.close()

        for batch in iterator:
            paths, contents = batch.column(batch.schema.names.index("path")), batch.column(batch.schema.names.index("content"))
            for name, content in zip(paths, contents):
                if archive is None:
                    names.append(f"part-{part:05d}-{uuid.uuid4().hex}.zip")
                    stream = fs.open_output_stream(f"{folder}/_{names[-1]}")
                    archive = zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED, allowZip64=True)
                member = zipfile.ZipInfo(name.as_py())  # of the same date, so equal rows give equal bytes
                member.compress_type = zipfile.ZIP_DEFLATED
                archive.writestr(member, content.as_py() if content.is_valid else b"")
                if archive.start_dir >= self.archive_bytes or len(archive.filelist) >= MEMBERS:  # the list is kept until the end
                    close()
                    archive = None
        if archive is not None:
            close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        fs, folder = open_path(self.path)
        if self.overwrite:
            for f in fs.get_file_info(pafs.FileSelector(folder)):
                if f.base_name.endswith(".zip") and f.base_name[0] not in "._":
                    fs.delete_file(f.path)
        for m in messages:
            for name in m.names if m else ():
                fs.move(f"{folder}/_{name}", f"{folder}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, folder = open_path(self.path)
        for m in messages:
            for name in m.names if m else ():
                fs.delete_file(f"{folder}/_{name}")


class FilingArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return TEXT_SCHEMA if self.options.get("text", "false").lower() == "true" else SCHEMA

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> ArchiveWriter:
        if not {"path", "content"} <= set(schema.names):
            raise ValueError("members need the columns path and content")
        return ArchiveWriter(dict(self.options), overwrite)


def read_members(spark: SparkSession, path: str, suffix: str = ".txt", member_bytes: int = MEMBER_BYTES, members: int = MEMBERS,
                 text: bool = False) -> DataFrame:
    """``archive, path, content, error`` per member whose name ends in ``suffix``, of one archive or all archives in a folder.

    A folder without archives, and an archive without such members, give no rows. Names that occur twice give two rows.
    ``text`` gives a column ``text`` instead of ``content``, decoded where it is inflated: no second Python process has to hold it.
    """
    spark.dataSource.register(FilingArchive)
    reader = spark.read.format(FORMAT).option("suffix", suffix).option("memberBytes", member_bytes).option("members", members)
    return reader.option("text", text).load(path)


def write_archives(df: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES, overwrite: bool = False) -> None:
    """Write ``path`` and ``content`` of each row as members of archives in a folder, one or more per task."""
    df.sparkSession.dataSource.register(FilingArchive)
    rows = df.select("path", "content")
    rows.write.format(FORMAT).option("archiveBytes", archive_bytes).mode("overwrite" if overwrite else "append").save(path)
