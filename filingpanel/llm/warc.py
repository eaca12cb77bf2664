"""WARC archives as seekable Zstandard bundles.

A bundle is a series of independent Zstandard frames, each with whole records, followed by a seek table in a
skippable frame (the public seekable format). An index row names bundle, frame and offset inside the frame.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, staged

# Fixed values of the formats.
SKIPPABLE_MAGIC, SEEK_MAGIC = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FRAME_BYTES, BUNDLE_BYTES, MIN_REVISIT_BYTES = 256 << 10, 32 << 20, 100
READ_BYTES, STRETCH = 128 << 20, 64  # packed bytes of one reading task, frames of a bundle that it reads together

INDEX = "record_id string, bundle string, frame int, frame_start long, frame_size int, offset int, length int"
RECORD = ("page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, "
          "payload binary")


def _record(page_id, url, digest: str, size: int, refers_to, payload: bytes, date: str) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP head (with the full length) and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [b"WARC/1.1", b"WARC-Type: " + (b"response" if refers_to is None else b"revisit")]
    if page_id is not None:
        head.append(f"WARC-Record-ID: <urn:page:{page_id}>".encode())
    if url is not None:
        head.append(b"WARC-Target-URI: " + " ".join(url.split()).encode())
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>".encode(), b"WARC-Profile: " + PROFILE.encode()]
    head += [f"WARC-Date: {date}".encode(), f"WARC-Payload-Digest: sha256:{digest}".encode(),
             b"Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}".encode()]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int) -> tuple[dict, int]:
    """The record that starts at ``at`` and the offset after it; a response's payload is held against its digest."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].split(b"\r\n")
    if lines[0] != b"WARC/1.1":
        raise ValueError("no WARC record here")
    head = dict(line.split(b": ", 1) if b": " in line else (line.rstrip(b":"), b"") for line in lines[1:])
    size = int(head[b"Content-Length"])
    block = data[end + 4:end + 4 + size]
    split = block.index(b"\r\n\r\n")
    http = dict(line.split(b": ", 1) for line in block[:split].split(b"\r\n")[1:])
    digest = head[b"WARC-Payload-Digest"].decode().removeprefix("sha256:")
    revisit = head[b"WARC-Type"] == b"revisit"
    payload = None if revisit else block[split + 4:]
    if not revisit and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != int(http[b"Content-Length"])):
        raise ValueError(f"payload of {head.get(b'WARC-Record-ID')} differs from its digest")
    number = lambda key: int(head[key][10:-1]) if key in head else None  # noqa: E731  <urn:page:N>
    return {
        "page_id": number(b"WARC-Record-ID"), "url": head[b"WARC-Target-URI"].decode() if b"WARC-Target-URI" in head else None,
        "record_type": head[b"WARC-Type"].decode(), "refers_to": number(b"WARC-Refers-To"),
        "payload_bytes": int(http[b"Content-Length"]), "payload_digest": digest, "payload": payload,
    }, end + 4 + size + 4


class BundleWriter:
    """Fills one bundle file; ``close`` appends the seek table."""

    def __init__(self, folder: str, name: str, level: int):
        self.name = f"{folder}/{name}"
        fs, path = pafs.FileSystem.from_uri(self.name)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.out, self.zstd = fs.open_output_stream(path, compression=None), zstandard.ZstdCompressor(level=level)
        self.frames, self.at, self.buffer, self.size, self.waiting = [], 0, [], 0, []

    def add(self, record_id: str | None, data: bytes) -> Iterator[tuple]:
        self.waiting.append((record_id, self.size, len(data)))
        self.buffer.append(data)
        self.size += len(data)
        if self.size >= FRAME_BYTES:
            yield from self.flush()

    def flush(self) -> Iterator[tuple]:
        if self.buffer:
            frame = self.zstd.compress(b"".join(self.buffer))
            self.out.write(frame)
            for record_id, offset, length in self.waiting:
                yield record_id, self.name, len(self.frames), self.at, len(frame), offset, length
            self.frames.append((len(frame), self.size))
            self.at += len(frame)
            self.buffer, self.size, self.waiting = [], 0, []

    def close(self) -> Iterator[tuple]:
        yield from self.flush()
        entries = b"".join(struct.pack("<II", *f) for f in self.frames)
        footer = entries + struct.pack("<IBI", len(self.frames), 0, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(footer)) + footer)
        self.out.close()


class BundleReader:
    """Random access to a bundle through its seek table; only the asked frames are read."""

    def __init__(self, name: str):
        fs, path = pafs.FileSystem.from_uri(name)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        count, descriptor, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEK_MAGIC or descriptor & 0x7C:
            raise ValueError(f"{name} has no readable seek table")
        width = 12 if descriptor & 0x80 else 8
        table = self.file.read_at(count * width, size - 9 - count * width)
        self.frames, at = [], 0
        for i in range(count):
            packed, plain = struct.unpack_from("<II", table, i * width)
            self.frames.append((at, packed, plain))
            at += packed

    def frame(self, i: int) -> bytes:
        at, packed, plain = self.frames[i]
        return zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, at), max_output_size=plain)

    def record(self, frame: int, offset: int) -> dict:
        return parse_record(self.frame(frame), offset)[0]


def mark_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``page_id, url, payload, payload_bytes, payload_digest, refers_to`` (null for a response).

    Payloads are equal if length and SHA-256 are. Of equal ones with at least ``min_bytes``, rows with the smallest
    ``page_id`` are responses (also if that row is repeated), the others refer to it. Null html is empty; a row
    without id refers to the smallest id of its group, and is a response if the group has none.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"),
    ).withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    groups = staged(
        rows.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest", "payload_bytes")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"),
        "warc-groups")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    return rows.join(groups, ["payload_digest", "payload_bytes"], "left").select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest", refers.alias("refers_to"))


def write_bundles(marked: DataFrame, folder: str | None = None, level: int = 3,
                  date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write the records as bundles; returns the staged index, one row per record (see ``INDEX``).

    Each task fills its own bundles of about ``BUNDLE_BYTES``. Names are unique per attempt, and only bundles named
    by the index are ever read, so files of lost attempts do no harm. ``folder`` is a URI that the executors share.
    """
    folder = folder or new_path(marked.sparkSession, "warc-bundles")
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, rows, part = None, [], TaskContext.get().partitionId()
        names = [f.split()[0] for f in INDEX.split(", ")]

        def flushed():
            batch = pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=_arrow_index())
            rows.clear()
            return batch

        for batch in batches:
            columns = [batch.column(c) for c in
                       ("page_id", "url", "payload_digest", "payload_bytes", "refers_to", "payload")]
            for i in range(batch.num_rows):
                page_id, url, digest, size, refers_to, payload = (c[i].as_py() for c in columns)
                writer = writer or BundleWriter(folder, f"{part:05d}-{uuid.uuid4().hex}.warc.zst", level)
                record_id = None if page_id is None else f"urn:page:{page_id}"
                rows += writer.add(record_id, _record(page_id, url, digest, size, refers_to, payload, date))
                if writer.at >= BUNDLE_BYTES:
                    rows += writer.close()
                    writer = None
            if rows:
                yield flushed()
        if writer:
            rows += writer.close()
        if rows:
            yield flushed()

    return staged(marked.mapInArrow(run, INDEX), "warc-index")


def _arrow_index() -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
    return pa.schema([(n, kinds[k]) for n, k in (f.split() for f in INDEX.split(", "))])


def _arrow_record() -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (f.split() for f in RECORD.split(", "))])


def read_bundles(index: DataFrame, payload: bool = True) -> DataFrame:
    """All records that the index names (see ``RECORD``), read through the seek tables.

    Frames are dealt to tasks by stretches of about ``STRETCH`` neighbours, as many tasks as their bytes need at
    ``READ_BYTES`` each, at least one per slot of the cluster; so one large bundle is shared by many tasks. Pass a filtered
    index to fetch chosen records only: other frames are not touched. An empty index gives no records.
    """
    frames = index.groupBy("bundle", "frame").agg(F.collect_list("offset").alias("offsets"), F.first("frame_size").alias("size"))
    total, count = frames.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    slots = index.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, -(-total // READ_BYTES), min(count, slots))
    wanted = frames.drop("size").repartition(tasks, "bundle", F.floor(F.col("frame") / (STRETCH if count > tasks * STRETCH else 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_bundle = defaultdict(list)
            for row in batch.to_pylist():
                by_bundle[row["bundle"]].append((row["frame"], row["offsets"]))
            for name, frames in by_bundle.items():
                reader = BundleReader(name)
                for frame, offsets in sorted(frames):
                    data = reader.frame(frame)
                    records = [parse_record(data, at)[0] for at in sorted(offsets)]
                    if not payload:
                        records = [r | {"payload": None} for r in records]
                    yield pa.RecordBatch.from_pylist(records, schema=_arrow_record())

    return wanted.mapInArrow(run, RECORD)
