"""Zip archives through the data source: ranges of members, odd archives, writing."""

import io
import random
import struct
import types
import zipfile

import pyarrow as pa
import pytest

from filingpanel.sources import archive, filings


def make(path, members, prefix=b"", comment=b"", wide=False):
    data = io.BytesIO()
    data.write(prefix)
    with zipfile.ZipFile(data, "a" if prefix else "w", allowZip64=True) as z:
        for name, content, method in members:
            info = zipfile.ZipInfo(name)
            info.compress_type = method
            with z.open(info, "w", force_zip64=wide) as f:
                f.write(content)
        z.comment = comment
    path.write_bytes(data.getvalue())


def texts(n, seed=1):
    rng = random.Random(seed)
    methods = [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2]
    return [(f"a/{2000 + i % 20}/{'ü' if i % 7 == 0 else 'f'}{i}.txt", rng.randbytes(rng.randrange(2000)).hex().encode(), rng.choice(methods)) for i in range(n)]


def rows(df):
    return sorted((r.path, bytes(r.content) if r.content is not None else None, r.error) for r in df.collect())


def test_many_tasks_read_one_archive(spark, tmp_path):
    members = texts(300) + [("a/2000/", b"", 0), ("b/readme.md", b"no", 0), ("a/2000/empty.txt", b"", 8)]
    make(tmp_path / "one.zip", members)
    df = archive.read_members(spark, str(tmp_path), ".txt", member_bytes=20_000)
    assert rows(df) == sorted((n, c, None) for n, c, _ in members if n.endswith(".txt"))
    reader = archive.ArchiveReader({"path": str(tmp_path), "suffix": ".txt", "memberBytes": "20000"})
    parts = reader.partitions()
    assert len(parts) > 8 and df.rdd.getNumPartitions() == len(parts)
    packed = {i.filename: i.compress_size for i in zipfile.ZipFile(tmp_path / "one.zip").infolist()}
    for part in parts:  # each task stays within its share
        names = [n for b in reader.read(part) for n in b.column("path").to_pylist()]
        assert len(names) == 1 or sum(packed[n] for n in names) <= 20_000
    few = archive.ArchiveReader({"path": str(tmp_path), "suffix": ".txt", "members": "7"}).partitions()
    assert len(few) == -(-301 // 7)


def test_directory_in_pieces(tmp_path, monkeypatch):
    monkeypatch.setattr(archive, "READ_BYTES", 100)
    members = texts(40)
    make(tmp_path / "one.zip", members)
    reader = archive.ArchiveReader({"path": str(tmp_path / "one.zip"), "memberBytes": "5000"})
    got = [n for p in reader.partitions() for b in reader.read(p) for n in b.column("path").to_pylist()]
    assert sorted(got) == sorted(n for n, *_ in members)


@pytest.mark.parametrize("options", [{"prefix": b"#!/bin/sh\n" * 9}, {"comment": b"PK\x05\x06 in a comment"}, {"wide": True}])
def test_odd_archives(tmp_path, options):
    members = texts(20, 3)
    make(tmp_path / "odd.zip", members, **options)
    reader = archive.ArchiveReader({"path": str(tmp_path)})
    got = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert sorted((r["path"], r["content"]) for r in got) == sorted((n, c) for n, c, _ in members)


def test_wide_end_record(tmp_path):
    """An archive whose end record refers to its 64-bit form."""
    make(tmp_path / "a.zip", texts(5))
    data = (tmp_path / "a.zip").read_bytes()
    end = data.rfind(archive.END)
    count, size, start = struct.unpack_from("<HII", data, end + 10)
    end64 = archive.END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, count, count, size, start)
    locator = archive.LOCATOR64 + struct.pack("<IQI", 0, end, 1)
    short = archive.END + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, archive.WIDE, archive.WIDE, 0)
    for prefix in (b"", b"in front"):
        (tmp_path / "a.zip").write_bytes(prefix + data[:end] + end64 + locator + short)
        reader = archive.ArchiveReader({"path": str(tmp_path)})
        got = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
        assert [(r["path"], r["content"], r["error"]) for r in got] == [(n, c, None) for n, c, _ in texts(5)]


def test_members_that_cannot_be_read(spark, tmp_path):
    members = [("good.txt", b"fine " * 50, 0), ("bad.txt", b"to be spoilt " * 50, 0), ("cut.txt", b"x" * 999, 8), ("last.txt", b"end", 8)]
    make(tmp_path / "x.zip", members)
    data = bytearray((tmp_path / "x.zip").read_bytes())
    data[data.find(b"spoilt")] ^= 1
    at = data.find(b"cut.txt") + len("cut.txt")
    data[at:at + 2] = b"\xff\xff"
    (tmp_path / "x.zip").write_bytes(data)
    got = {p: (c, e) for p, c, e in rows(archive.read_members(spark, str(tmp_path)))}
    assert got["good.txt"] == (b"fine " * 50, None) and got["last.txt"] == (b"end", None)
    assert got["bad.txt"] == (None, "size or checksum differs") and got["cut.txt"][0] is None and got["cut.txt"][1]
    (tmp_path / "no.zip").write_bytes(b"not a zip at all")
    with pytest.raises(ValueError):
        archive.ArchiveReader({"path": str(tmp_path)}).partitions()


def test_written_archives(spark, tmp_path):
    members = texts(200, 5)
    df = spark.createDataFrame([(n, c.decode(), 1) for n, c, _ in members], "path string, content string, archive int").repartition(3)
    folder = str(tmp_path / "out")
    archive.write_archives(df, folder, archive_bytes=30_000)
    assert rows(archive.read_members(spark, folder)) == sorted((n, c, None) for n, c, _ in members)
    names = [p.name for p in (tmp_path / "out").iterdir()]
    assert len(names) > 3 and not [n for n in names if n[0] == "_"]
    archive.write_archives(df.limit(1).select("path", df.content.cast("binary").alias("content")), folder, overwrite=True)
    assert archive.read_members(spark, folder).count() == 1
    archive.write_archives(df.limit(0), str(tmp_path / "none"))
    assert archive.read_members(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="path and content"):
        df.select("archive").write.format(archive.FORMAT).mode("append").save(folder)


def test_a_lost_attempt_leaves_nothing(spark, tmp_path):
    def fails(i):
        if i == 150:
            raise RuntimeError("task lost")
        return str(i)

    from pyspark.sql import functions as F

    df = spark.range(200).repartition(2).select(F.col("id").cast("string").alias("path"), F.udf(fails)("id").alias("content"))
    with pytest.raises(Exception):
        archive.write_archives(df, str(tmp_path / "out"))
    assert archive.read_members(spark, str(tmp_path / "out"), "").count() == 0


def test_texts_are_decoded_where_they_are_inflated(spark, tmp_path):
    """One Python process per task reads filings; bytes that are not UTF-8 are ignored, long directories come in several batches."""
    odd = [("a/2001/1-1.txt", b"\xff\xfea\xc3\xa9\xed\xa0\x80b\xc3", 8), ("a/2001/2-1.txt", "\ufffd \U0001f600 x".encode(), 0), ("a/2001/3-1.txt", b" \n", 8)]
    make(tmp_path / "one.zip", odd)
    docs = filings.read_filing_archives(spark, str(tmp_path), "item1")
    assert {r.accession_number: r.text for r in docs.collect()} == {"1-1": "a\u00e9b", "2-1": "\ufffd \U0001f600 x"}
    plan = docs._jdf.queryExecution().executedPlan().toString()
    assert "InArrow" not in plan and "InPandas" not in plan
    texts = {r.path: r.text for r in archive.read_members(spark, str(tmp_path), text=True).collect()}
    assert texts == {n: c.decode("utf-8", "ignore") for n, c, _ in odd}


def test_written_archives_are_bounded_by_members(spark, tmp_path, monkeypatch):
    """The list of members that a writer keeps does not grow with its task."""
    monkeypatch.setattr(archive, "MEMBERS", 7)
    batch = pa.RecordBatch.from_pydict({"path": [f"{i}.txt" for i in range(20)], "content": ["x"] * 20})
    monkeypatch.setattr(archive.TaskContext, "get", lambda: types.SimpleNamespace(partitionId=lambda: 0))
    writer = archive.ArchiveWriter({"path": str(tmp_path)}, False)
    writer.commit([writer.write(iter([batch]))])
    sizes = [len(zipfile.ZipFile(f).namelist()) for f in tmp_path.glob("*.zip")]
    assert sorted(sizes) == [6, 7, 7]
