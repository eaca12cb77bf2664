import hashlib
import struct

import pyarrow.fs as pafs
import zstandard

from filingpanel.llm import warc

LONG, OTHER = "<p>" + "x" * 200, "<p>" + "é" * 70
ROWS = [(3, "http://a", LONG), (1, "http://b\r\nX: y", LONG), (2, None, LONG), (4, "u", None), (5, "u", ""), (6, "u", "x" * 99),
        (7, "u", "x" * 99), (8, "u", OTHER), (9, "u", OTHER), (9, "u", OTHER), (None, "u", OTHER), (None, None, "WARC/1.1\r\n\r\n" * 20),
        (10, "u", "big" * 300000), (8, "u", OTHER)]


def frame(spark):
    return spark.createDataFrame([(*r, "extra") for r in ROWS], "page_id long, url string, html string, payload string")


def brute():
    out = []
    for i, _, h in ROWS:
        p = (h or "").encode()
        ids = [j for j, _, g in ROWS if (g or "") == (h or "") and j is not None]
        revisit = len(p) >= 100 and bool(ids) and i != min(ids)
        out.append((str(i), len(p), hashlib.sha256(p).hexdigest(), "revisit" if revisit else "response", min(ids) if revisit else None))
    return sorted(map(str, out))


def test_records_come_back(spark):
    index = warc.write_bundles(warc.mark_revisits(frame(spark).repartition(3)))
    rows = warc.read_bundles(index).collect()
    got = [(str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows]
    assert sorted(map(str, got)) == brute()
    texts = {(i, h) for i, _, h in ROWS}
    for r in rows:
        if r.record_type == "response":
            assert (r.page_id, bytes(r.payload).decode() or None) in texts or (r.page_id, bytes(r.payload).decode()) in texts
        else:
            assert r.payload is None
    assert {r.url for r in rows if r.page_id == 1} == {"http://b X: y"}
    assert warc.read_bundles(warc.write_bundles(warc.mark_revisits(frame(spark).limit(0)))).count() == 0


def test_bundles_are_seekable(spark, monkeypatch):
    index = warc.write_bundles(warc.mark_revisits(frame(spark).repartition(1))).collect()
    bundle = {r.bundle for r in index}
    assert len(bundle) == 1 and len({r.frame for r in index}) > 1
    reader = warc.BundleReader(bundle.pop())
    for r in index:
        assert reader.record(r.frame, r.offset)["page_id"] == (int(r.record_id.split(":")[2]) if r.record_id else None)
        assert reader.frames[r.frame][:2] == (r.frame_start, r.frame_size)
    fs, path = pafs.FileSystem.from_uri(index[0].bundle)
    data = fs.open_input_file(path).read()
    whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()  # a plain reader skips the table
    assert whole.count(b"WARC-Type: ") >= len(index)
    assert struct.unpack("<I", data[-4:])[0] == warc.SEEK_MAGIC


def test_reading_is_dealt_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(warc, "FRAME_BYTES", 400)
    monkeypatch.setattr(warc, "READ_BYTES", 2000)
    pages = spark.range(300).repartition(1).selectExpr("id AS page_id", "'u' AS url", "repeat(sha2(string(id), 256), 3) AS html")
    index = warc.write_bundles(warc.mark_revisits(pages))
    out = warc.read_bundles(index)
    sizes = [r.frame_size for r in index.dropDuplicates(["bundle", "frame"]).collect()]
    assert out.rdd.getNumPartitions() == -(-sum(sizes) // 2000) > 8
    assert sorted(r.page_id for r in out.collect()) == list(range(300))


def test_chosen_records_only(spark):
    index = warc.write_bundles(warc.mark_revisits(frame(spark)))
    rows = warc.read_bundles(index.where("record_id = 'urn:page:3'")).collect()
    assert [(r.page_id, r.record_type, r.refers_to) for r in rows] == [(3, "revisit", 1)]
