import struct

import pytest
import zstandard

from matchloom.llm import warc
from matchloom.session import scratch_path


@pytest.fixture
def pages(spark):
    long, other = "é" * 600, "x" * 999
    rows = [
        (1, "http://a/1", long, "x"), (9, "http://a/ü \r\n", long, "x"), (3, None, long, "x"), (4, "u", other, None),
        (5, "u", other, None), (6, "u", None, None), (7, "u", "", None), (None, "u", long, None),
        (8, "u", "z" * 300_000 + "\r\n\r\nWARC/1.1\r\n", None), (9, "http://a/9", long, "repeated"),
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string, sha1 string")


def test_round_trip(spark, pages):
    index = warc.write_bundles(pages, scratch_path(spark, "warc"), frame_bytes=2000)
    got = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_records(index).collect()}
    assert got == {
        (1, "revisit", 9, 1200), (9, "response", None, 1200), (3, "revisit", 9, 1200), (4, "response", None, 999),
        (5, "response", None, 999), (6, "response", None, 0), (7, "response", None, 0), (None, "revisit", 9, 1200),
        (8, "response", None, 300_014),
    }
    html = {r.page_id: r.html or "" for r in pages.collect()}
    for r in warc.read_records(index).filter("record_type = 'response'").collect():
        assert bytes(r.payload).decode() == html[r.page_id]


def test_one_record_costs_one_frame(spark, pages):
    index = warc.write_bundles(pages, scratch_path(spark, "warc"), frame_bytes=2000)
    got = warc.read_records(index.filter("page_id = 8")).collect()
    assert [(r.page_id, len(r.payload)) for r in got] == [(8, 300_014)]
    assert index.select("path", "frame").distinct().count() > 2


def test_bundles_are_plain_zstandard_with_a_seek_table(spark, pages, tmp_path):
    writer = warc.BundleWriter(str(tmp_path), "b.warc.zst", 100)
    records = [bytes([k]) * (30 * k) for k in range(1, 12)]
    places = [writer.add(r) for r in records]
    writer.close()
    raw = (tmp_path / "b.warc.zst").read_bytes()
    with zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True) as all_frames:
        assert all_frames.read() == b"".join(records)
    assert struct.unpack("<I", raw[-4:])[0] == 0x8F92EAB1
    reader = warc.BundleReader(str(tmp_path / "b.warc.zst"))
    for (frame, offset), r in zip(places, records, strict=True):
        assert reader.frame(frame)[offset : offset + len(r)] == r
    damaged = bytearray(raw)
    damaged[20] ^= 1
    (tmp_path / "d.zst").write_bytes(damaged)
    with pytest.raises(Exception):  # noqa: B017
        for k in range(3):
            warc.BundleReader(str(tmp_path / "d.zst")).frame(k)


def test_empty_table(spark, pages):
    assert warc.archive_and_read(pages.limit(0)).collect() == []
