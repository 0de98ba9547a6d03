import hashlib
import io
import os

import zstandard

from trapline.llm import warc
from trapline.llm.common import open_store
from trapline.llm.seekable import Reader

SCHEMA = "page_id long, url string, html string, digest string, first int, bundle string"
LONG = "<p>" + "é" * 200 + "</p>"


def table(spark, rows):
    return spark.createDataFrame([(i, u, h, "d", 1, "b") for i, u, h in rows], SCHEMA)


def results(df):
    return {r.page_id: r for r in df.collect()}


def test_round_trip(spark):
    rows = [(i, f"http://x/{i}?a b", f"<html>{'z' * i}</html>\r\n\r\nWARC/1.1\r\n") for i in
            range(1, 300)]
    index, folder = warc.write(table(spark, rows))
    got = results(warc.read(index, folder))
    assert len(got) == 299
    for i, _, html in rows:
        assert got[i].payload == html.encode() and got[i].record_type == "response"
        assert got[i].payload_digest == hashlib.sha256(html.encode()).hexdigest()
        assert got[i].target_uri == f"http://x/{i}?a%20b"


def test_later_copies_refer_to_the_smallest_page(spark):
    rows = [(9, "u", LONG), (3, None, LONG), (7, "u", LONG), (4, "u", "short"), (5, "u", "short")]
    index, folder = warc.write(table(spark, rows))
    got = results(warc.read(index, folder))
    assert [(got[i].record_type, got[i].refers_to) for i in (3, 7, 9, 4, 5)] == [
        ("response", None), ("revisit", 3), ("revisit", 3), ("response", None),
        ("response", None)]
    assert got[9].payload is None and got[9].payload_bytes == len(LONG.encode())
    assert got[9].payload_digest == got[3].payload_digest


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "a\r\nb: c", ""), (None, "u", LONG), (5, "u", LONG),
            (5, "u", LONG), (6, "u", "x" * 3_000_000)]
    index, folder = warc.write(table(spark, rows))
    got = warc.read(index, folder).collect()
    kinds = sorted((str(r.page_id), r.record_type, r.payload_bytes) for r in got)
    size = len(LONG.encode())
    assert kinds == [("1", "response", 0), ("2", "response", 0), ("5", "response", size),
                     ("5", "response", size), ("6", "response", 3_000_000),
                     ("None", "revisit", size)]


def test_no_pages(spark):
    index, folder = warc.write(table(spark, []))
    assert warc.read(index, folder).collect() == []


def test_one_record_needs_one_frame(spark, monkeypatch):
    rows = [(i, "u", f"{i} " * 4000) for i in range(100)]
    index, folder = warc.write(table(spark, rows).coalesce(1))
    row = index.where("page_id = 60").first()
    store, path = open_store(folder)
    reader = Reader(store, f"{path}/{row.bundle}")
    assert len(reader.table) > 1
    record = warc.parsed(reader.frame(row.frame)[row.offset:row.offset + row.length])
    assert record["page_id"] == 60 and record["payload"].startswith(b"60 60")
    with open(os.path.join(path, row.bundle), "rb") as file:  # any reader sees the whole bundle
        whole = zstandard.ZstdDecompressor().stream_reader(
            io.BytesIO(file.read()), read_across_frames=True).read()
    assert whole.count(b"WARC/1.1\r\n") == 100
