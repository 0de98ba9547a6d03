"""WARC records in seekable Zstandard bundles.

Records are grouped into independent frames of about ``FRAME_BYTES``; a bundle ends with a seek
table. The index has one row per record: its identifier, bundle, frame, and place inside the
frame, so a reader decompresses only the frame that holds a wanted record."""

from __future__ import annotations

import hashlib
import uuid
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapline.llm.common import open_store, partitions, scratch, settle, write_file
from trapline.llm.seekable import Reader, packed

FRAME_BYTES = 1 << 20
BUNDLE_FRAMES = 128
#: Payloads shorter than this are always stored in full.
REVISIT_BYTES = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = ("page_id long, record_id string, bundle string, frame int, offset long, length long")
RECORDS = ("page_id long, record_id string, payload_bytes long, payload_digest string, "
           "record_type string, refers_to long, target_uri string, payload binary")


def record_id(page) -> str:
    return f"<urn:x-page:{'null' if page is None else page}>"


def page_of(identifier: str) -> int | None:
    page = identifier.removeprefix("<urn:x-page:").removesuffix(">")
    return None if page == "null" else int(page)


def record(page, url, digest: str, payload: bytes, refers_to, date: str) -> bytes:
    """Bytes of one response record, or of a revisit record if ``refers_to`` is set. A revisit
    keeps the HTTP head of the payload and leaves the payload out."""
    head = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    revisit = refers_to is not None
    block = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
             f"WARC-Record-ID: {record_id(page)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe="%/:=&?~#+!$,;'@()*[]"))
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}",
              "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> dict:
    """Fields of a record. The payload of a response is hashed and held against its header."""
    top, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = top.decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[:int(fields["Content-Length"])]
    head, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in head.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    kind = fields["WARC-Type"]
    if kind == "response":
        found = hashlib.sha256(payload).hexdigest()
        if found != digest or len(payload) != size:
            raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return {"page_id": page_of(fields["WARC-Record-ID"]), "record_id": fields["WARC-Record-ID"],
            "payload_bytes": size, "payload_digest": digest, "record_type": kind,
            "refers_to": page_of(fields["WARC-Refers-To"]) if kind == "revisit" else None,
            "target_uri": fields.get("WARC-Target-URI"),
            "payload": payload if kind == "response" else None}


def planned(pages: DataFrame, key: str, url: str, body: str) -> DataFrame:
    """Pages with digest and, for later copies of a payload, the page that holds it. Only
    digests met more than once are joined back; their minimum is pre-aggregated."""
    payload = F.coalesce(F.col(body), F.lit(""))
    rows = pages.select(F.col(key).cast("bigint").alias("page_id"), F.col(url).alias("url"),
                        payload.alias("html"), F.sha2(payload.cast("binary"), 256).alias("digest"))
    firsts = settle(rows.where(F.octet_length("html") >= REVISIT_BYTES).groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count("*").alias("n")).where(
        "n > 1 and first is not null").drop("n"))
    later = F.col("page_id").isNull() | (F.col("page_id") > F.col("first"))
    return rows.join(firsts, "digest", "left").withColumn(
        "refers_to", F.when(F.col("first").isNotNull() & later, F.col("first"))).drop("first")


def _bundles(folder: str, date: str):
    def write(batches):
        frames, frame, rows, size = [], [], [], 0
        name = ""

        def flush():
            write_file(folder, name, packed(frames))
            return pa.RecordBatch.from_pylist(rows, schema=SCHEMA)

        for batch in batches:
            for row in batch.to_pylist():
                name = name or f"{uuid.uuid4().hex}.warc.zst"
                data = record(row["page_id"], row["url"], row["digest"], row["html"].encode(),
                              row["refers_to"], date)
                rows.append({"page_id": row["page_id"], "record_id": record_id(row["page_id"]),
                             "bundle": name, "frame": len(frames), "offset": size,
                             "length": len(data)})
                frame.append(data)
                size += len(data)
                if size >= FRAME_BYTES:
                    frames.append(b"".join(frame))
                    frame, size = [], 0
                    if len(frames) == BUNDLE_FRAMES:
                        yield flush()
                        frames, rows, name = [], [], ""
        if frame:
            frames.append(b"".join(frame))
        if frames:
            yield flush()
    return write


SCHEMA = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("bundle", pa.string()),
                    ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])
READ = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()),
                  ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                  ("record_type", pa.string()), ("refers_to", pa.int64()),
                  ("target_uri", pa.string()), ("payload", pa.binary())])


def write(pages: DataFrame, folder: str | None = None, key: str = "page_id", url: str = "url",
          body: str = "html", date: str = "1970-01-01T00:00:00Z") -> tuple[DataFrame, str]:
    """Write one record per page into bundles below ``folder`` (a new one in the shared folder if
    not given) and return the settled index and the folder.

    A null body is an empty payload; a null address leaves the target out. Of equal payloads of
    ``REVISIT_BYTES`` or more the smallest page holds the payload and the others refer to it; rows
    that repeat that page are responses too; a null page comes after all others and refers to the
    smallest, and if all pages of a payload are null each is a response. No pages give no bundle
    and an empty index. Other columns are ignored. A long body is one record in one frame, which
    must fit in a task. A bundle is renamed into place when it is
    whole and the index names only bundles of tasks that ended, so lost executors leave at most
    files that nothing refers to."""
    folder = folder or scratch(pages.sparkSession)
    rows = planned(pages, key, url, body)
    return settle(rows.mapInArrow(_bundles(folder, date), INDEX)), folder


def _fetch(folder: str, whole: bool):
    def read(batches):
        store, path = open_store(folder)
        held, reader = None, None
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                if held != row["bundle"]:
                    if reader:
                        reader.close()
                    held, reader = row["bundle"], Reader(store, f"{path}/{row['bundle']}")
                frame = reader.frame(row["frame"])
                got = parsed(frame[row["offset"]:row["offset"] + row["length"]])
                found.append(got if whole else got | {"payload": None})
                if len(found) == 256:
                    yield pa.RecordBatch.from_pylist(found, schema=READ)
                    found = []
            yield pa.RecordBatch.from_pylist(found, schema=READ)
    return read


def read(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records that the rows of ``index`` name, read from the bundles and checked. Rows meet
    by bundle and frame, so each wanted frame is decompressed about once."""
    near = index.repartition(partitions(index), "bundle", "frame").sortWithinPartitions(
        "bundle", "frame", "offset")
    return near.mapInArrow(_fetch(folder, payloads), RECORDS)
