"""Token-ID files: independent Zstandard frames with a seek table and a checksum per frame.

Documents are dealt into ranges of their key; each range is encoded in order and written as files
of 32-bit little-endian ids, cut into frames at document ends and into files at frame ends. The
index holds each document's file, frame, place in the frame and length, so a reader decompresses
only the frames of the documents it is asked for."""

from __future__ import annotations

import itertools
import uuid
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trapline.llm.common import open_store, partitions, scratch, settle, write_file
from trapline.llm.pieces import Memo, bounded
from trapline.llm.seekable import Reader, packed

FRAME_BYTES = 1 << 20
#: Bytes of ids and documents after which a file ends; the last frame may pass the bytes.
FILE_BYTES = 1 << 28
FILE_DOCUMENTS = 1 << 17
END_ID = 0
INDEX = ("doc_id long, part int, file string, frame int, offset long, before long, n_tokens long")
SCHEMA = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("file", pa.string()),
                    ("frame", pa.int32()), ("offset", pa.int64()), ("before", pa.int64()),
                    ("n_tokens", pa.int64())])


@lru_cache(maxsize=1)
def memory(tokenizer: str, special: bool = False) -> Memo:
    """One memory of pieces per worker, kept from task to task."""
    return Memo(encoder(tokenizer, special))


def encoder(tokenizer: str, special: bool = False):
    """Encode lists of texts with the tokenizers library. Special strings give the ids of their
    added tokens if ``special`` (the library's default), else they are ordinary text. They hold no
    white space and no stop or comma, so no piece cuts them."""
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    known = Tokenizer.from_file(tokenizer)
    known.encode_special_tokens = not special

    def encode(texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes()
                for e in known.encode_batch_fast(texts, add_special_tokens=False)]
    return encode


def _frames(batches, memo: Memo):
    """Frames of whole documents in order, each with the keys and the numbers of ids of its
    documents."""
    end = np.array([END_ID], "<u4").tobytes()
    frame, keys, counts, size = [], [], [], 0
    for batch in batches:
        ids_of, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for start, end_at in bounded(texts):
            for key, ids in zip(ids_of[start:end_at], memo(texts[start:end_at])):
                frame += (ids, end)
                keys.append(key)
                counts.append(len(ids) // 4 + 1)
                size += 4 * counts[-1]
                if size >= FRAME_BYTES:
                    yield b"".join(frame), keys, counts
                    frame, keys, counts, size = [], [], [], 0
    if keys:
        yield b"".join(frame), keys, counts


def _writer(folder: str, tokenizer: str, special: bool):
    """Files of bounded size from the frames of a range; the index of a file is passed on as soon
    as the file is whole, so a range of any size takes the memory of one frame and one index."""
    def write(batches):
        part, before = TaskContext.get().partitionId(), 0
        stream = _frames(batches, memory(tokenizer, special))
        head = next(stream, None)
        while head is not None:
            name, index = f"{part:06d}-{uuid.uuid4().hex}.ids.zst", []

            def body():
                nonlocal head, before
                number = size = documents = 0
                while head is not None and size < FILE_BYTES and documents < FILE_DOCUMENTS:
                    data, keys, counts = head
                    ends = np.cumsum(counts)
                    index.append((keys, np.full(len(keys), number), 4 * (ends - counts),
                                  before + ends - counts, counts))
                    yield data
                    number, before = number + 1, before + int(ends[-1])
                    size, documents = size + len(data), documents + len(keys)
                    head = next(stream, None)

            write_file(folder, name, packed(body()))
            keys, *columns = zip(*index)
            keys = pa.array(list(itertools.chain.from_iterable(keys)), pa.int64())
            frame, offset, start, tokens = map(np.concatenate, columns)
            yield pa.RecordBatch.from_arrays([
                keys, pa.array(np.full(len(keys), part), pa.int32()),
                pa.array([name] * len(keys), pa.string()), pa.array(frame, pa.int32()),
                pa.array(offset, pa.int64()), pa.array(start, pa.int64()),
                pa.array(tokens, pa.int64())], schema=SCHEMA)
    return write


def write(docs: DataFrame, tokenizer: str, folder: str | None = None, key: str = "doc_id",
          text: str = "text", special: bool = False) -> tuple[DataFrame, str]:
    """Encode every text, end it with ``END_ID`` and write the ids in ascending key order below
    ``folder`` (a new one in the shared folder if not given). Returns the settled index and the
    folder; ``start`` counts the ids of all documents before. ``special`` as in ``encoder``.

    A null text is empty and has the end id only. Null keys come first; rows with equal keys are
    ordered by a hash of the text; repeated rows are written each. A text of any length is one run
    of ids in one frame, which must fit in a task. No rows write no files and give an empty index;
    other columns are ignored. A file is renamed into place when
    it is whole, and the index names only files of tasks that ended."""
    folder = folder or scratch(docs.sparkSession)
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"),
                       F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text")]
    dealt = rows.repartitionByRange(partitions(docs), *order).sortWithinPartitions(*order)
    index = settle(dealt.mapInArrow(_writer(folder, tokenizer, special), INDEX))
    # one row per range of keys
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = index.groupBy("part").agg(F.sum("n_tokens").alias("_ids")).select(
        "part", F.coalesce(F.sum("_ids").over(before), F.lit(0)).alias("_base"))
    placed = index.join(F.broadcast(bases), "part").withColumn(
        "start", F.col("_base") + F.col("before"))
    return placed.drop("_base", "before"), folder


READ = "doc_id long, start long, n_tokens long, ids binary"


def _fetch(folder: str, digest: bool):
    def read(batches):
        store, path = open_store(folder)
        held, reader = None, None
        for batch in batches:
            rows = batch.to_pylist()
            for first in range(0, len(rows), 256):
                found = []
                for row in rows[first:first + 256]:
                    if held != row["file"]:
                        if reader:
                            reader.close()
                        held, reader = row["file"], Reader(store, f"{path}/{row['file']}")
                    ids = reader.frame(row["frame"])[
                        row["offset"]:row["offset"] + 4 * row["n_tokens"]]
                    found.append((row["doc_id"], row["start"], len(ids) // 4,
                                  zlib.crc32(ids) if digest else ids))
                columns = list(zip(*found)) or [[]] * 4
                kinds = [pa.int64()] * 3 + [pa.int64() if digest else pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)],
                    ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])
    return read


def read(index: DataFrame, folder: str, digest: bool = False) -> DataFrame:
    """The ids of the documents in ``index`` (all, or those asked for), read from the files; with
    ``digest`` the unsigned CRC-32 of the ids instead of the ids. Rows meet by frame."""
    near = index.repartition(partitions(index), "file", "frame").sortWithinPartitions(
        "file", "frame", "offset")
    return near.mapInArrow(_fetch(folder, digest), READ.replace(
        "ids binary", "ids_crc32 long") if digest else READ)
