import random
import zlib

import numpy as np
import public_tokenizers as public
import pytest
from tokenizers import Tokenizer

from tests.llm.test_bpe import texts
from trapline.llm import queries, token_files
from trapline.llm.common import open_store
from trapline.llm.seekable import Reader

PATH = public.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, part int, start long, file string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "f") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def known():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def test_files_hold_the_documents_in_order(spark, known):
    rows = [(i * 7 % 1000, t) for i, t in enumerate(texts())]
    index, folder = token_files.write(table(spark, rows).repartition(3), PATH)
    got = {r.doc_id: r for r in token_files.read(index, folder).collect()}
    start = 0
    for i, text in sorted(rows):
        want = [*known(text), 0]
        assert np.frombuffer(got[i].ids, "<u4").tolist() == want
        assert (got[i].start, got[i].n_tokens) == (start, len(want))
        start += len(want)


def test_a_reader_fetches_only_the_frames_it_wants(spark, known, monkeypatch):
    monkeypatch.setattr(token_files, "FRAME_BYTES", 2000)
    rows = [(i, f"document {i} " * 50) for i in range(40)]
    index, folder = token_files.write(table(spark, rows).coalesce(1), PATH)
    wanted = token_files.read(index.where("doc_id IN (3, 30)"), folder).collect()
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist()[:-1] for r in wanted} == {
        i: known(rows[i][1]) for i in (3, 30)}
    row = index.where("doc_id = 30").first()
    store, path = open_store(folder)
    reader = Reader(store, f"{path}/{row.file}")
    assert row.frame < len(reader.table)


@pytest.mark.parametrize("size,documents", [(1, 1 << 17), (5000, 1 << 17), (1 << 28, 3)])
def test_files_roll(spark, known, monkeypatch, size, documents):
    """The files of a range follow each other, and their index is passed on file by file."""
    import pyarrow as pa
    monkeypatch.setattr(token_files, "FRAME_BYTES", 1000)
    monkeypatch.setattr(token_files, "FILE_BYTES", size)
    monkeypatch.setattr(token_files, "FILE_DOCUMENTS", documents)
    monkeypatch.setattr(token_files, "TaskContext", type("Task", (), {
        "get": staticmethod(lambda: type("Part", (), {"partitionId": lambda self: 4})())}))
    written = []
    monkeypatch.setattr(token_files, "write_file", lambda folder, name, body: written.append(
        (name, sum(map(len, body)))))
    rows = [(i, t) for i, t in enumerate(texts()[:120])]
    batch = pa.record_batch({"doc_id": [i for i, _ in rows], "text": [t for _, t in rows]})
    index = []
    for out in token_files._writer("folder", PATH, False)([batch.slice(0, 50), batch.slice(50)]):
        index += out.to_pylist()
        assert len(written) == len({r["file"] for r in index})
    assert [r["doc_id"] for r in index] == [i for i, _ in rows]
    assert len(written) > 5 and {r["part"] for r in index} == {4}
    start = 0
    for r, (_, text) in zip(index, rows):
        assert (r["before"], r["n_tokens"]) == (start, len(known(text)) + 1)
        start += r["n_tokens"]
    for name, _ in written:
        own = [r for r in index if r["file"] == name]
        assert len({r["frame"] for r in own}) == max(r["frame"] for r in own) + 1
        for a, b in zip(own, own[1:]):
            same = a["frame"] == b["frame"]
            assert b["offset"] == (a["offset"] + 4 * a["n_tokens"] if same else 0)


def test_a_damaged_frame_is_found(spark):
    index, folder = token_files.write(table(spark, [(1, "some text")]).coalesce(1), PATH)
    store, path = open_store(folder)
    row = index.first()
    with open(f"{path}/{row.file}", "r+b") as file:
        file.seek(-13, 2)  # the checksum in the table
        file.write(b"\0\0\0\0")
    reader = Reader(store, f"{path}/{row.file}")
    with pytest.raises(ValueError):
        reader.frame(0)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "null key"), (3, "same"), (3, "same"), (4, "w " * 100_000)]
    index, folder = token_files.write(table(spark, rows), PATH)
    got = sorted(((r.start, r.n_tokens) for r in token_files.read(
        index, folder, digest=True).collect()))
    assert len(got) == 6 and got[0][0] == 0
    assert all(a + n == b for (a, n), (b, _) in zip(got, got[1:]))
    assert {r.doc_id: r.n_tokens for r in index.collect()}[1] == 1


def test_no_rows(spark):
    index, folder = token_files.write(table(spark, []), PATH)
    assert token_files.read(index, folder).collect() == []


def test_the_query_encodes_as_the_plain_call_does(spark, tmp_path):
    """Strings of added tokens, which the registered query takes as the library does."""
    rng = random.Random(6)
    parts = ["<|endoftext|>", "<|endoftext", "|>", "end", ".", ",", " ", "  ", "\n", "'s", "7"]
    rows = [(0, "end.<|endoftext|> next")] + [
        (i, "".join(rng.choices(parts, k=12))) for i in range(1, 400)]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    plain, start = Tokenizer.from_file(PATH), 0
    got = {r.doc_id: r for r in queries.op8_token_files(spark, str(tmp_path)).collect()}
    for i, text in rows:
        ids = np.array([*plain.encode(text, add_special_tokens=False).ids, 0], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (
            start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
