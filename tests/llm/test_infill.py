import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from trapline.llm import infill

SCHEMA = "doc_id long, text string, n int, form string, _text string, _h0 int, output string"
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "f", "u", 2, "o") for i, t in rows], SCHEMA)


def brute(key, text, units=UNIT.findall, rate=50, spm=80):
    text = text or ""
    digest = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    cut = units(text)
    a, b = sorted(x % (len(cut) + 1) for x in h[:2])
    prefix, middle, suffix = ("".join(x) for x in (cut[:a], cut[a:b], cut[b:]))
    if not text or any(m in text for m in infill.MARKS) or h[2] % 100 >= rate:
        return len(cut), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(cut), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(cut), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


TEXTS = ["", None, " ", " \t\n", "a", " a", "a ", "a b  c\n", "naïve Ωmega 日本語 😀 x", "<P> a b",
         "a<", "<a <b> <S <M", "𝄞𝄞 𝄞", "x\0y z", "é " * 50, "word " * 40000 + "end\x0b", "日" * 30000,
         "    a", "a\x1cb c"]


def rows_of(got):
    return {r.doc_id: (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got}


@pytest.mark.parametrize("unit,units", [("tokens", UNIT.findall), ("code points", list)])
def test_equals_plain_python(spark, unit, units):
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(12 * len(TEXTS))]
    got = infill.infill(table(spark, rows).repartition(3), unit=unit).collect()
    assert rows_of(got) == {i: brute(i, t, units) for i, t in rows}


@pytest.mark.parametrize("size", [1, 40, 1 << 23])
def test_slices_do_not_matter(spark, monkeypatch, size):
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(60)]
    monkeypatch.setattr(infill, "SLICE_BYTES", size)
    run = infill._infill(100, 50, infill.MARKS, "tokens")
    import pyarrow as pa
    hashes = [[int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[8 * k:8 * k + 8], 16)
               for i, _ in rows] for k in range(4)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([i for i, _ in rows]), pa.array([t or "" for _, t in rows]),
         *[pa.array(h) for h in hashes]], ["k", "t", "a", "b", "c", "d"])
    got = [tuple(r.values())[1:] for b in run([batch.slice(7)]) for r in b.to_pylist()]
    assert got == [brute(i, t, rate=100, spm=50) for i, t in rows[7:]]


def test_text_is_rebuilt_from_output_and_form(spark):
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(12 * len(TEXTS))]
    cut = infill.infill(table(spark, rows), rate=100)
    back = {r.doc_id: r.b for r in cut.select(
        "doc_id", infill.restored(F.col("output"), F.col("form")).alias("b")).collect()}
    assert back == {i: t or "" for i, t in rows}


def test_index_converts_both_ways():
    text = "aé日😀b" * 100 + "ascii only " * 20
    data = np.frombuffer(text.encode(), np.uint8)
    index = infill.Exceptions(data)
    points = np.arange(len(text) + 1)
    places = np.array([len(text[:k].encode()) for k in points])
    assert index.bytes(points).tolist() == places.tolist()
    assert index.points(places).tolist() == points.tolist()
    assert len(index.at) == 300
    plain = infill.Exceptions(np.frombuffer(b"plain", np.uint8))
    assert plain.bytes(np.array([0, 5])).tolist() == plain.points(np.array([0, 5])).tolist()


def test_repeated_rows_null_keys_and_no_rows(spark):
    got = infill.infill(table(spark, [(4, "a b c d")] * 3 + [(None, "a b c d")])).collect()
    assert len({tuple(r) for r in got}) == 2 and len(got) == 4
    assert rows_of(got)[None] == brute(None, "a b c d")
    assert infill.infill(table(spark, [])).collect() == []


def test_odd_marks_raise(spark):
    for marks in (("<P>", "<P>", "<M>"), ("aa", "<S>", "<M>"), ("", "<S>", "<M>")):
        with pytest.raises(ValueError):
            infill.infill(table(spark, []), marks=marks)
    with pytest.raises(ValueError):
        infill.infill(table(spark, []), unit="lines")
