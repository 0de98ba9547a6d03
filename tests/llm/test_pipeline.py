import corpus_pipeline
import numpy as np
import public_tokenizers as public
import pytest
import tiktoken
from pyspark.sql import functions as F

from tests.llm import brute
from trapline.llm import bpe, common, mixing, quality

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, _row string"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = common.settle(stage(spark, docs, SMALL))
        out.append(docs)
    return out


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_return_the_columns_of_documents(spark, steps):
    want = spark.read.parquet(f"{SMALL}/documents.parquet").columns
    assert [s.columns for s in steps[:-1]] == [want] * 4
    assert steps[-1].columns == ["doc_id", "n_tokens", "ids"]


def test_quality_goes_by_the_classifier(spark, steps):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    scores = quality.score(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    assert set(rows_of(steps[0])) == {r.doc_id for r in scores.where("predicted = 1").collect()}


def test_line_copies_go(steps):
    before = sorted(rows_of(steps[0]).values(), key=lambda r: r.doc_id)
    gone, after = brute.deleted_lines([r.text for r in before], 50), rows_of(steps[1])
    for d, r in enumerate(before):
        kept = [line for i, line in enumerate(r.text.split("\n"))
                if line.encode().split() and (d, i) not in gone]
        if kept or not r.text.split():
            assert [x for x in after[r.doc_id].text.split("\n") if x.encode().split()] == kept
        else:
            assert r.doc_id not in after


def test_one_of_each_group_stays(steps):
    texts = {i: r.text for i, r in rows_of(steps[1]).items()}
    _, roots = brute.jaccard_links(texts, 5, (80, 100))
    assert set(rows_of(steps[2])) == set(roots.values())


def test_the_mix_is_emitted(steps):
    want = {r.doc_id: r.copies for r in mixing.mix(steps[2]).collect() if r.copies}
    got = {r.doc_id: r["count"] for r in steps[3].groupBy("doc_id").count().collect()}
    assert got == want


def test_encoding(steps):
    known = tiktoken.Encoding(
        "own", pat_str=public.PATTERN, special_tokens={},
        mergeable_ranks=bpe.read_ranks(public.path("byte_bpe_50k.tiktoken")))
    texts = rows_of(steps[3])
    for r in steps[4].collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == known.encode_ordinary(
            texts[r.doc_id].text)


@pytest.mark.parametrize("rows", [[], [
    (1, None, None, None, None, "x"), (2, "", "en", None, 0, None), (3, "a b", "en", "s", 3, "x"),
    (3, "a b", "en", "s", 3, "x"), (None, "c d e", None, "s", 5, "x"),
    (4, "word " * 50_000, "en", "t", 250_000, "x")]])
def test_odd_rows(spark, rows):
    docs = spark.createDataFrame(rows, DOCS)
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, docs, SMALL)
        if name == "encoding":
            assert result.count() == docs.count()
        else:
            assert result.columns == docs.columns
            docs = common.settle(result)


def test_n_chars_follows_the_text(steps):
    assert steps[1].where(F.col("n_chars") != F.length("text")).count() == 0


def test_scratch_of_earlier_stages_goes(spark, tmp_path):
    with common.recorded() as made:
        table = common.settle(spark.range(3))
    assert table.count() == 3 and len(made) == 1
    common.remove(spark, made)
    store, path = common.open_store(made[0])
    assert store.get_file_info(path).type.name == "NotFound"


def test_near_copies_go_by_row(spark):
    """Rows that share a key but not a text, and near copies without a key."""
    text = {c: " ".join(f"{c}{i}" for i in range(60)) for c in "abcd"}
    rows = [(1, text["a"]), (2, text["a"] + " end"), (2, text["b"]), (2, text["c"]),
            (3, text["b"]), (None, text["d"]), (None, text["d"] + " end"), (None, text["c"]),
            (4, ""), (4, ""), (5, ""), (None, ""), (None, ""), (4, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "x") for i, t in rows], DOCS)
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.without_near_copies(
        spark, docs.repartition(3), SMALL).collect()), key=repr)
    ends = [t for i, t in got if i is None and t]
    assert len(ends) == 1 and ends[0].startswith(text["d"])
    assert [r for r in got if r != (None, ends[0])] == sorted([
        (1, text["a"]), (2, text["b"]), (2, text["c"]), (4, ""), (4, None), (5, ""),
        (None, ""), (None, "")], key=repr)


CLASHING = ["_s_words", "_s_word_length", "n_lines", "n_removed", "_row", "_lines", "_removed",
            "size", "copies", "target", "_n", "_key", "_text", "_whole", "score", "_order", "_tie",
            "n_shingles", "component_id", "_draw", "_hash", "_"]


def test_no_stage_overwrites_a_further_column(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs = docs.select("*", *[F.concat(F.lit(f"{c}="), F.col("doc_id").cast("string")).alias(c)
                              for c in CLASHING])
    plain = common.settle(docs)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain = common.settle(stage(spark, plain, SMALL))
        assert plain.columns == docs.columns, name
        rows = plain.select("doc_id", *CLASHING).collect()
        assert rows, name
        for r in rows:
            assert [r[c] for c in CLASHING] == [f"{c}={r.doc_id}" for c in CLASHING], name
