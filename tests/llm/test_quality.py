import zlib

import pytest
from pyspark.sql import functions as F

from trapline.llm import quality

SMALL = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, score string, quality int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", "x", 0) for i, t in rows], DOCS)


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int")


@pytest.fixture(scope="module")
def scored(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    return quality.score(docs, labels).join(labels, "doc_id", "left").cache()


def test_held_out_documents_are_told_apart(scored):
    rows = [r for r in scored.collect() if r.held_out and r.quality is not None]
    assert len(rows) > 40
    right = sum(r.predicted == r.quality for r in rows) / len(rows)
    good = [r for r in rows if r.quality == 1]
    assert right > 0.95 and sum(r.predicted for r in good) / len(good) > 0.97
    bad = [r.score for r in rows if r.quality == 0]
    pairs = [(a > b.score) + 0.5 * (a == b.score) for a in [g.score for g in good] for b in
             [r for r in rows if r.quality == 0]]
    assert bad and sum(pairs) / len(pairs) > 0.97


def test_scores_and_folds(scored):
    for r in scored.collect():
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_held_out_labels_are_never_read(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    turned = labels.withColumn("quality", F.when(
        quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    runs = [sorted((r.doc_id, r.score) for r in quality.score(docs, x).collect())
            for x in (labels, turned)]
    assert runs[0] == runs[1]


def test_paths_of_a_tree():
    text = """RandomForestClassificationModel
  Tree 0 (weight 1.0):
    If (feature 2 <= 0.5)
     If (feature 0 <= 1.0E-4)
      Predict: 0.0
     Else (feature 0 > 1.0E-4)
      Predict: 1.0
    Else (feature 2 > 0.5)
     Predict: 1.0
  Tree 1 (weight 1.0):
    Predict: 0.0
"""
    assert quality.paths(text) == [
        ((2, True, 0.5),), ((0, True, 1e-4), (2, True, 0.5)), ((0, False, 1e-4), (2, True, 0.5)),
        ((2, False, 0.5),)]


def test_odd_rows(spark):
    docs = docs_of(spark, [(1, None), (2, ""), (None, "null key"), (3, "same"), (3, "same"),
                           (4, "a " * 200_000)])
    labels = labels_of(spark, [(1, 1), (2, 0), (3, 1), (3, None), (None, 1), (4, 7), (9, 0)])
    got = quality.score(docs, labels).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.predicted for r in got)


def test_no_rows_no_labels_one_class(spark):
    empty, none = docs_of(spark, []), labels_of(spark, [])
    assert quality.score(empty, none).collect() == []
    docs = docs_of(spark, [(i, f"text {i}") for i in range(20)])
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}
    good = labels_of(spark, [(i, 1) for i in range(20)])
    assert {r.predicted for r in quality.score(docs, good).collect()} == {1}
    assert quality.accepted(docs, good).count() == 20


def plain_statistics(text):
    """What ``quality.statistics`` states, without Spark."""
    import math
    import re
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    cut, lines = re.split(r"[\x20\x09-\x0D]+", text), text.split("\n")

    def share(part, whole):
        return part / whole if whole else 0.0

    def held(characters):
        return sum(text.count(c) for c in characters)

    return {
        "size": math.log1p(len(text)), "words": math.log1p(len(words)),
        "word_length": share(len(text), len(words)), "distinct_words": share(len(set(cut)), len(cut)),
        "symbols": share(held("#$%&*|<>=@^~\\_{}[]+/"), len(text)),
        "bars": share(held("|"), len(words)), "digits": share(held("0123456789"), len(text)),
        "capitals": share(sum("A" <= c <= "Z" for c in text), len(text)),
        "calls": share(held("!?"), len(words)), "stops": share(held(".,;:"), len(words)),
        "bytes": share(len(text.encode()), len(text)), "lines": share(len(lines), len(words)),
        "distinct_lines": share(len(set(lines)), len(lines))}


def test_statistics_rules_and_scores_in_plain_python(spark):
    """Every rule is applied to statistics made anew, and the weights are summed by hand."""
    import math
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    odd = docs_of(spark, [(-1, ""), (-2, None), (-3, " \t\n "), (-4, "é\n\n|x| A!"), (-5, "  a b ")])
    every = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    stats, names = quality.measured(every, "doc_id", "text")
    rules = quality.learnt(stats, names, labels)
    assert len(rules.weights) > 2
    texts = {r.doc_id: r.text or "" for r in every.collect()}
    measured = {r._key: r for r in stats.collect()}
    scores = {r.doc_id: r for r in quality.score(every, labels).collect()}
    kept = {r.doc_id for r in quality.accepted(every, labels).collect()}
    for key, text in texts.items():
        plain = plain_statistics(text)
        for name, value in plain.items():
            assert measured[key][f"_s_{name}"] == pytest.approx(value, rel=1e-12), (key, name)
        total = rules.constant
        for rule, weight in rules.weights.items():
            if all((measured[key][names[f]] <= v) == at_most for f, at_most, v in rule):
                total += weight
        assert scores[key].score == pytest.approx(1 / (1 + math.exp(-total)), rel=1e-9)
        assert scores[key].predicted == (scores[key].score >= 0.3) == (key in kept)
