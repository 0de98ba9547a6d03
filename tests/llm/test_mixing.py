import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from trapline.llm import mixing

SCHEMA = "doc_id long, text string, source string, size int, _class string, copies int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "x", 2) for i, t, s in rows], SCHEMA)


def corpus(n=600):
    sources = ["b", "a", "é", "Z", None, "a"]
    return [(i, " ".join(["w"] * (1 + i * 37 % 90)) + "　x", sources[i % 6 if i % 3 else 0])
            for i in range(n)]


def test_targets_follow_the_rule(spark):
    rows = mixing.mix(table(spark, corpus())).collect()
    sizes = {r.source: r.source_size for r in rows}
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    want = brute.water_fill([sizes[s] for s in names],
                            [(5, 2, 1)[i % 3] for i in range(len(names))], 3)
    got = {r.source: r.target for r in rows}
    assert [got[s] for s in names] == pytest.approx(want)
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_words_taken_come_near_the_targets(spark):
    rows = mixing.mix(table(spark, corpus())).collect()
    assert all(0 <= r.copies <= 3 for r in rows)
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        taken = sum(r.size * r.copies for r in own)
        assert taken == pytest.approx(own[0].target, abs=3 * 90)


def test_a_small_source_is_used_three_times(spark):
    rows = [(0, "only three words", "a")] + [(i, "w " * 50, "b") for i in range(1, 60)]
    got = {r.doc_id: r for r in mixing.mix(table(spark, rows)).collect()}
    assert got[0].copies == 3 and got[0].target == 9.0
    emitted = mixing.emitted(table(spark, rows))
    assert emitted.columns == table(spark, rows).columns
    assert emitted.where("doc_id = 0").count() == 3
    assert emitted.count() == sum(r.copies for r in got.values())


def test_reruns_and_partitions_agree(spark):
    docs = table(spark, corpus(300))
    runs = [sorted(map(str, mixing.mix(docs.repartition(k)).collect())) for k in (2, 5)]
    assert runs[0] == runs[1]


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (None, "one two", "a"), (3, "x", None), (3, "x", None),
            (4, " \t\n", "empty")]
    got = mixing.mix(table(spark, rows)).collect()
    assert len(got) == 6 and sum(r.size for r in got) == 4
    assert {r.target for r in got if r.source == "empty"} == {0.0}
    assert mixing.emitted(table(spark, rows)).columns[:3] == ["doc_id", "text", "source"]


def test_no_rows_and_no_words(spark):
    assert mixing.mix(table(spark, [])).collect() == []
    assert mixing.emitted(table(spark, [])).collect() == []
    got = mixing.mix(table(spark, [(1, None, "a"), (2, "", None)])).collect()
    assert {(r.target, r.copies) for r in got} == {(0.0, 0)}


def test_plan_runs_no_python(spark):
    plan = mixing.mix(table(spark, corpus(10)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_long_text(spark):
    got = mixing.mix(table(spark, [(1, "word " * 200_000, "a"), (2, "b", "b")]))
    assert got.agg(F.max("size")).first()[0] == 200_000
