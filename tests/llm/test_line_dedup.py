import random

import pytest

from tests.llm import brute
from trapline.llm import line_dedup

SCHEMA = "doc_id long, text string, n_lines string, place long, _row int, line int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t in rows], SCHEMA)


def corpus(seed, docs=40):
    rng = random.Random(seed)
    lines = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.choice([1, 2, 3, 9])))
             for _ in range(60)]
    runs = [rng.choices(lines, k=rng.randint(2, 9)) for _ in range(6)]
    rows = []
    for i in range(docs):
        text = []
        for _ in range(rng.randint(0, 4)):
            text += rng.choice(runs)[rng.randint(0, 2):] if rng.random() < 0.6 else [
                f"own {i} {rng.random()}"]
            if rng.random() < 0.3:
                text.append(rng.choice(["", "  ", "\t"]))
        rows.append((i, "\n".join(text)))
    return rows


def kept_words(text, gone, d):
    return [line for i, line in enumerate(text.split("\n"))
            if line.encode().split() and (d, i) not in gone]


@pytest.mark.parametrize("seed,least", [(1, 5), (2, 12), (3, 20)])
def test_against_all_pairs_of_places(spark, seed, least):
    rows = corpus(seed)
    gone = brute.deleted_lines([t for _, t in rows], least)
    assert gone
    got = line_dedup.dedup(table(spark, rows).repartition(3), min_words=least).collect()
    for r in got:
        text = rows[r.doc_id][1]
        assert [x for x in r.text.split("\n") if x.encode().split()] == kept_words(
            text, gone, r.doc_id)
        real = sum(bool(x.encode().split()) for x in text.split("\n"))
        assert (r.n_lines, r.n_removed) == (real, sum(d == r.doc_id for d, _ in gone))
        if not r.n_removed:
            assert r.text == text


def test_blank_lines_go_between_deleted_ones_only(spark):
    run = "a b c\n\nd e f"
    rows = [(1, run), (2, f"x\n\n{run}\n\ny"), (3, run)]
    got = {r.doc_id: r.text for r in line_dedup.dedup(table(spark, rows), min_words=6).collect()}
    assert got == {1: run, 2: "x\n\n\ny", 3: ""}


def test_a_run_inside_one_document(spark):
    rows = [(1, "a b\nc d\nq\na b\nc d")]
    got = line_dedup.dedup(table(spark, rows), min_words=4).first()
    assert (got.text, got.n_lines, got.n_removed) == ("a b\nc d\nq", 5, 2)


def test_short_runs_stay(spark):
    rows = [(1, "license line\none"), (2, "license line\ntwo")]
    assert {r.n_removed for r in line_dedup.dedup(table(spark, rows)).collect()} == {0}


def test_odd_rows(spark):
    long = "\n".join(f"line {i} of a long text" for i in range(20_000))
    rows = [(5, None), (6, ""), (7, "\n \n"), (None, long), (2, long), (2, long), (8, "w " * 90),
            (9, "w " * 90)]
    got = sorted(((str(r.doc_id), r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup(
        table(spark, rows)).collect()), key=str)
    assert got == sorted([("5", None, 0, 0), ("6", "", 0, 0), ("7", "\n \n", 0, 0),
                          ("None", long, 20_000, 0), ("2", "", 20_000, 20_000),
                          ("2", "", 20_000, 20_000), ("8", "w " * 90, 1, 0), ("9", "", 1, 1)],
                         key=str)


def test_no_rows(spark):
    got = line_dedup.dedup(table(spark, []))
    assert got.collect() == []
    assert got.columns == ["doc_id", "text", "place", "_row", "line", "n_lines", "n_removed"]
