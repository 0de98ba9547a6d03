import numpy as np
import pytest
from pyspark.sql import functions as F

from trapline.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, _id int, score long, rank string"


def table(spark, rows):
    return spark.createDataFrame([(i, e, 1, 2, 3, "r") for i, e in rows], SCHEMA)


def brute(rows, k, every):
    whole = [(i, [int(np.floor(256 * np.float64(np.float32(x)))) for x in e]) for i, e in rows]
    out = []
    for q, e in whole:
        if q % every == 0:
            found = sorted((-sum(a * b for a, b in zip(e, f)), i) for i, f in whole
                           if i != q and len(e) == len(f))
            out += [(q, r, i, -s) for r, (s, i) in enumerate(found[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_against_all_pairs(spark, monkeypatch, small):
    if small:  # several blocks, passes, shards and levels of the tree
        for name, value in (("SHARD_ROWS", 8), ("BLOCK_ROWS", 3), ("CELL_SHARDS", 2), ("CELL_BLOCKS", 2),
                            ("FAN", 2)):
            monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(2)
    rows = [(i, np.round(rng.standard_normal(8), 1).tolist()) for i in range(150)]
    got = topk.search(table(spark, rows), F.col("vec_id") % 10 == 0, 5)
    assert sorted(map(tuple, got.collect())) == brute(rows, 5, 10)


def test_the_plan_does_not_grow_with_the_queries(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 2)
    rows = [(i, [float(i % 7), 1.0]) for i in range(400)]
    plans = [topk.search(table(spark, rows), F.col("vec_id") % every == 0)._jdf.queryExecution()
             .optimizedPlan().toString() for every in (200, 2)]
    assert plans[0].count("\n") == plans[1].count("\n")
    assert all(p.count("FlatMapCoGroups") == 1 and p.count("Union") == 0 for p in plans)


def test_ties_and_few_candidates(spark):
    rows = [(0, [1.0, 0.0]), (5, [0.5, 0.0]), (3, [0.5, 1.0]), (4, [0.25, 0.0])]
    got = topk.search(table(spark, rows), F.col("vec_id") == 0, 5).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(3, 32768), (5, 32768), (4, 16384)]


def test_odd_vectors_take_no_part(spark):
    rows = [(0, [1.0, 1.0]), (1, None), (2, []), (3, [1.0, None]), (4, [float("nan"), 1.0]),
            (5, [float("inf"), 1.0]), (None, [1.0, 1.0]), (6, [-0.001, 0.5]), (7, [1.0] * 3),
            (50, [0.0, 0.0])]
    got = topk.search(table(spark, rows), F.col("vec_id") % 50 == 0, 5).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 6, 127 * 256), (0, 2, 50, 0), (50, 1, 0, 0),
                                       (50, 2, 6, 0)]


def test_repeated_rows(spark):
    rows = [(0, [1.0, 0.0])] * 2 + [(1, [1.0, 0.0])] * 2
    got = topk.search(table(spark, rows), F.col("vec_id") == 0, 5).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 1, 65536), (0, 2, 1, 65536)]


def test_large_components_are_exact(spark):
    rows = [(0, [2.0 ** 20, 1.0]), (1, [2.0 ** 20, 0.5]), (2, [2.0 ** 20, 0.25])]
    got = topk.search(table(spark, rows), F.col("vec_id") == 0, 5).collect()
    assert [(r.vec_id, r.score) for r in got] == [
        (1, 2 ** 56 + 2 ** 15), (2, 2 ** 56 + 2 ** 14)]


def test_no_rows(spark):
    got = topk.search(table(spark, []), F.col("vec_id") % 50 == 0)
    assert got.collect() == [] and got.columns == ["query_id", "rank", "vec_id", "score"]
