import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from trapline.llm import embedding_dedup

SCHEMA = "vec_id long, embedding array<double>, label int, id long, cell string, _g int"


def table(spark, rows):
    return spark.createDataFrame([(i, e, x, 7, "x", None) for i, e, x in rows], SCHEMA)


def results(df):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in df.collect()}


def expected(rows):
    sound = {i: (e, x) for i, e, x in rows if x is not None and e and None not in e
             and all(np.isfinite(e)) and any(e)}

    def linked(a, b):
        (e, x), (f, y) = sound[a], sound[b]
        return x == y and len(e) == len(f) and brute.cosine(e, f) >= 0.98

    roots = brute.groups(sorted(sound), linked)
    links = {i: sum(linked(i, j) for j in sound if i != j) for i in sound}
    return {i: (links.get(i, 0), roots.get(i, i), roots.get(i, i) == i) for i, _, _ in rows}


def test_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(60):
        base = rng.standard_normal(24)
        for k in range(rng.integers(1, 5)):
            noise = rng.standard_normal(24) * np.linalg.norm(base) / 5
            rows.append((len(rows), (base + noise * rng.choice([0.0, 0.1, 0.2, 0.25])).tolist(),
                         i % 2))
    near = [brute.cosine(a[1], b[1]) for a in rows for b in rows if a[0] < b[0]]
    assert sum(0.97 < c < 0.99 for c in near) > 5
    assert results(embedding_dedup.dedup(table(spark, rows))) == expected(rows)


def test_odd_vectors_link_with_nothing(spark):
    one = [1.0, 2.0, 3.0]
    rows = [(1, one, 0), (2, one, None), (3, None, 0), (4, [], 0), (5, [0.0] * 3, 0),
            (6, [1.0, None, 3.0], 0), (7, [1.0, float("nan"), 3.0], 0),
            (8, [1.0, float("inf"), 3.0], 0), (9, [2.0, 4.0, 6.0], 0), (10, one, 1),
            (11, [1.0, 2.0], 0), (12, [1e200, 2e200, 3e200], 0)]
    got = results(embedding_dedup.dedup(table(spark, rows)))
    assert got[1] == (2, 1, True) and got[9] == (2, 1, False) and got[12] == (2, 1, False)
    assert all(got[i] == (0, i, True) for i in (2, 3, 4, 5, 6, 7, 8, 10, 11))


def test_repeated_rows_and_null_keys(spark):
    rows = [(4, [1.0, 0.0], 0)] * 3 + [(None, [1.0, 0.0], 0), (9, [0.0, 1.0], 0)]
    got = sorted(map(tuple, embedding_dedup.dedup(table(spark, rows)).collect()), key=str)
    assert got == sorted([(4, 3, 4, True)] * 3 + [(None, 3, 4, False), (9, 0, 9, True)], key=str)


def test_no_rows(spark):
    df = embedding_dedup.dedup(table(spark, []))
    assert df.collect() == [] and df.columns == ["vec_id", "n_links", "component_id", "kept"]


def test_a_large_group_is_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(1)
    base = rng.standard_normal(16)
    rows = [(i, (base + 0.02 * rng.standard_normal(16)).tolist(), 0) for i in range(90)]
    got = results(embedding_dedup.dedup(table(spark, rows)))
    assert got == expected(rows) and got[5][0] == 89


def test_collisions_are_those_of_all_windows(monkeypatch):
    """Against comparing every pair on every direction, whatever the slices."""
    rng = np.random.default_rng(6)
    x, y = rng.standard_normal((70, 32)), rng.standard_normal((50, 32))
    y[:30] = x[:30] + 0.05 * rng.standard_normal((30, 32))
    for size in (1, 7, 256):
        monkeypatch.setattr(embedding_dedup, "SLICE_ROWS", size)
        for window, needed in ((0.05, 15), (0.1, 25), (1.0, 16), (5.0, 32)):
            hits = (np.abs(x[:, None] - y[None]) <= window).sum(axis=2)
            want = set(zip(*np.nonzero(hits >= needed)))
            got = [(a, b) for one, two in embedding_dedup.colliding(x, y, window, needed)
                   for a, b in zip(one.tolist(), two.tolist())]
            assert len(got) == len(set(got)) and set(got) == want


def test_a_group_gives_a_row_for_each_vector_and_not_for_each_link(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", 40)
    rng = np.random.default_rng(3)
    base = rng.standard_normal(16)
    rows = spark.createDataFrame([(i, 0, (base + 0.01 * rng.standard_normal(16)).tolist(), 1 + i % 2)
                                  for i in range(120)],
                                 "_g long, _label int, _vector array<double>, _copies long")
    found = embedding_dedup.linked(rows, 0.98)
    blocks = 120 // 40 + 1
    assert found.count() <= 120 * blocks * 8
    others = {r.id: r.o for r in found.groupBy("id").agg(F.sum("others").alias("o")).collect()}
    assert others == {i: 180 - (1 + i % 2) for i in range(120)}


def test_count_is_calibrated():
    rng = np.random.default_rng(5)
    dim, cosine, trials = 64, 0.98, 100_000
    onto = embedding_dedup.directions(dim)
    a = rng.standard_normal((trials, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((trials, dim))
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    b = cosine * a + np.sqrt(1 - cosine ** 2) * b
    window = embedding_dedup.WINDOW * embedding_dedup.deviation(cosine, dim)
    hits = (np.abs((a - b) @ onto) <= window).sum(axis=1)
    assert (hits >= embedding_dedup.collisions_needed()).mean() >= 1 - embedding_dedup.MISSED
    assert embedding_dedup.collisions_needed() == pytest.approx(20, abs=2)


def test_routes_meet_pairs_at_the_limit():
    """Of random pairs just at the limit, next to none has a difference beyond a route's window."""
    rng = np.random.default_rng(8)
    for dim in (32, 128):
        x = rng.standard_normal((50_000, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        y = rng.standard_normal((50_000, dim))
        y -= (x * y).sum(axis=1, keepdims=True) * x
        y /= np.linalg.norm(y, axis=1, keepdims=True)
        apart = (0.98 - 1) * x + (1 - 0.98 ** 2) ** 0.5 * y
        far = np.abs(apart @ embedding_dedup.directions(dim)[:, :embedding_dedup.ROUTES]) > (
            embedding_dedup.ROUTE_WINDOW * embedding_dedup.deviation(0.98, dim))
        assert far.any(axis=1).mean() < embedding_dedup.MISSED
