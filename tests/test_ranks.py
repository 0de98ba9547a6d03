"""Ranks and quantiles against brute force, with hot groups and heavy ties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trapline import session
from trapline.operators import ranks, summaries
from trapline.session import attach, counted, heavy_keys, settle


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(5)
    rows = [("hot", float(v)) for v in rng.integers(0, 40, 3000)]
    rows += [("wide", float(v)) for v in rng.normal(size=2000)]
    rows += [(f"g{i % 20}", float(v)) for i, v in enumerate(rng.normal(size=1000))]
    rows += [("one", 3.0), ("wide", None)]
    return spark.createDataFrame(rows, "name string, value double").repartition(9)


def grouped(values):
    out = {}
    for r in values.collect():
        if r.value is not None:
            out.setdefault(r.name, []).append(r.value)
    return out


def test_quantiles(values):
    probs = {"q0": 0.0, "q25": 0.025, "q50": 0.5, "q90": 0.9, "q1": 1.0}
    got = {r["name"]: r for r in ranks.exact_quantiles(values, ["name"], "value", probs).collect()}
    for name, xs in grouped(values).items():
        want = np.quantile(xs, list(probs.values()))
        assert np.allclose([got[name][k] for k in probs], want)


@pytest.mark.parametrize("cuts,most", [(256, 1 << 17), (8, 20), (32, 4)])
def test_quantiles_by_narrowing(spark, monkeypatch, cuts, most):
    """Several passes, ties that no pass can split, values far outside, whole numbers."""
    monkeypatch.setattr(ranks, "CUTS", cuts)
    monkeypatch.setattr(ranks, "BRACKET_ROWS", most)
    rng = np.random.default_rng(7)
    named = {"far": np.concatenate([rng.normal(size=3000), [1e300, -1e300, 1e-300]]),
             "tied": np.repeat([1.0, 2.0, 3.0], [900, 1100, 500]), "same": np.full(700, 4.0),
             "even": np.arange(2000.0), "two": np.array([1.0, 5.0]), "one": np.array([9.0]),
             "signs": np.array([-0.5, 0.0, 0.5] * 300)}
    rows = spark.createDataFrame([(k, float(v)) for k, x in named.items() for v in x],
                                 "name string, value double").repartition(7)
    probs = {f"q{i}": p for i, p in enumerate((0, 0.001, 0.025, 0.25, 0.5, 0.77, 0.975, 1))}
    got = {r["name"]: r for r in ranks.exact_quantiles(rows, ["name"], "value", probs).collect()}
    for name, x in named.items():
        want = np.quantile(x, list(probs.values()))
        assert [got[name][k] for k in probs] == pytest.approx(want.tolist(), rel=1e-12), name
    whole = ranks.exact_quantiles(rows.where("name = 'even'").selectExpr("cast(value AS int) AS value"),
                                  [], "value", {"m": 0.5, "q": 0.1}).first()
    assert (whole.m, whole.q) == pytest.approx((999.5, 199.9))


def test_quantiles_move_only_what_lies_in_brackets(spark, monkeypatch):
    """No range exchange, and nothing of the size of the rows is written."""
    written = []

    def watched(df):
        out = settle(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(ranks, "settle", watched)
    rows = spark.range(200_000).selectExpr("id % 2 AS g", "cast(hash(id) AS double) AS value")
    frame = ranks.exact_quantiles(rows, ["g"], "value", {"a": 0.1, "b": 0.9})
    assert "rangepartitioning" not in frame._jdf.queryExecution().executedPlan().toString()
    assert len(frame.collect()) == 2 and max(written) <= 4


def test_ranges_are_really_split(spark, values):
    """With many small partitions a group spans several ranges and the ranks still hold."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        rows = ranks.average_ranks(ranks.value_positions(values, ["name"], "value")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    for name, xs in grouped(values).items():
        xs = np.sort(xs)
        for r in [r for r in rows if r["name"] == name][:50]:
            low = np.searchsorted(xs, r.value, "left")
            high = np.searchsorted(xs, r.value, "right")
            assert r["rank"] == (low + 1 + high) / 2 and r.total == len(xs)


def test_dense_ids_global(spark):
    rows = spark.createDataFrame([(v,) for v in [9, 2, 2, None, 40, 7]], "k bigint")
    got = {r.k: r.id for r in ranks.dense_ids(rows, [], "k", "id").collect()}
    assert got == {2: 1, 7: 2, 9: 3, 40: 4}


def test_summary_counts_nulls(values):
    row = summaries.summary_table(values, ["name"], "value").where("name = 'wide'").first()
    assert row.n_null == 1 and row.minimum <= row.q1 <= row["median"] <= row.q3 <= row.maximum


@pytest.mark.parametrize("how", ["inner", "left"])
def test_attach_beyond_the_broadcast_limit(spark, how):
    facts = spark.createDataFrame([("a" if i % 3 else f"k{i}", i) for i in range(900)],
                                  "key string, x int")
    lookup = spark.createDataFrame([("a", 1.0)] + [(f"k{i}", float(i)) for i in range(0, 600, 3)],
                                   "key string, y double")
    small = sorted(map(str, attach(facts, lookup, ["key"], how).collect()))
    large = sorted(map(str, attach(facts, lookup, ["key"], how, max_rows=5).collect()))
    assert small == large


def test_only_heavy_keys_are_broadcast_beyond_the_limit(spark):
    """Half the rows hold one key: its rows stay, no lookup row is copied for the others."""
    facts = settle(spark.range(4000).selectExpr("if(id % 2 = 0, 7L, id) AS key", "id AS x"))
    lookup = spark.range(4000).selectExpr("id AS key", "id * 2 AS y")
    assert len(heavy_keys(facts, ["key"])) == 1
    joined = attach(facts, lookup, ["key"], max_rows=5)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("BroadcastHashJoin") >= 1
    assert sorted(r.x for r in joined.where("y = key * 2").collect()) == list(range(4000))
    even = spark.range(4000).selectExpr("id AS key", "id AS x")
    assert heavy_keys(even, ["key"]) == []


def test_settled_rows_are_counted(spark):
    table, rows = counted(spark.range(1234).repartition(5))
    assert rows == 1234 == table.count()
    assert counted(spark.range(0))[1] == 0


def test_lost_events_do_not_stop_a_count(spark, monkeypatch):
    class Silent(session.Observation):
        @property
        def get(self):
            raise RuntimeError("never came")

    monkeypatch.setattr(session, "Observation", Silent)
    monkeypatch.setattr(session.threading, "excepthook", lambda _: None)
    table, seen = session.measured(spark.range(50), rows=F.count(F.lit(1)), top=F.max("id"))
    assert seen == {"rows": 50, "top": 49} and table.count() == 50
