import zlib

import pytest
from pyspark.sql import functions as F

from trapline.llm import sharding

SCHEMA = "doc_id long, text string, size int, shard int, _n int, _tie long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in rows], SCHEMA)


@pytest.mark.parametrize("n", [1, 2, 3, 97, 1009, 1024, 10007])
def test_permutation(spark, n):
    rows = spark.range(n).select("id", sharding.permuted(F.col("id"), n, 7).alias("p")).collect()
    assert sorted(r.p for r in rows) == list(range(n))
    if n > 1000:
        assert sum(abs(r.p - r.id) < n / 100 for r in rows) < n / 20


def test_surplus_bounds_the_walk():
    for n in (1, 2, 7, 1009, 10007, 10 ** 9 + 7):
        a, b, surplus = sharding.grid(n)
        assert a * b - surplus == n and surplus < a <= b + 1


def test_shards_are_even_and_gapless(spark):
    rows = [(i * 3, "x" * (i % 50)) for i in range(1009)]
    got = sharding.assign(table(spark, rows), 24).collect()
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert sorted(slots) == list(range(24))
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_reruns_and_partitions_agree(spark):
    docs = table(spark, [(i, f"t{i}") for i in range(200)])
    runs = [sorted(map(tuple, sharding.assign(docs.repartition(k), 5).collect())) for k in (2, 7)]
    assert runs[0] == runs[1]


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "é"), (3, "x" * 10 ** 6)] + [(4, "same")] * 3
    got = sharding.assign(table(spark, rows), 24).collect()
    assert len({(r.shard, r.slot) for r in got}) == 7
    facts = {r.doc_id: (r.size, r.text_crc32, r.law) for r in got}
    assert facts[1] == facts[2] == (8, 0, "rows") and facts[3][0] == 10 ** 6 + 8
    assert facts[None] == (10, zlib.crc32("é".encode()), "rows")


def test_no_rows(spark):
    assert sharding.assign(table(spark, []), 24).collect() == []


def test_plan_runs_no_python(spark):
    plan = sharding.assign(table(spark, [(1, "a")]), 24)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
