"""Hand-made capture logs with known histories."""

import pytest
from pyspark.sql import functions as F

from trapline.operators import filters, histories, starts, summaries
from trapline.sources.lookups import literal_table

LOG = "site string, site_num int, species string, ind bigint, sex string, day int, trap int"


@pytest.fixture(scope="module")
def effort(spark):
    return literal_table(spark, ("site", "site_num", "max_traps"), (("A", 1, 2), ("B", 2, 3)))


@pytest.fixture(scope="module")
def caps(spark):
    return literal_table(spark, ("species", "cap"), (("CPIC", 7000),))


def log(spark, rows):
    full = [("AB"[s - 1], s, "CPIC", i, x, d, t) for s, i, x, d, t in rows]
    return spark.createDataFrame(full, LOG)


def prepared(spark, effort, caps, rows):
    numbered = histories.numbered_counts(log(spark, rows))
    return numbered, histories.all_histories(numbered, effort, caps)


def test_flags_after_first_capture(spark, effort, caps):
    _, held = prepared(spark, effort, caps, [(1, 5, "M", 1, 1), (1, 5, "M", 3, 2),
                                             (1, 9, "F", 4, 1)])
    rows = histories.recapture_flags(held).orderBy("id_site", "day").collect()
    assert [r.recap for r in rows] == [0, 1, 1, 1, 0, 0, 0, 0]


def test_unknown_individual_gets_no_number(spark, effort, caps):
    numbered, held = prepared(spark, effort, caps, [(1, None, "M", 1, 1), (1, 9, "M", 1, 1),
                                                    (1, 5, "F", 2, 1)])
    ids = {r.ind: r.id_site for r in numbered.collect()}
    assert ids == {None: None, 5: 1, 9: 2}
    rows = histories.complete_history(held).where("site_num = 1 AND ind IS NULL")
    seen = {(r.trap, r.day): r["count"] for r in rows.collect()}
    assert len(seen) == 56 and seen[(1, 1)] == 1
    assert sum(v is None for v in seen.values()) == 55


def test_site_without_captures(spark, effort, caps):
    numbered, held = prepared(spark, effort, caps, [(1, 5, "M", 1, 1)])
    per_site = histories.individuals_per_site(numbered, effort, caps)
    sizes = {r.site_num: (r.n, r.m_raw, r.m) for r in
             histories.augmentation_size(per_site).collect()}
    assert sizes == {1: (1, 110.0, 110), 2: (0, 500.0, 500)}
    assert histories.observed_history(held).where("site_num = 2").count() == 0


def test_two_sexes_make_one_cell(spark, effort, caps):
    numbered, held = prepared(spark, effort, caps, [(1, 5, "M", 1, 1), (1, 5, "F", 1, 1)])
    cells = histories.observed_history(held).where("count > 0").collect()
    assert [(r.trap, r.day, r["count"]) for r in cells] == [(1, 1, 2)]
    assert histories.first_sex(numbered).first().sex is None
    centre = histories.observed_activity_centres(held).first().loc
    assert centre == 0.0


def test_fully_used_site_has_no_placeholder(spark, effort, caps):
    rows = [(1, 5, "M", d, t) for d in range(1, 5) for t in (1, 2)]
    numbered, _ = prepared(spark, effort, caps, rows)
    left = histories.placeholders(numbered, effort, caps).collect()
    assert [r.site_num for r in left] == [2]


def test_captures_off_the_traps_of_a_site_are_kept(spark, effort, caps):
    """Site 1 has two traps. One individual was caught at trap 9 only, another at 2 and 9."""
    numbered, held = prepared(spark, effort, caps, [(1, 5, "M", 1, 9), (1, 6, "F", 2, 2),
                                                    (1, 6, "F", 3, 9)])
    per_site = histories.individuals_per_site(numbered, effort, caps)
    assert {r.site_num: r.n for r in per_site.collect()} == {1: 2, 2: 0}
    cells = histories.complete_history(held).where("count > 0").orderBy("ind", "trap").collect()
    assert [(r.ind, r.trap, r.day) for r in cells] == [(5, 9, 1), (6, 2, 2), (6, 9, 3)]
    assert held.where("id_site IS NOT NULL").count() == 2
    assert histories.captures_by_day(held).agg(F.sum("caps")).first()[0] == 3
    off = histories.off_range(numbered, effort).orderBy("ind").collect()
    assert [(r.ind, r.trap) for r in off] == [(5, 9), (6, 9)]
    # all trap-days but one of site 1 caught nothing, so its placeholder stays, once
    left = histories.placeholders(numbered, effort, caps).orderBy("site_num").collect()
    assert [r.site_num for r in left] == [1, 2]


def test_counts_are_null_zero_or_more(spark, effort, caps):
    _, held = prepared(spark, effort, caps, [(1, 5, "M", 1, 1), (1, 5, "M", 1, 1)])
    cells = {(r.trap, r.day): r["count"] for r in histories.complete_history(held).where(
        "ind = 5").collect()}
    assert cells[(1, 1)] == 2 and cells[(2, 4)] == 0 and cells[(3, 1)] is None


def test_very_often_caught_individual(spark, effort, caps):
    """A third of the log is one individual; the rest are spread."""
    rows = [(1, 1, "M", 1 + i % 4, 1 + i % 2) for i in range(1000)]
    rows += [(2, 2 + i % 500, "F", 1 + i % 4, 1 + i % 3) for i in range(2000)]
    numbered, held = prepared(spark, effort, caps, rows)
    total = histories.captures_by_day(held).agg(F.sum("caps")).first()[0]
    assert total == 3000
    assert numbered.agg(F.max("id_site")).first()[0] == 500
    assert held.where("ind = 1").count() == 1


def test_order_of_rows_and_partitions_does_not_matter(spark, effort, caps):
    rows = [(1 + i % 2, i * 7 % 90, "MF"[i % 2], 1 + i % 4, 1 + i % 2) for i in range(400)]

    def run(data, parts):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        counted = histories.numbered_counts(log(spark, data).repartition(parts))
        held = histories.all_histories(counted, effort, caps)
        return sorted(map(str, histories.complete_history(held).collect()))

    try:
        assert run(rows, 3) == run(rows[::-1], 7)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_filters_keep_three_valued_logic(spark):
    rows = [("A", 1, "CSER", 70, "M", 1, 1), ("A", 1, "CSER", None, "M", 1, 1),
            ("A", 1, "CPIC", None, "M", 1, 1), ("H", None, "CPIC", 3, "M", 1, 1),
            ("A", 1, "CPIC", 4, "U", 1, 1), ("A", 1, "CPIC", 5, None, 1, 1)]
    kept = filters.model_captures(spark.createDataFrame(rows, LOG)).collect()
    assert [(r.species, r.ind) for r in kept] == [("CPIC", None)]


def test_mean_is_null_with_a_missing_measurement(spark):
    rows = spark.createDataFrame(
        [(1, "A", 5, "CPIC", "M", 10.0, None, 1), (1, "A", 5, "CPIC", "M", 20.0, 3.0, 2)],
        "site_num int, site string, ind bigint, species string, sex string, carapace double, "
        "mass double, trap int")
    row = histories.individual_covariates(rows).first()
    assert (row.carapace, row.mass, row.n_measurements, row.mean_trap) == (15.0, None, 2, 1.5)


def test_strict_maximum(spark):
    rows = spark.createDataFrame([(1,), (None,)], "day int")
    assert summaries.maximum(rows, "day").first()[0] == 1
    assert summaries.maximum(rows, "day", strict=True).first()[0] is None


def test_start_values_do_not_depend_on_partitions(spark, effort, caps):
    numbered, held = prepared(spark, effort, caps, [(1, 5, "M", 1, 1)])
    sizes = histories.augmentation_size(histories.individuals_per_site(numbered, effort, caps))
    once = sorted(map(str, starts.init_membership(sizes).collect()))
    again = sorted(map(str, starts.init_membership(sizes.repartition(5)).collect()))
    assert once == again and len(once) == 610
    share = starts.init_membership(sizes, 0.2).where("site_num = 2").agg(F.avg("z")).first()[0]
    assert 0.14 < share < 0.26
    s = starts.init_activity_centres(sizes, histories.observed_activity_centres(held))
    low, high = s.agg(F.min("s"), F.max("s")).first()
    assert -1.5 <= low and high <= 1.75


def test_expansion_of_the_larger_tables(spark):
    """Known sizes: rows are 15 traps times 5 days for each individual and each site with an unused
    trap-day, as the log has a trap 15 and a day 5."""
    from trapline.plans.inputs import Inputs
    t = Inputs(spark, "/root/testdata/sf0.01")
    rows = histories.complete_history(t.histories).groupBy("species").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("count").alias("caught"),
        F.count_if(F.col("count").isNull()).alias("missing"))
    got = {r.species: (r.rows, r.caught, r.missing) for r in rows.collect()}
    assert got["CPIC"] == (3075, 1888, 1757) and got["SODO"] == (3075, 1944, 1514)
    wide = histories.history_wide(t.known).groupBy("species").count().collect()
    assert {r["count"] for r in wide if r.species in ("CPIC", "SODO")} == {145}


@pytest.fixture(scope="module")
def wide(spark):
    """Site A has 2 traps: one individual beyond them at trap 1015, one on days 1 and 5, one at
    trap 1 on day 1001, one in plain sight."""
    effort = literal_table(spark, ("site", "site_num", "max_traps"), (("A", 1, 2),))
    caps = literal_table(spark, ("species", "cap"), (("CPIC", 7000),))
    numbered, held = prepared(spark, effort, caps, [
        (1, 3, "M", 2, 1015), (1, 4, "F", 1, 1), (1, 4, "F", 5, 2), (1, 5, "M", 1001, 1),
        (1, 6, "M", 1, 2)])
    return effort, numbered, held


def test_no_capture_is_lost_whatever_its_trap_and_day(wide):
    effort, numbered, held = wide
    assert histories.widths(effort, numbered) == histories.Widths(1015, 1001)
    want = {(3, 1015, 2), (4, 1, 1), (4, 2, 5), (5, 1, 1001), (6, 2, 1)}
    cells = histories.complete_history(held).where("count > 0").collect()
    assert {(r.ind, r.trap, r.day) for r in cells} == want and len(cells) == 5
    assert {(r.ind, r.trap, r.day) for r in (histories.caught_cells(held).collect())} == {
        (i, t, d) for i, t, d in want}
    days = {r.day: r.caps for r in histories.captures_by_day(held).collect()}
    assert len(days) == 1001 and {d: n for d, n in days.items() if n} == {1: 2, 2: 1, 5: 1, 1001: 1}
    daily = histories.daily_captures(held).where("captures > 0").collect()
    assert sorted((r.ind, r.day) for r in daily) == [(3, 2), (4, 1), (4, 5), (5, 1001), (6, 1)]


def test_wide_forms_are_as_wide_as_the_log(spark, wide):
    effort, numbered, held = wide
    narrow = histories.history_wide(held.where("ind in (4, 6)"), n_traps=15)
    assert narrow.columns[-1] == "trap_15" and narrow.count() == 2 * 5
    flags = histories.recaptures_wide(held.where("ind in (4, 6)")).orderBy("id_site").collect()
    assert [list(r)[3:] for r in flags] == [[0, 1, 1, 1, 1], [0, 1, 1, 1, 1]]
    slab = histories.capture_array(held.where("ind = 4"), n_traps=15).first().slab
    assert len(slab) == 5 and slab[4][1] == 1 and sum(x or 0 for row in slab for x in row) == 2
    rows = spark.createDataFrame([("F", 1, "SODO", 7, "M", 1, 16)], LOG)
    assert summaries.spatial_recaptures(rows, "SODO").first().trap_16 == 1
    padded = starts.padded_history(
        spark.createDataFrame([("CPIC", 1, 1, 2, 2)], "species string, site_num int, n int, m int, "
                              "max_traps int"),
        spark.createDataFrame([("CPIC", 1, 1, 6, 1)], "species string, site_num int, id_site int, "
                              "day int, recap int"), zero=True, traps=False)
    assert padded.count() == 12 and padded.agg(F.sum("recap")).first()[0] == 1
