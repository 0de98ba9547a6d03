"""Projection, distances and site vectors against known numbers."""

import pytest
from pyspark.sql import functions as F

from trapline.operators import spatial, summaries
from trapline.sources.lookups import covariate_table, effort_table, literal_table

# Traps of site A (lat, lon).
SITE_A = ((1, 39.5874442, -78.7405028), (2, 39.58752735, -78.7402547))
# Depth in letter order of the sites.
DEPTH_BY_LETTER = (0.786666667, 0.771666667, 0.433333333, 1.06, 0.843333333, 0.82, 0.498333333,
                   0.47, 0.321666667, 0.686666667, 1.22, 1.303333333)


def test_projection_of_the_first_trap(spark):
    traps = literal_table(spark, ("trap_id", "lat", "lon"), SITE_A).withColumn(
        "site_num", F.lit(2))
    rows = spatial.distance_to_first(spatial.to_utm(traps)).orderBy("trap_id").collect()
    assert rows[0].easting == pytest.approx(694035.237, abs=1e-3)
    assert rows[0].northing == pytest.approx(4384407.999, abs=1e-3)
    assert rows[0].distance == 0.0 and 20 < rows[1].distance < 30


def test_state_space_has_the_buffer(spark):
    rows = spark.createDataFrame([(1, 0.0), (1, 155.046)], "site_num int, distance double")
    row = spatial.state_space(rows).first()
    assert (row.xlim1, row.xlim2) == (-10.0, pytest.approx(11.55046))


def test_letter_order_becomes_site_order(spark):
    vector = literal_table(spark, ("row_key", "depth"), tuple(enumerate(DEPTH_BY_LETTER, 1)))
    sites = effort_table(spark).select("site", "site_num")
    got = {r.site_num: r.depth for r in spatial.spatial_reorder(vector, sites).collect()}
    want = {r.site_num: r.depth for r in covariate_table(spark).collect()}
    assert got == want


def test_trap_blocks_are_contiguous(spark):
    rows = summaries.trap_blocks(effort_table(spark)).orderBy("site").collect()
    assert (rows[0].first_trap, rows[0].last_trap) == (1, 8)
    assert all(b.first_trap == a.last_trap + 1 for a, b in zip(rows, rows[1:]))
    assert rows[-1].last_trap == 116


def test_standardize_uses_n_minus_one(spark):
    table = covariate_table(spark)
    stats = table.agg(F.avg("forest"), F.stddev_samp("forest"), F.avg("depth"),
                      F.stddev_samp("depth"), F.avg("width_m"), F.stddev_samp("width_m")).first()
    assert list(stats) == pytest.approx([0.5058422859, 0.1677517201, 0.7679166667, 0.3110459099,
                                         19.9775, 9.3162615649])
    scaled = summaries.standardize(table, ["forest"])
    assert scaled.agg(F.avg("forest_std")).first()[0] == pytest.approx(0, abs=1e-12)
    assert scaled.agg(F.stddev_samp("forest_std")).first()[0] == pytest.approx(1)
