"""Queries over trap places and site covariates."""

from __future__ import annotations

from pyspark.sql import functions as F

from trapline.operators import ranks, spatial, summaries
from trapline.plans.inputs import Inputs
from trapline.plans.registry import query


@query("projected_traps", "utm", "SELECT * FROM utm", "easting northing", 3)
def projected_traps(t: Inputs):
    return spatial.to_utm(t.traps)


@query("first_traps", "distances", """
    SELECT DISTINCT site_num, fe AS first_easting, fn AS first_northing FROM distances""",
       "first_easting first_northing", 3)
def first_traps(t: Inputs):
    return spatial.first_traps(spatial.to_utm(t.traps))


@query("distance_to_first_trap", "distances", """
    SELECT trap_id, site_num, distance FROM distances""", "distance", 3)
def distance_to_first_trap(t: Inputs):
    return t.distances.select("trap_id", "site_num", "distance")


@query("trap_positions", "positions", "SELECT * FROM positions", "pos", 4)
def trap_positions(t: Inputs):
    return t.positions


@query("state_space", "space", "SELECT * FROM space", "xlim1 xlim2", 4)
def state_space(t: Inputs):
    return t.space


@query("older_state_space", "place_distances", """
    SELECT site_num, (min(distance) - 150) / 100 AS xlim1, (max(distance) + 150) / 100 AS xlim2
    FROM place_distances GROUP BY 1""", "xlim1 xlim2", 4)
def older_state_space(t: Inputs):
    return spatial.state_space(t.place_distances, spatial.OLDER_BUFFER)


@query("spatial_reorder", "captures effort", """
    SELECT e.site_num, avg(c.mass) AS mass FROM effort e JOIN captures c ON c.site = e.site
    GROUP BY 1""", "mass")
def spatial_reorder(t: Inputs):
    """Mean mass per site as a letter-ordered vector, re-keyed by site number."""
    sites = t.effort.select("site", "site_num")
    means = t.captures.where("site_num IS NOT NULL").groupBy("site").agg(
        F.avg("mass").alias("mass"))
    letters = ranks.dense_ids(sites, [], "site", "row_key")
    vector = means.join(F.broadcast(letters), "site").select("row_key", "mass")
    return spatial.spatial_reorder(vector, sites).select("site_num", "mass")


@query("trap_blocks", "captures", """
    SELECT site, last_trap - traps + 1 AS first_trap, last_trap FROM (
      SELECT site, traps, CAST(sum(traps) OVER (ORDER BY site) AS BIGINT) AS last_trap FROM (
        SELECT site, max(trap) AS traps FROM captures WHERE site_num IS NOT NULL GROUP BY 1))""")
def trap_blocks(t: Inputs):
    used = t.captures.where("site_num IS NOT NULL").groupBy("site").agg(
        F.max("trap").alias("max_traps"))
    return summaries.trap_blocks(used)


MATRIX = ", ".join(f"max(pos) FILTER (trap = {j}) AS trap_{j}" for j in range(1, 15))


@query("position_matrix", "positions", f"""
    SELECT site_num, {MATRIX} FROM positions GROUP BY 1""",
       " ".join(f"trap_{j}" for j in range(1, 15)), 4)
def position_matrix(t: Inputs):
    return spatial.position_matrix(t.positions, 14)


@query("standardized_sites", "captures covariates", """
    SELECT site_num, (v - avg(v) OVER ()) / stddev_samp(v) OVER () AS mass_std,
      (depth - avg(depth) OVER ()) / stddev_samp(depth) OVER () AS depth_std
    FROM (SELECT c.site_num, v.depth, avg(c.mass) AS v FROM captures c
          JOIN covariates v ON v.site_num = c.site_num GROUP BY ALL)""", "mass_std depth_std")
def standardized_sites(t: Inputs):
    means = t.captures.groupBy("site_num").agg(F.avg("mass").alias("mass")).join(
        F.broadcast(t.covariates), "site_num")
    return summaries.standardize(means, ["mass", "depth"]).select(
        "site_num", "mass_std", "depth_std")
