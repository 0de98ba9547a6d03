"""Projected trap positions and the state space of each site."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapline.functions.projection import utm
from trapline.operators.ranks import dense_ids

BUFFER = 1000.0
OLDER_BUFFER = 150.0


def to_utm(traps: DataFrame, zone: int = 17) -> DataFrame:
    easting, northing = utm(F.col("lat"), F.col("lon"), zone)
    return traps.withColumn("easting", easting).withColumn("northing", northing)


def first_traps(projected: DataFrame, site: str = "site_num", order: str = "trap_id") -> DataFrame:
    """Place of the first trap per site; a minimum, so nothing but one row per site moves."""
    first = projected.groupBy(site).agg(
        F.min_by(F.struct("easting", "northing"), order).alias("_o"))
    return first.select(site, F.col("_o.easting").alias("first_easting"),
                        F.col("_o.northing").alias("first_northing"))


def distance_to_first(projected: DataFrame, site: str = "site_num",
                      order: str = "trap_id") -> DataFrame:
    """Planar metres from every trap to the first trap of its site. The origins hold one row per
    site of the traps; the join is left to adaptive execution, which knows their size."""
    origins = first_traps(projected, site, order)
    return projected.join(origins, site).withColumn(
        "distance", F.hypot(F.col("easting") - F.col("first_easting"),
                            F.col("northing") - F.col("first_northing")))


def trap_positions(distances: DataFrame) -> DataFrame:
    """Places along the canal in units of 100 m."""
    return distances.select("site_num", "trap", (F.col("distance") / 100).alias("pos"))


def state_space(distances: DataFrame, buffer: float = BUFFER) -> DataFrame:
    return distances.groupBy("site_num").agg(
        ((F.min("distance") - buffer) / 100).alias("xlim1"),
        ((F.max("distance") + buffer) / 100).alias("xlim2"))


def spatial_reorder(vector: DataFrame, site_index: DataFrame) -> DataFrame:
    """A vector keyed by position in letter order, keyed by site number instead."""
    letters = dense_ids(site_index, [], "site", "row_key")
    return vector.join(F.broadcast(letters), "row_key").join(
        F.broadcast(site_index.select("site", "site_num")), "site").drop("row_key", "site")


def position_matrix(positions: DataFrame, n_traps: int) -> DataFrame:
    """Site x trap matrix; absent traps are null."""
    wide = positions.groupBy("site_num").pivot("trap", list(range(1, n_traps + 1))).agg(
        F.max("pos"))
    return wide.toDF("site_num", *[f"trap_{j}" for j in range(1, n_traps + 1)])
