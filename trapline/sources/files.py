"""CSV readers with fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trapline.session import attach, settle


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Headered CSV; the text NA is null and nothing is inferred."""
    return spark.read.csv(path, header=True, schema=schema, nullValue="NA", mode="FAILFAST")


def read_vector(spark: SparkSession, path: str, name: str = "v") -> DataFrame:
    """Header-less file with one number per line."""
    return spark.read.csv(path, header=False, schema=f"{name} DOUBLE", nullValue="NA")


def read_column(spark: SparkSession, path: str, name: str, type_: str = "DOUBLE") -> DataFrame:
    """One named column of a headered file whatever else the file holds, such as the empty
    column a trailing comma makes."""
    wide = spark.read.csv(path, header=True, nullValue="NA")
    return wide.select(F.col(name).cast(type_).alias(name))


def with_row_key(df: DataFrame, name: str = "row_key", across: bool = False) -> DataFrame:
    """Number the rows of each file 1..n in file order, or of all files in the order of their
    names if ``across``.

    ``df`` must be a file scan (a read, possibly projected). A file is read in byte ranges; the
    rows of a range stay together and in order, so the key is the number of rows in earlier
    ranges plus the place inside the range. Only the range sizes, one row per input split, are
    summed up in one window."""
    ranged = settle(
        df.select("*", F.col("_metadata.file_path").alias("_file"),
                  F.col("_metadata.file_block_start").alias("_start"),
                  F.monotonically_increasing_id().alias("_seen")))
    ranges = ranged.groupBy("_file", "_start").agg(
        F.min("_seen").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    ordered = Window.orderBy("_file", "_start") if across else Window.partitionBy(
        "_file").orderBy("_start")
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("_file", "_start", "_first", F.coalesce(
        F.sum("_rows").over(earlier), F.lit(0)).alias("_skipped"))
    keyed = attach(ranged, ranges, ["_file", "_start"])
    return keyed.withColumn(name, F.col("_skipped") + F.col("_seen") - F.col("_first") + 1).drop(
        "_file", "_start", "_seen", "_first", "_skipped")
