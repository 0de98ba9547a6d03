"""Partitioned Parquet store for model inputs and posterior draws."""

from __future__ import annotations

import hashlib
import uuid
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trapline.session import settle
from trapline.sources import shared
from trapline.sources.lookups import RunConfig

RUN_KEYS = ["species", "run_date", "testing"]
SLOT_KEYS = ["site_num", "id_site"]


def save_derived(tables: dict[str, DataFrame], root: str, run_date: str,
                 testing: bool = False) -> None:
    """Write every table under ``root``; each must carry ``species``. A re-run of a
    (species, run_date, testing) replaces just that part.

    A part is written under a fresh name and is published for each of its species by one rename of
    a small file that names it. A reader sees the old part or the new one, and a write that is
    killed leaves the old one as it was."""
    for name, table in tables.items():
        _publish(table, f"{root}/{name}", run_date, testing)


def _publish(table: DataFrame, folder: str, run_date: str, testing: bool) -> None:
    spark, part = table.sparkSession, f"part-{uuid.uuid4().hex}"
    (table.withColumn("run_date", F.lit(run_date)).withColumn("testing", F.lit(testing))
     .write.partitionBy(*RUN_KEYS).parquet(f"{folder}/{part}"))
    for found in shared.folders(spark, f"{folder}/{part}"):
        if found.startswith("species="):
            key = _run_key(unquote(found.removeprefix("species=")), run_date, testing)
            shared.replace_file(spark, f"{folder}/_runs/{key}", part)


def _run_key(species: str, run_date: str, testing: bool) -> str:
    return quote(f"{species},{run_date},{str(testing).lower()}", safe=",")


def load_derived(spark: SparkSession, root: str, name: str, config: RunConfig) -> DataFrame:
    """The published part of one run; the predicate prunes its folders. A run that was never
    published has no rows."""
    runs = f"{root}/{name}/_runs"
    key = _run_key(config.species, config.run_date, config.testing)
    known = shared.files(spark, runs)
    if not known:
        raise FileNotFoundError(f"nothing is published under {root}/{name}")
    part = shared.read_file(spark, f"{runs}/{key if key in known else known[0]}")
    path = f"{root}/{name}/{part}"
    stored = spark.read.schema(_text_date(spark.read.parquet(path).schema)).parquet(path)
    rows = stored.where(config.matches()).drop("run_date", "testing")
    return rows if key in known else rows.where(F.lit(False))


def remove_unpublished(spark: SparkSession, root: str, name: str) -> list[str]:
    """Delete the parts that no run names (replaced ones, and those of killed writes), and tell
    which they were. For times without readers or writers."""
    folder = f"{root}/{name}"
    named = {shared.read_file(spark, f"{folder}/_runs/{f}")
             for f in shared.files(spark, f"{folder}/_runs")}
    gone = [f for f in shared.folders(spark, folder)
            if f.startswith("part-") and f not in named]
    for part in gone:
        shared.remove(spark, f"{folder}/{part}")
    return gone


def save_draws(draws: DataFrame, root: str, config: RunConfig) -> None:
    """Draws of one run, sorted inside each file so that a parameter filter skips row groups."""
    order = ["parameter", "chain", "iteration"]
    rows = draws.withColumn("species", F.lit(config.species)).repartitionByRange(
        *order).sortWithinPartitions(*order)
    _publish(rows, f"{root}/draws", config.run_date, config.testing)


def load_draws(spark: SparkSession, root: str, config: RunConfig) -> DataFrame:
    return load_derived(spark, root, "draws", config).drop("species")


def save_ordered(df: DataFrame, path: str, order: list[str]) -> None:
    """Rows in one total order of the columns of ``order`` (nulls first): each file holds a range,
    sorted, and files follow each other by name. Nothing is sorted in one task."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(path)


def load_ordered(spark: SparkSession, path: str, order: list[str]) -> DataFrame:
    """The rows with ``place``, their number from 1 in the order in which they are stored. The
    order is verified and not trusted: the rows of a file must not descend, and the least key of a
    file must not be below the greatest of the one before. Raises if they are."""
    file, row = F.col("_metadata.file_name"), F.col("_metadata.row_index")
    key = F.struct(*order)
    rows = spark.read.parquet(path).select("*", file.alias("_file"), row.alias("_row"))
    inside = Window.partitionBy("_file").orderBy("_row")
    # a file is what one task wrote; of each one row is kept
    known = rows.select("_file", "_row", key.alias("_key")).withColumn(
        "_last", F.lag("_key").over(inside)).groupBy("_file").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_key").alias("_least"),
        F.max("_key").alias("_most"), F.count_if(F.col("_last") > F.col("_key")).alias("_odd"))
    by_name = Window.orderBy("_file")
    files = settle(known.withColumn("_base", F.sum("_rows").over(by_name) - F.col("_rows"))
                   .withColumn("_before", F.lag("_most").over(by_name)))
    odd = files.where((F.col("_odd") > 0) | (F.col("_before") > F.col("_least"))).limit(1).collect()
    if odd:
        raise ValueError(f"{odd[0]['_file']} of {path} is out of order")
    return rows.join(F.broadcast(files.select("_file", "_base")), "_file").withColumn(
        "place", F.col("_base") + F.col("_row") + 1).drop("_file", "_row", "_base")


def save_latent(latent: DataFrame, root: str, buckets: int = 64) -> None:
    """Latent states in files by hash of site and slot, sorted in each file: joins on these two
    read a bucket where it lies. A run of another number of buckets lies beside it."""
    spark, path = latent.sparkSession, f"{root}/latent-{buckets}"
    name = _table_name(path)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    (latent.repartition(buckets, *SLOT_KEYS).write.mode("overwrite").format("parquet")
     .bucketBy(buckets, *SLOT_KEYS).sortBy(*SLOT_KEYS).option("path", path).saveAsTable(name))


def load_latent(spark: SparkSession, root: str, buckets: int = 64) -> DataFrame:
    """The bucketed table; a session that did not write it is told of its buckets first."""
    path = f"{root}/latent-{buckets}"
    name = _table_name(path)
    if not spark.catalog.tableExists(name):
        schema = spark.read.parquet(path).schema
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        keys = ", ".join(SLOT_KEYS)
        spark.sql(f"CREATE TABLE {name} ({fields}) USING parquet CLUSTERED BY ({keys}) "
                  f"SORTED BY ({keys}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def _table_name(path: str) -> str:
    return f"latent_{hashlib.sha256(path.encode()).hexdigest()[:16]}"


def _text_date(schema):
    """Folder values such as 2020-05-23 are read as dates; keep the run key as text."""
    fields = [f"`{f.name}` {'string' if f.name == 'run_date' else f.dataType.simpleString()}"
              for f in schema.fields]
    return ", ".join(fields)
