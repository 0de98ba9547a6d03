"""Helpers shared by the operators: written cuts, shared files, global row numbers, components."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trapline import session

# Words are runs of bytes other than ASCII white space; the regular expression of Java and DuckDB.
WORD = r"[^\x20\x09-\x0D]+"

_written: list[str] = []


def scratch(spark: SparkSession) -> str:
    """A new folder name below the shared folder of the session; ``session.release`` deletes it
    unless ``remove`` did before."""
    path = session.scratch(spark, "llm")
    _written.append(path)
    return path


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back: later passes prune columns,
    see the same rows, and a lost executor costs a re-read."""
    path = scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(StructType(
        [f for f in df.schema.fields])).parquet(path)


@contextmanager
def recorded():
    """Collect the scratch folders made inside the block."""
    start, found = len(_written), []
    yield found
    found.extend(_written[start:])


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch folders whose readers are done."""
    context = spark.sparkContext
    for path in paths:
        where = context._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def open_store(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """File system and path of a folder given as a URI or as an absolute path."""
    return pyarrow.fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:")
                                          else f"file://{folder}")


def write_file(folder: str, name: str, body) -> None:
    """Write one file under a name of its own and rename it when it is whole, so that a task that
    dies leaves no half file under a name that an index refers to."""
    store, path = open_store(folder)
    store.create_dir(path, recursive=True)
    part = f"{path}/_{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(part, compression=None) as out:
        for piece in body:
            out.write(piece)
    store.move(part, f"{path}/{name}")


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def numbered(rows: DataFrame, order: list, name: str = "_n") -> DataFrame:
    """Global row numbers from 0 in the given order, nulls first, without a one-task sort.

    ``rows`` is cut into ranges of the order, numbered where it lies, and shifted by the row
    counts of the ranges before. Rows that tie in every order column are dealt over the ranges
    by their place in the settled input. The result is settled."""
    placed = rows.withColumn("_tie", F.monotonically_increasing_id())
    keys = [*order, F.col("_tie")]
    ranged = settle(placed.repartitionByRange(partitions(rows), *keys)
                    .sortWithinPartitions(*keys).drop("_tie")
                    .withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range: as many as there are shuffle partitions
    bases = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows")).select(
        "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_base"))
    return (ranged.withColumn("_part", part).join(F.broadcast(bases), "_part")
            .withColumn(name, F.col("_base") + F.col("_place").bitwiseAND((1 << 33) - 1))
            .drop("_part", "_base", "_place"))


def components(links: DataFrame) -> DataFrame:
    """Smallest id reachable from each id of the links (``a``, ``b``), as (``id``, ``root``).

    Large-star and small-star rounds until nothing changes: every round replaces a link by links
    to the smallest neighbour, which takes a logarithmic number of rounds, also for long chains.
    Links are settled each round; the neighbour minimum is pre-aggregated, and a hub's links are
    joined to one row, which adaptive execution splits."""
    edges = settle(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                   .where("a <> b").distinct())
    mark = F.struct(F.count("*"), F.bit_xor(F.xxhash64("a", "b")))
    state = None
    while state != (state := edges.agg(mark).first()[0]):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = settle(both.groupBy("a").agg(F.min("b").alias("_m")).select(
            "a", F.least("a", "_m").alias("_m")))
        large = settle(both.where("b > a").join(least, "a").select(
            F.col("b").alias("a"), F.col("_m").alias("b")).where("a <> b").distinct())
        small = settle(large.groupBy("a").agg(F.min("b").alias("_m")))
        ends = F.array(F.struct("a", F.col("_m").alias("b")),
                       F.struct(F.col("b").alias("a"), F.col("_m").alias("b")))
        edges = settle(large.join(small, "a").select(F.explode(ends).alias("_e"))
                       .select("_e.*").where("a <> b").distinct())
    roots = edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "id")
    ends = edges.select(F.col("b").alias("id")).distinct().withColumn("root", F.col("id"))
    return settle(roots.unionByName(ends.join(roots, "id", "left_anti")))


def unit_draw(*parts) -> str:
    """SQL of a uniform number in [0, 1) of 16 bits from an MD5 digest; few bits keep sums of
    whole numbers and draws exact."""
    text = ", ':', ".join(parts)
    return f"cast(conv(substring(md5(concat({text})), 1, 4), 16, 10) as bigint) / 65536D"
