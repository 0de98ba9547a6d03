"""Session helpers: shared checkpoint folder, lineage cuts and size-checked joins."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# A lookup is broadcast only after it was counted and found to hold at most this many rows.
BROADCAST_ROWS = 200_000
# Seconds after a write by which its observed numbers should be there.
OBSERVED_WITHIN = 10
# A key is heavy if it holds more than one in so many rows.
HOT_SHARE = 500

_scratch: list[str] = []


def build_session(cores: str = "8", app: str = "trapline") -> SparkSession:
    """Local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session; a temporary one only for a local master."""
    context = spark.sparkContext
    folder = (spark.conf.get("spark.checkpoint.dir", None)
              or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir())
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="trapline-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder as Parquet and read it back, so that later passes
    prune columns, know its size and see the same rows, and a lost executor costs a re-read
    instead of a re-run. ``release`` deletes the files."""
    path = scratch(df.sparkSession, "settled")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared one, so that runs never meet."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _scratch.append(path)
    return path


def release(spark: SparkSession) -> None:
    """Delete what ``scratch`` handed out; the tables built on it can no longer be read."""
    context = spark.sparkContext
    for path in _scratch:
        where = context._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)
    _scratch.clear()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give a small table whose rows are expensive to work on the full parallelism of the
    session."""
    return df.repartition(task_count(df), *keys)


def task_count(df: DataFrame) -> int:
    """The parallelism of the session, for a small table whose rows are expensive to work on:
    where a number is stated, adaptive execution does not merge small partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def measured(df: DataFrame, **measures: Column) -> tuple[DataFrame, dict]:
    """``settle`` and aggregates of the rows, which the write itself observes. What it observed
    comes as an event, and a busy driver may lose events; then the written table is asked."""
    seen, found = Observation(), {}
    named = [measure.alias(name) for name, measure in measures.items()]
    table = settle(df.observe(seen, *named))
    wait = threading.Thread(target=lambda: found.update(seen.get), daemon=True)
    wait.start()
    wait.join(OBSERVED_WITHIN)
    return table, dict(found) if found else table.agg(*named).first().asDict()


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``settle`` and the number of rows."""
    table, seen = measured(df, rows=F.count(F.lit(1)))
    return table, seen["rows"]


def attach(facts: DataFrame, lookup: DataFrame, on: list[str], how: str = "inner",
           max_rows: int = BROADCAST_ROWS, rows: int | None = None) -> DataFrame:
    """Join a lookup with one row per key, or a few, to a fact table in which one key may hold a
    large share of the rows. ``how`` is inner or left.

    Up to ``max_rows`` the lookup is broadcast and the facts do not move; it is settled and
    counted for this unless ``rows`` tells its size. Beyond that a sketch of the facts finds the
    keys that hold more than one row in ``HOT_SHARE``, of which there are fewer than that. Their
    facts stay in place and get their lookup rows by broadcast; all others meet in an ordinary
    join, whose keys are small, so no lookup row is copied."""
    if rows is None:
        lookup, rows = counted(lookup)
    if rows <= max_rows:
        return facts.join(F.broadcast(lookup), on, how)
    hot = heavy_keys(facts, on)
    # facts that compress well look small to the planner, which would broadcast them
    if not hot:
        return facts.join(lookup.hint("merge"), on, how)
    heavy = F.xxhash64(*on).isin(hot)
    return facts.where(heavy).join(F.broadcast(lookup.where(heavy)), on, how).unionByName(
        facts.where(~heavy).join(lookup.where(~heavy).hint("merge"), on, how))


def heavy_keys(facts: DataFrame, on: list[str]) -> list[int]:
    """Hashes of the keys that hold more than one row in ``HOT_SHARE``, by a sketch of bounded
    size; any split by them gives the same rows, so an estimate is enough."""
    key = ", ".join(f"`{c}`" for c in on)
    found, total = facts.agg(
        F.expr(f"approx_top_k(xxhash64({key}), {HOT_SHARE}, {10 * HOT_SHARE})"),
        F.count(F.lit(1))).first()
    return [f["item"] for f in found or [] if f["count"] * HOT_SHARE > total]
