"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected ``target / source size`` times. The expected copies are
summed along an order of the source, one random offset per source is added, and a document is
emitted once for each whole number that its part of the sum crosses. The order follows the size,
so that a sample holds every size in its share and the words taken come near the target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trapline.llm.common import WORD, settle, unit_draw

WEIGHTS = (5, 2, 1)
#: A source is used at most so many times.
REPEATS = 3
#: Parts of a size class, so that no class of a hot source becomes one task.
PARTS = 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(totals: DataFrame, weights=WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """``source``, ``source_size``, ``target`` from one row per source.

    Sources in code-point order, null last, take the weights in turn and share the sum of all
    sizes. The level of the shares is raised until the targets below ``repeats`` sizes take up
    what the others leave: sources are met in the order of their limits per weight, and the first
    level below the next limit is the one."""
    # one row per source; the windows hold names and totals only
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]),
                        (F.row_number().over(by_name) - 1) % len(weights) + 1)
    weighed = totals.withColumn("_w", turn.cast("bigint"))
    by_limit = Window.orderBy(F.col("source_size") / F.col("_w"),
                              F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - repeats * F.coalesce(
        F.sum("source_size").over(by_limit), F.lit(0))
    weight = F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(by_limit), F.lit(0))
    tried = weighed.withColumn("_level", left / weight).withColumn(
        "_fits", F.col("_level") * F.col("_w") <= repeats * F.col("source_size"))
    level = F.min(F.struct(~F.col("_fits"), F.col("source_size") / F.col("_w"),
                           F.col("source").isNull(), "source", "_level")).over(everything)
    return tried.withColumn("_level", level["_level"]).select(
        "source", "source_size", F.least(
            F.col("_level") * F.col("_w"), (repeats * F.col("source_size")).cast("double")
        ).alias("target"))


def size_class(size: Column) -> Column:
    """Length and leading three bits of a size in binary: classes a quarter wide at most."""
    bits = F.bin(size)
    return F.length(bits) * 1000 + F.substring(bits, 1, 3).cast("int")


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text",
        seed: str = "mix", weights=WEIGHTS, repeats: int = REPEATS,
        whole_rows: bool = False) -> DataFrame:
    """One row per document: ``key``, ``size`` in words, ``source``, ``source_size``, ``target``
    of its source and ``copies``, how often the mix takes it (0 to ``repeats``). With
    ``whole_rows`` the input row comes as the struct ``row`` too.

    A null text has size 0; a null source is a source of its own, the last; null keys draw like
    any other. Sources without words have target 0 and take nothing. Repeated rows share a draw
    and differ in place only. No rows give an empty result; other columns are ignored. A re-run
    gives the same copies. A source of any share of the rows is cut by size class and draw. A long
    text is counted whole and is one row like any other."""
    draw = F.expr(unit_draw(f"'{seed}'", "coalesce(cast(_key as string), '')"))
    carried = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
               F.xxhash64(F.col(text)).alias("_text")] if whole_rows else []
    rows = (docs.select(F.col(key).alias("_key"), F.col(source).alias("_source"),
                        word_count(F.col(text)).alias("size"), *carried)
            .withColumn("_draw", draw)
            .withColumn("_class", size_class(F.col("size")))
            .withColumn("_part", F.floor(F.col("_draw") * PARTS).cast("int")))
    if not whole_rows:
        rows = settle(rows)
    cells = settle(rows.groupBy("_source", "_class", "_part").agg(
        F.count("*").alias("_rows"), F.sum("size").alias("_size")))
    totals = settle(targets(cells.groupBy(F.col("_source").alias("source")).agg(
        F.sum("_size").alias("source_size")), weights, repeats))
    # one row per cell: at most PARTS rows for each class of sizes in a source
    before = Window.partitionBy("_source").orderBy("_class", "_part").rowsBetween(
        Window.unboundedPreceding, -1)
    offset = F.expr(unit_draw(f"'{seed}'", "'offset'", "coalesce(concat('=', source), '')"))
    starts = (cells.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
              .join(totals, cells["_source"].eqNullSafe(totals["source"]))
              .select("_source", "_class", "_part", "_before", "source_size", "target",
                      offset.alias("_u")))
    ties = ["size", "_draw", "_key", *(["_text"] if whole_rows else [])]
    at = Window.partitionBy("_source", "_class", "_part").orderBy(*ties)
    placed = rows.withColumn("_at", F.row_number().over(at)).alias("r").join(
        starts.alias("s"), F.expr("r._source <=> s._source and r._class = s._class "
                                  "and r._part = s._part"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    upto = F.col("_before") + F.col("_at")
    crossed = F.floor(upto * rate + F.col("_u")) - F.floor((upto - 1) * rate + F.col("_u"))
    return placed.select(F.col("_key").alias(key), "size", F.col("r._source").alias(source),
                         "source_size", "target", crossed.cast("int").alias("copies"),
                         *([F.col("_row").alias("row")] if whole_rows else []))


def emitted(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    taken = mix(docs, whole_rows=True, **options).where("copies > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(
        *[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
