"""Ranks, dense ids and exact quantiles that never sort a whole group in one task.

Rows are put into ranges of the sort order, each range is worked on where it lies, and only the
range totals (one row per range and group) are accumulated and attached back. The ranges are cut by
a sample, so they are settled once: every later pass must see the same ranges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from trapline.session import attach, settle

# Values of a sketch, and the largest number of rows between two of them that are sorted at once.
CUTS = 256
BRACKET_ROWS = 1 << 17


def _offsets(sizes: DataFrame, groups: list[str]) -> DataFrame:
    """Per range and group (``_size`` given): weight in earlier ranges and in the whole group."""
    per_group = Window.partitionBy(*groups)
    return sizes.select(
        "*",
        F.coalesce(F.sum("_size").over(
            per_group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0)).alias("_offset"),
        F.sum("_size").over(per_group).alias("total"))


def positions(df: DataFrame, groups: list[str], order: list[str]) -> DataFrame:
    """Add ``before``, the number of earlier rows of the group, and ``total``. ``df`` is unique on
    groups + order, and both are not null. Row numbers inside a range are the running ids Spark
    gives to its sorted rows."""
    ranged = settle(df.repartitionByRange(*groups, *order).sortWithinPartitions(*groups, *order)
                    .withColumn("_at", F.monotonically_increasing_id())
                    .withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range", *groups).agg(
        F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_size"))
    placed = attach(ranged, _offsets(sizes, groups), ["_range", *groups])
    return placed.withColumn("before", F.col("_offset") + F.col("_at") - F.col("_first")).drop(
        "_range", "_at", "_first", "_size", "_offset")


def running_total(df: DataFrame, groups: list[str], order: list[str], weight: str) -> DataFrame:
    """Add ``before``, the sum of an integer ``weight`` over the earlier rows of the group, and
    ``total``. ``df`` is unique on groups + order, and both are not null."""
    ranged = df.repartitionByRange(*groups, *order).sortWithinPartitions(*groups, *order)
    schema = StructType([*ranged.schema.fields, StructField("_local", LongType())])
    ranged = settle(ranged.mapInArrow(_sums_before(groups, weight), schema).withColumn(
        "_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range", *groups).agg(F.sum(weight).alias("_size"))
    placed = attach(ranged, _offsets(sizes, groups), ["_range", *groups])
    return placed.withColumn("before", F.col("_offset") + F.col("_local")).drop(
        "_range", "_local", "_size", "_offset")


def _sums_before(groups: list[str], weight: str):
    """Arrow batches of one sorted range in, the same with the sum of the earlier weights of the
    group in the range out; the sum is carried from batch to batch."""

    def run(batches):
        last, carried = None, 0
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            starts = np.zeros(n, dtype=bool)
            for name in groups:
                column = batch.column(name)
                starts[1:] |= pc.not_equal(column.slice(1), column.slice(0, n - 1)).to_numpy(
                    zero_copy_only=False)
            head = [batch.column(name)[0].as_py() for name in groups]
            starts[0] = last is not None and head != last
            weights = batch.column(weight).to_numpy(zero_copy_only=False).astype(np.int64)
            earlier = carried + np.cumsum(weights) - weights
            at = np.maximum.accumulate(np.where(starts, np.arange(n), -1))
            local = earlier - np.where(at >= 0, earlier[at], 0)
            carried = int(local[-1] + weights[-1])
            last = [batch.column(name)[n - 1].as_py() for name in groups]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(local, pa.int64())], [*batch.schema.names, "_local"])

    return run


def dense_ids(df: DataFrame, groups: list[str], key: str, name: str,
              type_: str = "int") -> DataFrame:
    """(groups, key, name): keys of each group numbered 1..n in sort order; null keys get none.
    Without groups the numbering is global."""
    keys = df.where(F.col(key).isNotNull()).select(*groups, key).distinct()
    numbered = positions(keys, groups, [key])
    return numbered.select(*groups, key, (F.col("before") + 1).cast(type_).alias(name))


def _distinct_values(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    return (df.where(F.col(value).isNotNull()).groupBy(*groups, value)
            .agg(F.count(F.lit(1)).alias("n")))


def value_positions(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """One row per group and distinct value: ``n`` rows with it, ``before`` rows with a smaller
    one, ``total`` rows in the group. Ties collapse before anything is sorted."""
    return running_total(_distinct_values(df, groups, value), groups, [value], "n")


def _places(p: float) -> tuple[Column, Column, Column]:
    """0-based positions of the order statistics around a quantile and the way between them."""
    place = (F.col("total") - 1) * F.lit(float(p))
    low = F.floor(place)
    return low, F.ceil(place), place - low


def exact_quantiles(df: DataFrame, groups: list[str], value: str,
                    probs: dict[str, float]) -> DataFrame:
    """One row per group with a column per probability: linear interpolation between the order
    statistics around position (n - 1) p. Nulls count for nothing.

    The two positions of a probability are enclosed between two values of a sketch of fixed size,
    and the sketch is taken again between them until at most ``BRACKET_ROWS`` rows are left; a pass
    keeps about one row in a hundred. Only what lies in a bracket is told apart by value and
    sorted; of the rows on either side one number and one value are kept. So nothing as large as
    the rows is moved or written, and a group of any size costs its tasks a partial sum."""
    if not groups:
        return exact_quantiles(df.withColumn("_all", F.lit(0)), ["_all"], value, probs).drop("_all")
    rows = df.where(F.col(value).isNotNull()).select(*groups, F.col(value).alias("_v"))
    wanted = F.explode(F.array(*[F.struct(F.lit(k).alias("_k"), F.lit(float(p)).alias("_p"))
                                 for k, p in enumerate(probs.values())]))
    place = (F.col("_n") - 1) * F.col("_w._p")
    first = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"), _sketch(F.col("_v"))).select(
        "*", wanted.alias("_w")).select(
        *groups, "_n", F.col("_w._k").alias("_k"), F.floor(place).alias("_low"),
        F.ceil(place).alias("_high"), (place - F.floor(place)).alias("_share"),
        F.lit(0).cast("bigint").alias("_before"), F.col("_n").alias("_inside"), "_cuts",
        F.lit(None).cast(rows.schema["_v"].dataType).alias("_from"),
        F.lit(None).cast(rows.schema["_v"].dataType).alias("_to"))
    brackets, most = _narrowed(first)
    keys = [*groups, "_k"]
    while most > BRACKET_ROWS:
        side = _side()
        again = _in_brackets(rows, brackets, groups).groupBy(
            *keys, "_n", "_low", "_high", "_share", "_from", "_to").agg(
            F.count_if(side < 0).alias("_before"), F.count_if(side == 0).alias("_inside"),
            _sketch(F.when(side == 0, F.col("_v"))))
        brackets, left = _narrowed(again)
        if left >= most:  # the rows that are left are equal
            break
        most = left
    sided = _in_brackets(rows, brackets, groups).withColumn("_side", _side())
    values = sided.groupBy(*keys, "_low", "_high", "_share", "_side", F.when(
        F.col("_side") == 0, F.col("_v")).alias("_value")).agg(
        F.count(F.lit(1)).alias("_rows"), F.max("_v").alias("_last"), F.min("_v").alias("_first"))
    order = Window.partitionBy(*keys).orderBy("_side", "_value").rowsBetween(
        Window.unboundedPreceding, -1)
    placed = values.withColumn("_at", F.coalesce(F.sum("_rows").over(order), F.lit(0)))

    def at(position: str) -> Column:
        """The value at a position: in the bracket, or the nearest one on either side of it."""
        offset = F.col(position) - F.col("_at")
        return F.max(F.when((F.col("_side") == 0) & offset.between(0, F.col("_rows") - 1),
                            F.col("_value"))
                     .when((F.col("_side") < 0) & (offset == F.col("_rows") - 1), F.col("_last"))
                     .when((F.col("_side") > 0) & (offset == 0), F.col("_first")))

    found = placed.groupBy(*keys, "_share").agg(at("_low").alias("_a"), at("_high").alias("_b"))
    between = F.col("_a") + F.col("_share") * (F.col("_b") - F.col("_a"))
    return found.groupBy(*groups).agg(*[
        F.max(F.when(F.col("_k") == k, between)).alias(name) for k, name in enumerate(probs)])


def _sketch(value: Column) -> Column:
    """``CUTS`` + 1 values at even steps of the rank, each off by less than one step."""
    steps = F.array(*[F.lit(i / CUTS) for i in range(CUTS + 1)])
    return F.percentile_approx(value, steps, F.lit(8 * CUTS)).alias("_cuts")


def _narrowed(sketched: DataFrame) -> tuple[DataFrame, int]:
    """Brackets around the wanted positions, two steps of the sketch wide on either side, and
    about how many rows the largest one holds; an open end is null."""
    step = F.col("_inside") / CUTS
    left = F.floor((F.col("_low") - F.col("_before")) / step) - 2
    right = F.ceil((F.col("_high") + 1 - F.col("_before")) / step) + 2
    cut = F.when(F.col("_inside") > 0, F.col("_cuts"))
    table = sketched.withColumns({
        "_from": F.when(left >= 0, F.get(cut, left.cast("int"))).otherwise(F.col("_from")),
        "_to": F.when(right <= CUTS, F.get(cut, right.cast("int"))).otherwise(F.col("_to")),
        "_most": F.ceil(step * (right - left + 2))}).drop("_cuts", "_before", "_inside")
    brackets = settle(table)
    return brackets.drop("_most"), brackets.agg(F.max("_most")).first()[0] or 0


def _in_brackets(rows: DataFrame, brackets: DataFrame, groups: list[str]) -> DataFrame:
    """Every row once for each bracket of its group: as many as there are probabilities."""
    packed = brackets.groupBy(*groups).agg(F.collect_list(F.struct(
        "_n", "_k", "_low", "_high", "_share", "_from", "_to")).alias("_brackets"))
    return attach(rows, packed, groups).select(*groups, "_v", F.explode("_brackets").alias("_b")).select(
        *groups, "_v", "_b.*")


def _side() -> Column:
    """-1 before the bracket, 0 in it, 1 after it."""
    return F.when(F.col("_v") < F.col("_from"), -1).when(F.col("_v") > F.col("_to"), 1).otherwise(0)


def picked_quantiles(places: DataFrame, groups: list[str], value: str,
                     probs: dict[str, float]) -> DataFrame:
    """Quantiles from ``value_positions`` rows that hold at least the wanted positions."""
    columns = []
    for name, p in probs.items():
        low, high, share = _places(p)
        after = F.col("before") + F.col("n")
        below = F.max(F.when((F.col("before") <= low) & (low < after), F.col(value)))
        above = F.max(F.when((F.col("before") <= high) & (high < after), F.col(value)))
        columns.append((below + F.max(share) * (above - below)).alias(name))
    return places.groupBy(*groups).agg(*columns)


def average_ranks(places: DataFrame) -> DataFrame:
    """Average rank of each distinct value among the rows of its group (ties share it)."""
    return places.withColumn("rank", F.col("before") + (F.col("n") + 1) / F.lit(2.0))
