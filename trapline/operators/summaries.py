"""Counts, checks, pivots and column statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trapline.operators.ranks import dense_ids, exact_quantiles
from trapline.session import attach
from trapline.sources.lookups import MAX_TRAPS

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def unpivoted(df: DataFrame, ids: list[str], columns: list[str], name: str = "variable",
              value: str = "value") -> DataFrame:
    return df.unpivot(ids, [F.col(f"`{c}`").cast("double").alias(c) for c in columns], name, value)


def summary_table(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Minimum, quartiles, median, mean, maximum and number of nulls per group."""
    quartiles = exact_quantiles(df, groups, value, QUARTILES)
    rest = df.groupBy(*groups).agg(
        F.count_if(F.col(value).isNull()).alias("n_null"), F.min(value).alias("minimum"),
        F.max(value).alias("maximum"), F.avg(value).alias("mean"))
    return rest.join(quartiles, groups, "left")


def column_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """``summary_table`` of several columns at once, one row per column."""
    return summary_table(unpivoted(df, [], columns), ["variable"], "value")


def array_size(per_site: DataFrame, n_traps: int, n_days: int) -> DataFrame:
    """Cells of the dense individual x trap x day x site array per species, as wide as
    ``histories.widths`` tells, and those that are not null."""
    return per_site.groupBy("species").agg(
        (F.max("n").cast("bigint") * n_traps * n_days * F.count(F.lit(1))).alias("array_size"),
        F.sum(F.col("n").cast("bigint") * F.col("max_traps") * n_days).alias("likelihood_cells"))


def expected_rows_check(history: DataFrame, wide: DataFrame, per_site: DataFrame,
                        n_traps: int, n_days: int) -> DataFrame:
    """Rows of the expansion and of its wide form against n x traps x days and n x days."""
    want = per_site.groupBy("species").agg(
        F.sum(F.col("n") * n_traps * n_days).alias("expected_rows"),
        F.sum(F.col("n") * n_days).alias("expected_wide"))
    long_rows = history.groupBy("species").agg(F.count(F.lit(1)).alias("history_rows"))
    wide_rows = wide.groupBy("species").agg(F.count(F.lit(1)).alias("wide_rows"))
    return want.join(long_rows, "species", "left").join(wide_rows, "species", "left").select(
        "species", "expected_rows", "history_rows",
        (F.col("expected_rows") == F.col("history_rows")).alias("rows_ok"),
        "expected_wide", "wide_rows",
        (F.col("expected_wide") == F.col("wide_rows")).alias("wide_ok"))


def new_captures(captures: DataFrame) -> DataFrame:
    """First captures per species and site with the species total (site null)."""
    return captures.rollup("species", "site_num").agg(
        F.count_if(F.col("recap") == "N").alias("n_new"),
        F.grouping_id().alias("level")).where("level < 3").drop("level")


def maximum(df: DataFrame, column: str, strict: bool = False) -> DataFrame:
    """Largest value; with ``strict`` a single null makes the answer null."""
    top = F.max(column)
    if strict:
        top = F.when(F.count(column) == F.count(F.lit(1)), top)
    return df.agg(top.alias(f"max_{column}"))


def collapsed(history: DataFrame, keys: list[str]) -> DataFrame:
    """Array collapsed to ``keys``: captures summed, and whether any was made."""
    return history.groupBy(*keys).agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("captures"),
        (F.coalesce(F.max("count"), F.lit(0)) > 0).cast("int").alias("caught"))


def latent_sums(latent: DataFrame) -> DataFrame:
    """Members and female members per draw and site."""
    return latent.groupBy("chain", "iteration", "site_num").agg(
        F.sum("z").alias("members"), F.sum(F.col("sex") * F.col("z")).alias("female_members"))


def standardize(df: DataFrame, columns: list[str], suffix: str = "_std") -> DataFrame:
    """(x - mean) / sd with n - 1, nulls ignored. The statistics are one row by construction."""
    stats = df.agg(*[f(c).alias(f"_{n}_{c}") for c in columns
                     for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    scaled = df.crossJoin(F.broadcast(stats))
    for c in columns:
        scaled = scaled.withColumn(
            f"{c}{suffix}", F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")))
    return scaled.drop(*stats.columns)


def spatial_recaptures(captures: DataFrame, species: str,
                       n_traps: int | None = None) -> DataFrame:
    """Captures of one species per site, individual and day, one column per trap, up to the last
    one with a capture of the species or, unless stated, no less than those of a session."""
    chosen = captures.where(F.col("species") == species)
    n_traps = n_traps or max(MAX_TRAPS, chosen.agg(F.max("trap")).first()[0] or 0)
    pivoted = chosen.groupBy("site", "ind", "day").pivot("trap", list(range(1, n_traps + 1))).agg(
        F.count(F.lit(1)))
    return pivoted.toDF("site", "ind", "day", *[f"trap_{j}" for j in range(1, n_traps + 1)])


def spread_zero(counts: DataFrame, keys: list[str], name: str, values: list[int],
                prefix: str) -> DataFrame:
    """Pivot in which an absent cell is 0."""
    wide = counts.groupBy(*keys).pivot(name, values).agg(F.sum("count")).na.fill(0)
    return wide.toDF(*keys, *[f"{prefix}{v}" for v in values])


def stacked_chains(chains: dict[int, DataFrame]) -> DataFrame:
    """One table out of a table per chain."""
    parts = [part.withColumn("chain", F.lit(number)) for number, part in chains.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def top_rows(df: DataFrame, order: list[Column], rows: int) -> DataFrame:
    """First rows of an order; pass descending columns for the last ones."""
    return df.orderBy(*order).limit(rows)


def first_match(grid: DataFrame, found: DataFrame, keys: list[str], order: list[str],
                columns: list[str]) -> DataFrame:
    """Align to a target grid: the first row per key, nulls where there is none. The first row is
    a minimum, so a key with very many rows is reduced before the shuffle."""
    first = found.groupBy(*keys).agg(
        F.min_by(F.struct(*columns), F.struct(*order)).alias("_first"))
    return grid.join(first, keys, "left").select(
        *grid.columns, *[F.col(f"_first.{c}").alias(c) for c in columns])


def coded(df: DataFrame, groups: list[str], key: str, name: str) -> DataFrame:
    """Attach the dense code of ``key`` inside ``groups`` (globally without groups)."""
    return attach(df, dense_ids(df, groups, key, name), [*groups, key], "left")


def trap_blocks(effort: DataFrame) -> DataFrame:
    """First and last running trap number per site in letter order, from the site lookup."""
    running = F.sum("max_traps").over(Window.orderBy("site"))
    return effort.select("site", (running - F.col("max_traps") + 1).alias("first_trap"),
                         running.alias("last_trap"))
