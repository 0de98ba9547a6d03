"""Row filters, conditional columns and parameter selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trapline.functions.names import base_name, index_list
from trapline.sources.lookups import EXCLUDED_SITES

# Fixed value: the one individual left out, by species.
DROPPED_INDIVIDUAL = ("CSER", 70)


def sexed_only(captures: DataFrame) -> DataFrame:
    return captures.where((F.col("sex") != "U") & F.col("sex").isNotNull())


def select_species(captures: DataFrame, species: str | None = None,
                   exclude_sites=EXCLUDED_SITES) -> DataFrame:
    """Drop the excluded sites and keep one species (all when none is named)."""
    kept = captures.where(~F.col("site").isin(*exclude_sites))
    return kept if species is None else kept.where(F.col("species") == species)


def exclude_individual(captures: DataFrame, species: str = DROPPED_INDIVIDUAL[0],
                       ind: int = DROPPED_INDIVIDUAL[1]) -> DataFrame:
    return captures.where((F.col("ind") != ind) | (F.col("species") != species))


def model_captures(captures: DataFrame, species: str | None = None) -> DataFrame:
    """The captures a model run uses."""
    return exclude_individual(select_species(sexed_only(captures), species))


def sex_code(sex: Column) -> Column:
    """M is 0, F is 1, anything else (U included) is unknown."""
    return F.when(sex == "M", 0).when(sex == "F", 1)


def closed_trap_id(trap_id: Column, first_after: int = 61, gap: int = 6) -> Column:
    """Trap number once the traps of the two excluded sites are squeezed out."""
    return F.when(trap_id >= first_after, trap_id - gap).otherwise(trap_id)


def truncated(value: Column) -> Column:
    """Whole part of a value that is not negative."""
    return F.floor(value).cast("int")


def filled_count(count: Column, trap: Column, max_traps: Column, ind: Column) -> Column:
    """Null becomes 0 only where the trap exists and the individual is known."""
    return F.when(count.isNull() & (trap <= max_traps) & ind.isNotNull(), F.lit(0)) \
        .otherwise(count)


def with_prefix(draws: DataFrame, prefix: str) -> DataFrame:
    return draws.where(F.col("parameter").startswith(prefix))


def matching(draws: DataFrame, patterns: list[str]) -> DataFrame:
    """Parameters in which any of the patterns is found anywhere."""
    return draws.where(F.col("parameter").rlike("|".join(f"(?:{p})" for p in patterns)))


def named(draws: DataFrame, parameters: list[str]) -> DataFrame:
    return draws.where(F.col("parameter").isin(*parameters))


def with_base(draws: DataFrame, names: list[str]) -> DataFrame:
    """Parameters whose name before the index is one of ``names``."""
    return draws.where(base_name(F.col("parameter")).isin(*names))


def parsed(draws: DataFrame) -> DataFrame:
    return draws.withColumn("base", base_name(F.col("parameter"))) \
        .withColumn("idx", index_list(F.col("parameter")))


def complete_rows(df: DataFrame) -> DataFrame:
    return df.dropna("any")
