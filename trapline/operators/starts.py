"""Augmented slots and reproducible start values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapline.functions.probability import uniform
from trapline.sources.lookups import N_DAYS

SLOT = ["species", "site_num", "id_site"]


def slots(sizes: DataFrame, *keep: str) -> DataFrame:
    """One row per augmented slot 1..m of each species and site; slots past m do not exist."""
    full = sizes.where(F.col("m") > 0)
    return full.select("species", "site_num", *keep,
                       F.explode(F.sequence(F.lit(1), "m")).alias("id_site"))


def draw_uniform(seed: int):
    return uniform(seed, *[F.col(c) for c in SLOT])


def init_membership(sizes: DataFrame, psi: float | None = None, seed: int = 1) -> DataFrame:
    """z = 1 for observed slots, else Bernoulli(psi). Without ``psi`` it is one uniform draw from
    (.05, .2) for the run. Every slot has its own draw."""
    chance = F.lit(psi) if psi is not None else 0.05 + 0.15 * uniform(seed, F.lit("psi"))
    drawn = (draw_uniform(seed) < chance).cast("int")
    return slots(sizes, "n").select(
        *SLOT, F.when(F.col("id_site") <= F.col("n"), 1).otherwise(drawn).alias("z"))


def init_activity_centres(sizes: DataFrame, centres: DataFrame, seed: int = 2,
                          low: float = -1.5, spacing: float = 25.0, margin: float = 150.0,
                          state_space: DataFrame | None = None) -> DataFrame:
    """Observed centre where there is one, else uniform over the range of the smallest site, or
    over each site's own limits when ``state_space`` is given."""
    smallest = sizes.agg(F.min("max_traps").alias("_least"))
    grid = slots(sizes).crossJoin(F.broadcast(smallest))
    high = ((F.col("_least") - 1) * spacing + margin) / 100
    place = low + (high - low) * draw_uniform(seed)
    if state_space is not None:
        grid = grid.join(F.broadcast(state_space), "site_num")
        place = F.col("xlim1") + (F.col("xlim2") - F.col("xlim1")) * draw_uniform(seed)
    return grid.join(centres, SLOT, "left").select(*SLOT, F.coalesce("loc", place).alias("s"))


def older_activity_centres(sizes: DataFrame, numbered: DataFrame, positions: DataFrame,
                           state_space: DataFrame, seed: int = 3) -> DataFrame:
    """Capture-weighted mean trap position of the own site, else uniform in the site's limits.
    Positions and limits hold at most one row per trap of the effort table."""
    placed = numbered.where(F.col("id_site").isNotNull()).join(
        F.broadcast(positions), ["site_num", "trap"])
    observed = placed.groupBy(*SLOT).agg(
        (F.sum(F.col("count") * F.col("pos")) / F.sum("count")).alias("loc"))
    return init_activity_centres(sizes, observed, seed, state_space=state_space)


def blank_beyond_size(grid: DataFrame, sizes: DataFrame, columns: list[str]) -> DataFrame:
    """Null the start values of slots past the size of their site (a table of full width)."""
    m = F.broadcast(sizes.select("species", "site_num", "m"))
    kept = grid.join(m, ["species", "site_num"])
    for c in columns:
        kept = kept.withColumn(c, F.when(F.col("id_site") <= F.col("m"), F.col(c)))
    return kept.drop("m")


def init_psi(membership: DataFrame, sizes: DataFrame, extra: int = 1) -> DataFrame:
    """(n + extra) / members per species and site."""
    n = F.broadcast(sizes.select("species", "site_num", "n"))
    totals = membership.groupBy("species", "site_num").agg(F.sum("z").alias("members"))
    return totals.join(n, ["species", "site_num"]).select(
        "species", "site_num", F.try_divide(F.col("n") + extra, "members").alias("psi"))


def init_psi_sex(membership: DataFrame, sexes: DataFrame) -> DataFrame:
    """(female members + 1) / members per species; unknown sexes add nothing."""
    joined = membership.join(sexes, SLOT, "left")
    return joined.groupBy("species").agg(F.try_divide(
        F.coalesce(F.sum(F.col("sex") * F.col("z")), F.lit(0)) + 1,
        F.sum("z")).alias("psi_sex"))


def sex_table(sizes: DataFrame, sexes: DataFrame) -> DataFrame:
    """Sex code of every slot, null when unknown; ``sexes`` holds one letter per individual."""
    code = F.when(F.col("sex") == "M", 0).when(F.col("sex") == "F", 1)
    return slots(sizes).join(sexes, SLOT, "left").select(*SLOT, code.alias("sex"))


def impute_sex(sexes: DataFrame, seed: int = 4) -> DataFrame:
    """Unknown sexes become Bernoulli(p) with one p uniform in (.3, .8) for the run."""
    chance = 0.3 + 0.5 * uniform(seed, F.lit("p"))
    return sexes.withColumn("sex", F.coalesce(
        "sex", (draw_uniform(seed) < chance).cast("int")))


def zero_slots(sizes: DataFrame, name: str = "zero") -> DataFrame:
    """The constant 0 for every slot."""
    return slots(sizes).withColumn(name, F.lit(0))


def padded_history(sizes: DataFrame, cells: DataFrame, zero: bool, n_days: int | None = None,
                   traps: bool = True) -> DataFrame:
    """Histories enlarged to all slots x days (x existing traps); a missing cell is 0 or null. The
    days are those of a session, or more if a cell lies on a later one, unless stated."""
    n_days = n_days or max(N_DAYS, cells.agg(F.max("day")).first()[0] or 0)
    grid = slots(sizes, "max_traps").withColumn(
        "day", F.explode(F.sequence(F.lit(1), F.lit(n_days))))
    keys = [*SLOT, "day"]
    if traps:
        grid = grid.withColumn("trap", F.explode(F.sequence(F.lit(1), "max_traps")))
        keys = [*keys, "trap"]
    value = [c for c in cells.columns if c not in keys][0]
    joined = grid.drop("max_traps").join(cells, keys, "left")
    return joined.withColumn(value, F.coalesce(value, F.lit(0))) if zero else joined


def site_matrix(values: DataFrame, column: str, width: int = 1000) -> DataFrame:
    """Site x slot matrix in row blocks: (species, site_num, block) with up to ``width`` values in
    slot order, so the widest site is many bounded rows instead of one unbounded one."""
    block = F.floor((F.col("id_site") - 1) / width).cast("int")
    return values.groupBy("species", "site_num", block.alias("block")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("id_site", column))),
                    lambda x: x[column]).alias("row"))
