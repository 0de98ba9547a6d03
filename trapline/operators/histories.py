"""From the capture log to complete capture histories, recapture flags and sizes.

Work is keyed by (species, site_num, ind), never by site alone. The log is counted map-side first,
so one very often caught individual shrinks to at most one row per trap, day and sex before
anything moves. The dense individual x trap x day grid is then produced by exploding one row per
individual instead of joining a grid back to the counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trapline.operators.ranks import dense_ids
from trapline.session import attach, settle
from trapline.sources.lookups import MAX_TRAPS, N_DAYS

INDIVIDUAL = ["species", "site_num", "ind", "id_site"]
CAPTURE_RATE = 0.01


@dataclass(frozen=True)
class Widths:
    """How many traps and days the grids, pivots and arrays of a log must hold."""

    traps: int
    days: int


def widths(effort: DataFrame, captures: DataFrame, days: int = N_DAYS) -> Widths:
    """Widths of a log: the largest trap that the effort table grants or a capture names, and the
    last day with a capture, or ``days`` if that is later. Two numbers leave the cluster."""
    granted = effort.select(F.col("max_traps").alias("trap"), F.lit(days).alias("day"))
    top = captures.select("trap", "day").unionByName(granted).agg(F.max("trap"), F.max("day"))
    return Widths(*top.first())


def _span(histories: DataFrame, n_traps: int | None, n_days: int | None) -> Widths:
    """The stated widths; one that is not stated is taken from the histories, and is no less than
    that of a session."""
    if n_traps is not None and n_days is not None:
        return Widths(n_traps, n_days)
    keys = F.map_keys("cells")
    found = histories.agg(
        F.max(F.greatest("max_traps", F.array_max(F.transform(keys, cell_trap)))),
        F.max(F.array_max(F.transform(keys, cell_day)))).first()
    return Widths(n_traps or max(MAX_TRAPS, found[0] or 0), n_days or max(N_DAYS, found[1] or 0))


def attach_site(df: DataFrame, lookup: DataFrame) -> DataFrame:
    """Left lookup by site letter against the site table (one row per site)."""
    return df.join(F.broadcast(lookup), "site", "left")


def attach_effort(df: DataFrame, effort: DataFrame) -> DataFrame:
    """Left lookup of the number of traps by site number."""
    return df.join(F.broadcast(effort.select("site_num", "max_traps")), "site_num", "left")


def trap_grid(effort: DataFrame) -> DataFrame:
    """site_num x trap, only traps that exist."""
    return effort.select("site_num", "max_traps",
                         F.explode(F.sequence(F.lit(1), "max_traps")).alias("trap"))


def trap_day_grid(effort: DataFrame, n_days: int = N_DAYS) -> DataFrame:
    return trap_grid(effort).withColumn("day", F.explode(F.sequence(F.lit(1), F.lit(n_days))))


def capture_counts(captures: DataFrame) -> DataFrame:
    return captures.groupBy("species", "site_num", "ind", "trap", "day", "sex").agg(
        F.count(F.lit(1)).alias("count"))


def individual_ids(counts: DataFrame) -> DataFrame:
    """Dense number of each individual inside its species and site."""
    return dense_ids(counts, ["species", "site_num"], "ind", "id_site")


def numbered_counts(captures: DataFrame) -> DataFrame:
    """Counts with ``id_site``; an unknown individual keeps a null number. The log is read once:
    the counts are settled before ids are taken from them, and the result is settled for the
    tables that are built on it (sizes, histories, placeholders, start values)."""
    counts = settle(capture_counts(captures))
    return settle(counts.join(individual_ids(counts), ["species", "site_num", "ind"], "left"))


def site_species(effort: DataFrame, caps: DataFrame) -> DataFrame:
    """Every species at every site: two lookup tables, one row per pair."""
    return effort.select("site_num", "max_traps").crossJoin(F.broadcast(caps))


def individuals_per_site(numbered: DataFrame, effort: DataFrame, caps: DataFrame) -> DataFrame:
    """n per species and site, 0 where nothing was caught; one row per pair of the lookups."""
    found = numbered.groupBy("species", "site_num").agg(F.max("id_site").alias("n"))
    return site_species(effort, caps).join(found, ["species", "site_num"], "left").withColumn(
        "n", F.coalesce("n", F.lit(0)))


def distinct_individuals(captures: DataFrame) -> DataFrame:
    """Distinct individuals per site; an unknown one counts once."""
    return (captures.select("species", "site_num", "ind").distinct()
            .groupBy("species", "site_num").agg(F.count(F.lit(1)).alias("n_ind")))


def augmentation_size(per_site: DataFrame, rate: float = CAPTURE_RATE, extra: int = 10,
                      empty: int = 500) -> DataFrame:
    """Raw size ``m_raw`` from an assumed capture rate and the whole, capped size ``m``."""
    raw = F.when(F.col("n") > 0, F.col("n") / F.lit(rate) + extra).otherwise(float(empty))
    return per_site.withColumn("m_raw", raw).withColumn(
        "m", F.least(F.floor("m_raw").cast("int"), F.col("cap")))


def older_augmentation_size(per_site: DataFrame, rate: float = 0.03, extra: int = 0,
                            floor_at: int = 0) -> DataFrame:
    """Earlier sizing: n / rate (+ extra) with a lower bound instead of a cap."""
    raw = F.col("n") / F.lit(rate) + extra
    return per_site.withColumn("m", F.greatest(F.floor(raw).cast("int"), F.lit(floor_at)))


def cell_key(trap: Column, day: Column) -> Column:
    """Trap and day side by side in one number, so that no two cells of any width share one."""
    return F.shiftleft(trap.cast("bigint"), 32) + day


def cell_trap(key: Column) -> Column:
    return F.shiftright(key, 32).cast("int")


def cell_day(key: Column) -> Column:
    return key.bitwiseAND((1 << 32) - 1).cast("int")


def in_range(n_days: int | None = None) -> Column:
    """Whether a capture lies on a trap that its site has and, if their number is stated, on one
    of its days."""
    trap = F.col("trap").between(1, F.col("max_traps")) & (F.col("day") >= 1)
    return trap if n_days is None else trap & (F.col("day") <= n_days)


def off_range(numbered: DataFrame, effort: DataFrame, n_days: int | None = None) -> DataFrame:
    """Counts at traps that the effort table does not grant, or after ``n_days``."""
    return attach_effort(numbered, effort).where(~F.coalesce(in_range(n_days), F.lit(False)))


def individual_histories(numbered: DataFrame, effort: DataFrame) -> DataFrame:
    """One row per individual: first capture day and its captured cells as a map.

    Counts are summed over sex to one value per trap and day first, so a map holds at most
    traps x days entries however often the individual was caught. Captures at a trap that the
    effort table does not grant stay in the map (``off_range`` lists them).
    One exchange on the individual serves both steps."""
    known = attach_effort(numbered, effort).where("max_traps IS NOT NULL")
    placed = known.repartition("species", "site_num", "ind")
    cells = placed.groupBy(*INDIVIDUAL, "max_traps", "trap", "day").agg(
        F.sum("count").alias("count"))
    return cells.groupBy(*INDIVIDUAL, "max_traps").agg(
        F.min("day").alias("first_day"),
        F.map_from_entries(F.collect_list(
            F.struct(cell_key(F.col("trap"), F.col("day")), "count"))).alias("cells"))


def placeholders(numbered: DataFrame, effort: DataFrame, caps: DataFrame,
                 n_days: int | None = None) -> DataFrame:
    """An unknown-individual row for each species and site with a trap-day that caught nothing
    (unless an unknown individual was caught there, which already makes that row). Days are those
    of ``widths`` unless stated."""
    n_days = n_days or widths(effort, numbered).days
    cells = attach_effort(numbered, effort).groupBy(
        "species", "site_num", "trap", "day", "max_traps").agg(
        F.max(F.col("ind").isNull()).alias("unknown"))
    used = cells.groupBy("species", "site_num").agg(
        F.count_if(in_range(n_days)).alias("used"), F.max("unknown").alias("unknown"))
    every = site_species(effort, caps).join(used, ["species", "site_num"], "left")
    return every.where(
        (F.coalesce("used", F.lit(0)) < F.col("max_traps") * n_days)
        & ~F.coalesce("unknown", F.lit(False))
    ).select("species", "site_num", F.lit(None).cast("bigint").alias("ind"),
             F.lit(None).cast("int").alias("id_site"), "max_traps",
             F.lit(None).cast("int").alias("first_day"),
             F.lit(None).cast("map<bigint,bigint>").alias("cells"))


def all_histories(numbered: DataFrame, effort: DataFrame, caps: DataFrame,
                  n_days: int | None = None) -> DataFrame:
    """Individuals and placeholders, one row each."""
    return individual_histories(numbered, effort).unionByName(
        placeholders(numbered, effort, caps, n_days))


def cell_count(trap: Column, day: Column) -> Column:
    """Count of one cell: null, 0 or n (see ``filled_count``)."""
    held = F.try_element_at("cells", cell_key(trap, day))
    known = (trap <= F.col("max_traps")) & F.col("ind").isNotNull()
    return F.when(known, F.coalesce(held, F.lit(0))).otherwise(held).cast("bigint")


def complete_history(histories: DataFrame, n_traps: int | None = None,
                     n_days: int | None = None) -> DataFrame:
    """Every individual x trap x day, as wide as the log."""
    span = _span(histories, n_traps, n_days)
    grid = histories.withColumn("trap", F.explode(F.sequence(F.lit(1), F.lit(span.traps)))) \
        .withColumn("day", F.explode(F.sequence(F.lit(1), F.lit(span.days))))
    return grid.select(*INDIVIDUAL, "trap", "day", "max_traps",
                       cell_count(F.col("trap"), F.col("day")).alias("count"))


def observed_history(histories: DataFrame, n_days: int | None = None) -> DataFrame:
    """Known individuals on existing traps only: the cells that enter a likelihood."""
    n_days = _span(histories, MAX_TRAPS, n_days).days
    known = histories.where(F.col("id_site").isNotNull())
    grid = known.withColumn("trap", F.explode(F.sequence(F.lit(1), "max_traps"))) \
        .withColumn("day", F.explode(F.sequence(F.lit(1), F.lit(n_days))))
    return grid.select(*INDIVIDUAL, "trap", "day", "first_day",
                       cell_count(F.col("trap"), F.col("day")).alias("count"))


def caught_cells(histories: DataFrame) -> DataFrame:
    """Captured cells of known individuals, wherever they were caught."""
    known = histories.where(F.col("id_site").isNotNull())
    return known.select(*INDIVIDUAL, "first_day", F.explode("cells").alias("_key", "count")).select(
        *INDIVIDUAL, "first_day", cell_trap(F.col("_key")).alias("trap"),
        cell_day(F.col("_key")).alias("day"), "count")


def daily_captures(histories: DataFrame, n_days: int | None = None) -> DataFrame:
    """Captures of every known individual on every day, summed inside its row."""
    n_days = _span(histories, MAX_TRAPS, n_days).days
    known = histories.where(F.col("id_site").isNotNull())
    caught = F.filter(F.map_entries("cells"), lambda cell: cell_day(cell["key"]) == F.col("day"))
    total = F.aggregate(caught, F.lit(0).cast("bigint"), lambda n, cell: n + cell["value"])
    return known.withColumn("day", F.explode(F.sequence(F.lit(1), F.lit(n_days)))).select(
        *INDIVIDUAL, "first_day", "day", total.alias("captures"))


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str],
                   how: str = "left") -> DataFrame:
    """Join in which a missing key matches a missing key; planned as an ordinary equi-join."""
    other = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    match = [left[k].eqNullSafe(other[f"_right_{k}"]) for k in keys]
    return left.join(other, match, how).drop(*[f"_right_{k}" for k in keys])


def older_history(numbered: DataFrame) -> DataFrame:
    """Expansion over the traps and days seen for the species only: a trap that caught nothing
    anywhere is lost. The lists hold trap and day numbers, one row per species."""
    cells = numbered.groupBy(*INDIVIDUAL, "trap", "day").agg(F.sum("count").alias("count"))
    lists = numbered.groupBy("species").agg(F.collect_set("trap").alias("traps"),
                                            F.collect_set("day").alias("days"))
    grid = attach(cells.select(*INDIVIDUAL).distinct(), lists, ["species"]) \
        .withColumn("trap", F.explode("traps")).withColumn("day", F.explode("days")) \
        .drop("traps", "days")
    return null_safe_join(grid, cells, [*INDIVIDUAL, "trap", "day"])


def history_wide(histories: DataFrame, n_traps: int | None = None, n_days: int | None = None,
                 prefix: str = "trap_") -> DataFrame:
    """One row per individual and day, one column per trap, straight from the individual rows."""
    span = _span(histories, n_traps, n_days)
    days = histories.withColumn("day", F.explode(F.sequence(F.lit(1), F.lit(span.days))))
    return days.select(*INDIVIDUAL, "day", "max_traps", *[
        cell_count(F.lit(j), F.col("day")).alias(f"{prefix}{j}")
        for j in range(1, span.traps + 1)])


def capture_array(histories: DataFrame, n_traps: int | None = None,
                  n_days: int | None = None) -> DataFrame:
    """Dense export: per known individual a day x trap array. One row per individual keeps a
    site of any size spread over the cluster; ``id_site`` is the first array index."""
    span = _span(histories, n_traps, n_days)
    known = histories.where(F.col("id_site").isNotNull())
    slab = F.array(*[F.array(*[cell_count(F.lit(j), F.lit(k)) for j in range(1, span.traps + 1)])
                     for k in range(1, span.days + 1)])
    return known.select("species", "site_num", "id_site", slab.alias("slab"))


def recapture_flags(histories: DataFrame, n_days: int | None = None) -> DataFrame:
    """recap = 1 on each day after the first capture day. The running capture sum less the
    day's own, capped at one, is exactly this, so no window is needed."""
    n_days = _span(histories, MAX_TRAPS, n_days).days
    known = histories.where(F.col("id_site").isNotNull())
    return known.withColumn("day", F.explode(F.sequence(F.lit(1), F.lit(n_days)))).select(
        *INDIVIDUAL, "day", (F.col("day") > F.col("first_day")).cast("int").alias("recap"))


def recaptures_wide(histories: DataFrame, n_days: int | None = None) -> DataFrame:
    n_days = _span(histories, MAX_TRAPS, n_days).days
    known = histories.where(F.col("id_site").isNotNull())
    return known.select("species", "site_num", "id_site", *[
        (F.lit(k) > F.col("first_day")).cast("int").alias(f"day_{k}")
        for k in range(1, n_days + 1)])


def behaviour_from_flag(captures: DataFrame, n_days: int | None = None) -> DataFrame:
    """Earlier rule: 1 on every day after the first day marked as a new capture; individuals
    never marked stay 0."""
    n_days = n_days or max(N_DAYS, captures.agg(F.max("day")).first()[0] or 0)
    first = captures.groupBy("species", "site_num", "ind").agg(
        F.min(F.when(F.col("recap") == "N", F.col("day"))).alias("marked"))
    return first.withColumn("day", F.explode(F.sequence(F.lit(1), F.lit(n_days)))).select(
        "species", "site_num", "ind", "day",
        F.coalesce((F.col("day") > F.col("marked")).cast("int"), F.lit(0)).alias("behaviour"))


def captures_by_day(histories: DataFrame, n_days: int | None = None) -> DataFrame:
    """Captures per species and day over the sites; a day without any is 0."""
    n_days = _span(histories, MAX_TRAPS, n_days).days
    cells = histories.select("species", F.explode_outer("cells").alias("cell", "count"))
    days = F.array(*[F.lit(k) for k in range(1, n_days + 1)])
    sums = cells.groupBy("species").agg(*[
        F.coalesce(F.sum(F.when(cell_day(F.col("cell")) == k, F.col("count"))), F.lit(0))
        .alias(f"d{k}") for k in range(1, n_days + 1)])
    return sums.select("species", F.explode(F.arrays_zip(
        days.alias("day"), F.array(*[f"d{k}" for k in range(1, n_days + 1)]).alias("caps")))
        .alias("x")).select("species", "x.day", "x.caps")


def individual_covariates(captures: DataFrame) -> DataFrame:
    """Means per individual and site; a mean is null as soon as one measurement is missing."""
    def strict_mean(name: str) -> Column:
        return F.when(F.count(name) == F.count(F.lit(1)), F.avg(name))
    return captures.groupBy("site_num", "site", "ind", "species", "sex").agg(
        strict_mean("carapace").alias("carapace"), strict_mean("mass").alias("mass"),
        F.count(F.lit(1)).alias("n_measurements"), strict_mean("trap").alias("mean_trap"))


def observed_activity_centres(histories: DataFrame, spacing: float = 25.0) -> DataFrame:
    """Mean captured trap per individual as a place along the canal in 100 m; each captured
    trap-day weighs one."""
    traps = F.transform(F.map_keys("cells"), lambda key: cell_trap(key).cast("double"))
    mean = F.aggregate(traps, F.lit(0.0), lambda a, x: a + x) / F.size(traps)
    return histories.where(F.col("id_site").isNotNull()).select(
        "species", "site_num", "id_site", ((mean - 1) * spacing / 100).alias("loc"))


def first_sex(numbered: DataFrame) -> DataFrame:
    """One sex per individual; conflicting records leave it unknown."""
    return numbered.where(F.col("id_site").isNotNull()).groupBy(
        "species", "site_num", "id_site").agg(
        F.when(F.min("sex") == F.max("sex"), F.min("sex")).alias("sex"))
