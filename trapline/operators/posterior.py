"""Summaries of posterior draws.

Draws are long: (chain, iteration, parameter, value). One parameter may hold any share of the rows,
so nothing here gathers a parameter in one task: aggregates are partial first, quantiles come from
``ranks.value_positions`` and per-parameter numbers return through ``session.attach``."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trapline.functions.probability import (erlang_cdf, gamma_density, normal_quantile, uniform)
from trapline.operators.model import home_range, sigma_from_alpha1
from trapline.operators.ranks import exact_quantiles
from trapline.operators.summaries import summary_table
from trapline.session import attach, settle, spread

# Grid points of a density handled by one row of work.
CHUNK = 32


def thin(draws: DataFrame, burn: int, every: int, renumber: bool = True) -> DataFrame:
    """Iterations after the burn-in, each ``every``-th; a range on iteration reaches the scan.
    Kept iterations are renumbered 1, 2, ... unless told otherwise."""
    kept = draws.where((F.col("iteration") > burn)
                       & ((F.col("iteration") - burn) % every == 0))
    if not renumber:
        return kept
    return kept.withColumn("iteration", ((F.col("iteration") - burn) / every).cast("bigint"))


def trace(draws: DataFrame) -> DataFrame:
    return draws.select("parameter", "chain", "iteration", "value")


def _bins(draws: DataFrame, groups: list[str], bins: int) -> DataFrame:
    """Every equal-width bin of a group, also the empty ones; the last bin is closed, and the
    values of a constant group lie in its first bin of no width."""
    span = settle(draws.groupBy(*groups).agg(
        F.min("value").alias("_low"), F.max("value").alias("_high"),
        F.count("value").alias("_rows")).where("_rows > 0").withColumn(
        "_width", (F.col("_high") - F.col("_low")) / bins))
    placed = attach(draws.where(F.col("value").isNotNull()), span, groups)
    place = F.coalesce(F.floor(F.try_divide(F.col("value") - F.col("_low"), F.col("_width"))),
                       F.lit(0))
    counts = placed.groupBy(*groups, F.least(place.cast("int"), F.lit(bins - 1)).alias(
        "bin")).agg(F.count(F.lit(1)).alias("n"))
    every = span.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return every.join(counts, [*groups, "bin"], "left").withColumn(
        "n", F.coalesce("n", F.lit(0)))


def histogram(draws: DataFrame, groups: list[str], bins: int = 30) -> DataFrame:
    return _bins(draws, groups, bins).select(
        *groups, "bin", (F.col("_low") + F.col("bin") * F.col("_width")).alias("bin_start"), "n",
        F.try_divide(F.col("n").cast("double"), F.col("_rows") * F.col("_width")).alias("density"))


def frequency_polygon(draws: DataFrame, groups: list[str], bins: int = 50) -> DataFrame:
    return _bins(draws, groups, bins).select(
        *groups, "bin", (F.col("_low") + (F.col("bin") + 0.5) * F.col("_width")).alias("mid"),
        F.try_divide(F.col("n").cast("double"), F.col("_rows") * F.col("_width")).alias("density"))


def density_setup(draws: DataFrame, groups: list[str], points: int,
                  quartiles: DataFrame | None = None) -> DataFrame:
    """Per group: rows, bandwidth 0.9 min(sd, IQR / 1.34) n^(-1/5), grid start and step. The grid
    reaches three bandwidths past the data. Where ties make the smaller spread 0, the deviation
    serves, else the size of the one value, else 1. ``quartiles`` (q1, q3) may be at hand."""
    if quartiles is None:
        quartiles = exact_quantiles(draws, groups, "value", {"q1": 0.25, "q3": 0.75})
    spread = draws.groupBy(*groups).agg(
        F.count("value").alias("n"), F.stddev_samp("value").alias("sd"),
        F.min("value").alias("low"), F.max("value").alias("high"))
    least = F.least("sd", (F.col("q3") - F.col("q1")) / 1.34)
    width = F.when(least > 0, least).when(F.col("sd") > 0, F.col("sd")).when(
        F.abs("low") > 0, F.abs("low")).otherwise(1.0)
    bw = 0.9 * width * F.pow("n", F.lit(-0.2))
    return spread.where("n > 0").join(quartiles, groups).withColumn("bw", bw).select(
        *groups, "n", "bw", (F.col("low") - 3 * F.col("bw")).alias("start"),
        ((F.col("high") - F.col("low") + 6 * F.col("bw")) / (points - 1)).alias("step"))


def kde(draws: DataFrame, groups: list[str], points: int = 512,
        quartiles: DataFrame | None = None) -> DataFrame:
    """Gaussian kernel density on a regular grid.

    Every draw gives its weight to the two grid points around it, so the draws are read once and
    shrink to at most ``points`` weights per group before the kernel is applied; the kernel sum
    runs over grid weights and no longer grows with the draws."""
    setup = settle(density_setup(draws, groups, points, quartiles))
    placed = attach(draws.where(F.col("value").isNotNull()), setup, groups)
    at = (F.col("value") - F.col("start")) / F.col("step")
    left = F.least(F.floor(at), F.lit(points - 2)).cast("int")
    shares = F.array(F.struct(left.alias("k"), (1 - (at - left)).alias("w")),
                     F.struct((left + 1).alias("k"), (at - left).alias("w")))
    weights = placed.select(*groups, F.explode(shares).alias("x")).groupBy(
        *groups, F.col("x.k").alias("k")).agg(F.sum("x.w").alias("w"))
    held = weights.groupBy(*groups).agg(F.collect_list(F.struct("k", "w")).alias("weights"))
    chunks = attach(held, setup, groups).withColumn("_chunk", F.explode(
        F.sequence(F.lit(0), F.lit((points - 1) // CHUNK))))
    grid = spread(chunks, *groups, "_chunk").withColumn("point", F.explode(F.sequence(
        F.col("_chunk") * CHUNK, F.least((F.col("_chunk") + 1) * CHUNK, F.lit(points)) - 1)))
    ratio = F.col("step") / F.col("bw")

    def kernel(total: Column, x: Column) -> Column:
        u = (F.col("point") - x["k"]) * ratio
        return total + x["w"] * F.exp(-0.5 * u * u)

    height = F.aggregate("weights", F.lit(0.0), kernel)
    return grid.select(
        *groups, "point", (F.col("start") + F.col("point") * F.col("step")).alias("x"),
        (height / (F.col("n") * F.col("bw") * 2.5066282746310002)).alias("density"))


def chain_quantiles(draws: DataFrame) -> DataFrame:
    return exact_quantiles(draws, ["parameter", "chain"], "value",
                           {"q10": 0.1, "q50": 0.5, "q90": 0.9})


def _limits(inner: float, outer: float) -> dict[str, float]:
    return {"outer_low": (1 - outer) / 2, "inner_low": (1 - inner) / 2, "median": 0.5,
            "inner_high": (1 + inner) / 2, "outer_high": (1 + outer) / 2}


def intervals(draws: DataFrame, inner: float = 0.5, outer: float = 0.9) -> DataFrame:
    return exact_quantiles(draws, ["parameter"], "value", _limits(inner, outer))


def areas(draws: DataFrame, points: int = 512, inner: float = 0.5,
          outer: float = 0.9) -> DataFrame:
    """Density of every parameter scaled to a top of one, with the interval each point is in."""
    limits = settle(exact_quantiles(draws, ["parameter"], "value", {
        **_limits(inner, outer), "q1": 0.25, "q3": 0.75}))
    curve = settle(kde(draws, ["parameter"], points, limits.select("parameter", "q1", "q3")))
    top = curve.groupBy("parameter").agg(F.max("density").alias("_top"))
    rows = attach(curve, top.join(limits, "parameter"), ["parameter"])
    band = (F.when(F.col("x").between(F.col("inner_low"), F.col("inner_high")), "inner")
            .when(F.col("x").between(F.col("outer_low"), F.col("outer_high")), "outer")
            .otherwise("tail"))
    return rows.select("parameter", "point", "x", (F.col("density") / F.col("_top"))
                       .alias("height"), band.alias("band"))


def posterior_summary(draws: DataFrame) -> DataFrame:
    """Mean, sd and the 2.5, 5, 50, 95 and 97.5 % points per parameter."""
    moments = draws.groupBy("parameter").agg(
        F.count("value").alias("n_draws"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("sd"))
    points = exact_quantiles(draws, ["parameter"], "value", {
        "q2_5": 0.025, "q5": 0.05, "q50": 0.5, "q95": 0.95, "q97_5": 0.975})
    return moments.join(points, "parameter")


def draw_statistics(draws: DataFrame) -> DataFrame:
    return draws.groupBy("parameter").agg(
        F.stddev_samp("value").alias("sd"), F.max("value").alias("largest"),
        F.min("value").alias("smallest"))


def draws_wide(draws: DataFrame, parameters: list[str], names: list[str]) -> DataFrame:
    """One row per draw with a column per listed parameter."""
    wide = draws.where(F.col("parameter").isin(*parameters)).groupBy("chain", "iteration").agg(*[
        F.max(F.when(F.col("parameter") == p, F.col("value"))).alias(n)
        for p, n in zip(parameters, names)])
    return wide


def site_of(parameter: Column) -> Column:
    """Site number of N[g] or N.g. ."""
    return F.regexp_extract(parameter, r"^N[\[.](\d+)[\].]$", 1)


def _site_abundance(draws: DataFrame) -> DataFrame:
    found = site_of(F.col("parameter"))
    return draws.where(found != "").withColumn("site_num", found.cast("int"))


def abundance_check(draws: DataFrame, per_site: DataFrame) -> DataFrame:
    """Six numbers of N[g] per site and whether no draw is below the individuals caught there."""
    numbers = summary_table(_site_abundance(draws), ["site_num"], "value")
    return numbers.join(F.broadcast(per_site.select("species", "site_num", "n")),
                        "site_num").withColumn("check", F.col("minimum") >= F.col("n"))


def proportion_captured(draws: DataFrame, per_site: DataFrame) -> DataFrame:
    """n / N per draw and site; null where a draw has N = 0."""
    sizes = F.broadcast(per_site.select("species", "site_num", "n"))
    return _site_abundance(draws).join(sizes, "site_num").select(
        "species", "site_num", "chain", "iteration",
        F.try_divide(F.col("n").cast("double"), F.col("value")).alias("p"))


def prior_against_posterior(draws: DataFrame, parameter: str = "sigma", shape: int = 5,
                            rate: float = 1.25, bins: int = 50) -> DataFrame:
    """Prior density and posterior frequency polygon of one parameter, both at the middles of the
    bins of its draws."""
    chosen = draws.where(F.col("parameter") == parameter)
    prior = gamma_density(F.col("mid"), F.lit(shape), F.lit(rate))
    return frequency_polygon(chosen, ["parameter"], bins).select(
        F.col("mid").alias("x"), F.explode(F.array(
            F.struct(F.lit("prior").alias("source"), prior.alias("density")),
            F.struct(F.lit("posterior").alias("source"), F.col("density").alias("density"))
        )).alias("_d")).select("_d.source", "x", "_d.density")


def prior_pushforward(keys: DataFrame, key: str, seed: int = 7, mean: float = 1.5,
                      sd: float = 2.0, least: float = 0.02) -> DataFrame:
    """One normal draw of alpha1 per key, kept above ``least``, pushed to sigma and home range.
    Draws depend on the key only, so they do not change with the partitioning. The cut is made on
    the uniform, where it is one comparison."""
    u = uniform(seed, F.col(key)) * (1 - 2.0 ** -52) + 2.0 ** -53
    floor = 0.5 * math.erfc((mean - least) / sd / math.sqrt(2.0))
    kept = keys.select(key, u.alias("_u")).where(F.col("_u") >= floor)
    drawn = kept.select(key, (mean + sd * normal_quantile(F.col("_u"))).alias("alpha1"))
    sigma = drawn.withColumn("sigma", sigma_from_alpha1(F.col("alpha1")))
    return sigma.withColumn("home_range", 4.0 * F.col("sigma") * 100.0)


def gamma_from_moments(rows: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Shape and rate whose mean and variance are those of the group."""
    moments = rows.groupBy(*groups).agg(F.avg(value).alias("mean"),
                                        F.stddev_samp(value).alias("sd"))
    m, v = F.col("mean"), F.col("sd") * F.col("sd")
    return moments.select(*groups, F.try_divide(m * m, v).alias("shape"),
                          F.try_divide(m, v).alias("rate"))


def gamma_density_table(priors: DataFrame, step: float = 0.05, high: float = 10.0) -> DataFrame:
    """Density on 0, step, ..., high for each (integer shape, rate)."""
    n = int(round(high / step))
    grid = priors.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(n))))
    x = F.col("point") * F.lit(high) / n
    return grid.select("shape", "rate", "point", x.alias("x"),
                       gamma_density(x, F.col("shape"), F.col("rate")).alias("density"))


def gamma_mass(priors: DataFrame) -> DataFrame:
    """Mass below 1, below 2 and between 2 and 6 for each (integer shape, rate)."""
    def below(x: float) -> Column:
        return erlang_cdf(F.lit(x), F.col("shape"), F.col("rate"))
    return priors.select("shape", "rate", below(1.0).alias("below_1"), below(2.0).alias("below_2"),
                         (below(6.0) - below(2.0)).alias("between_2_6"))


def empirical_mass(draws: DataFrame, low: float, high: float) -> DataFrame:
    inside = F.when((F.col("value") > low) & (F.col("value") <= high), 1.0).otherwise(0.0)
    return draws.groupBy("parameter").agg(F.avg(inside).alias("mass"))


def home_ranges(draws: DataFrame, parameter: str = "sigma") -> DataFrame:
    """Home range lengths holding 50 and 95 % of use, per draw of sigma."""
    sigma = F.col("value")
    return draws.where(F.col("parameter") == parameter).select(
        "chain", "iteration", home_range(sigma, 0.675).alias("home_50"),
        home_range(sigma, 1.96).alias("home_95"))
