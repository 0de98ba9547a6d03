"""Convergence statistics of long draw tables: PSRF, rank-normalised R-hat and ESS.

Draws must be numbered 1, 2, ... inside each chain (``posterior.thin`` does). A series is cut into
blocks, and blocks meet in pairs as far apart as the lag, so lag products of a chain of any length
and any lag are tiles of two blocks; ranks come from ``ranks``, which cuts hot parameters into
ranges."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trapline.functions.probability import normal_quantile
from trapline.operators.filters import with_base
from trapline.operators.posterior import posterior_summary
from trapline.operators.ranks import (average_ranks, exact_quantiles, picked_quantiles,
                                      value_positions)
from trapline.session import attach, counted, measured, settle

BLOCK = 4096
FIRST_LAGS = 64


def psrf(draws: DataFrame) -> DataFrame:
    """Potential scale reduction with the degrees-of-freedom factor, per parameter. Raises unless
    the chains of a parameter are of equal length; the second step sees one row per chain and
    parameter."""
    chains = settle(draws.groupBy("parameter", "chain").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"),
        F.var_samp("value").alias("s2")))
    unequal = chains.groupBy("parameter").agg((F.min("n") != F.max("n")).alias("odd")).where("odd")
    if not unequal.isEmpty():
        raise ValueError("the chains of a parameter must be of equal length")
    t = chains.groupBy("parameter").agg(
        F.count(F.lit(1)).cast("double").alias("m"), F.min("n").cast("double").alias("n"),
        F.avg("s2").alias("w"), F.var_samp("mean").alias("vm"), F.var_samp("s2").alias("vs"),
        F.avg("mean").alias("mu"),
        F.covar_samp("s2", F.col("mean") * F.col("mean")).alias("c2"),
        F.covar_samp("s2", "mean").alias("c1"))
    m, n, w = F.col("m"), F.col("n"), F.col("w")
    b = n * F.col("vm")
    t = t.withColumn("b", b).withColumn("v", (n - 1) / n * w + (1 + 1 / m) * F.col("vm"))
    spread = ((n - 1) * (n - 1) * F.col("vs") / m
              + (1 + 1 / m) * (1 + 1 / m) * 2 * F.col("b") * F.col("b") / (m - 1)
              + 2 * (n - 1) * (1 + 1 / m) * (n / m)
              * (F.col("c2") - 2 * F.col("mu") * F.col("c1"))) / (n * n)
    df = F.try_divide(2 * F.col("v") * F.col("v"), spread)
    factor = F.coalesce(F.try_divide(df + 3, df + 1), F.lit(1.0))
    return t.select("parameter", F.sqrt(factor * F.try_divide(F.col("v"), w)).alias("psrf"))


def lag_blocks(series: DataFrame, keys: list[str], position: str = "iteration",
               value: str = "value") -> tuple[DataFrame, DataFrame, int]:
    """A series cut into blocks of ``BLOCK`` values in order: settled rows ``keys``, ``block`` and
    ``x``; its ``mean`` and length ``n`` per series, settled, and the number of series. A task that
    makes a block sees the rows of that block only."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(position).alias("at"),
                                                   F.col(value).alias("x"))))
    blocks = settle(series.groupBy(*keys, F.floor((F.col(position) - 1) / BLOCK).alias(
        "block")).agg(F.transform(ordered, lambda v: v["x"]).alias("x")))
    present = F.filter("x", lambda v: v.isNotNull())
    total = F.aggregate(present, F.lit(0.0), lambda a, v: a + v.cast("double"))
    stats, rows = counted(blocks.groupBy(*keys).agg(
        F.sum(F.size(present)).alias("n"), F.sum(total).alias("_total")).select(
        *keys, "n", F.try_divide("_total", "n").alias("mean")))
    return blocks, stats, rows


def lag_products(blocks: DataFrame, wanted: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """``keys``, ``lag``, ``product``: sums of products of deviations a lag apart, for the lags
    ``first`` to ``last`` of each series of ``wanted`` (which has its ``mean`` too and ``rows``
    rows).

    Two rows a lag apart lie in blocks that are floor(lag / BLOCK) or one more apart, so the plane
    of positions and lags is cut into tiles: a block meets the block j further on, a task holds
    two blocks whatever the lag, and partial products are summed."""
    own = attach(blocks, wanted, keys, rows=rows)
    x = own.withColumn("_apart", F.explode(F.sequence(
        F.floor(F.col("first") / BLOCK), F.ceil(F.col("last") / BLOCK))))
    tiles = x.withColumn("block", F.col("block") + F.col("_apart")).join(
        blocks.withColumnRenamed("x", "_y"), [*keys, "block"])
    fields = {f.name: f.dataType.simpleString() for f in blocks.schema.fields}
    schema = ", ".join([*[f"{k} {fields[k]}" for k in keys], "lag int, product double"])
    parts = tiles.select(*keys, "_apart", "first", "last", "mean", "x", "_y").mapInArrow(
        _tile_sums(len(keys), BLOCK), schema)
    return parts.groupBy(*keys, "lag").agg(F.sum("product").alias("product"))


def _tile_sums(width: int, size: int):
    """Products of the tiles of a task, those of one series and distance summed."""
    def deviations(values, mean: float) -> np.ndarray:
        return np.nan_to_num(values.values.to_numpy(zero_copy_only=False).astype(float) - mean)

    def rows(held: dict, fields):
        columns = [np.repeat([k[i] for k in held], [len(p) for p in held.values()])
                   for i in range(width)] if held else [[] for _ in range(width)]
        lags = np.concatenate([np.zeros(0, int), *[
            np.arange(k[-1], k[-1] + len(p)) for k, p in held.items()]])
        sums = np.concatenate([np.zeros(0), *held.values()])
        return pa.RecordBatch.from_arrays(
            [*[pa.array(c, f.type) for c, f in zip(columns, fields)],
             pa.array(lags, pa.int32()), pa.array(sums, pa.float64())],
            [*[f.name for f in fields], "lag", "product"])

    def run(batches):
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            fields = [batch.schema.field(i) for i in range(width)]
            known = [batch.column(i).to_pylist() for i in range(width + 4)]
            for i, (*series, apart, first, last, mean) in enumerate(zip(*known)):
                # lags of the tile: apart * size and less than a block to either side
                low = max(first, (apart - 1) * size + 1)
                high = min(last, (apart + 1) * size - 1)
                if low > high:
                    continue
                x = deviations(batch.column(width + 4)[i], mean)
                y = deviations(batch.column(width + 5)[i], mean)
                begin, end = low - apart * size, high - apart * size + len(x)
                z = np.zeros(end - begin)
                a, b = max(begin, 0), min(end, len(y))
                z[a - begin:max(a, b) - begin] = y[a:max(a, b)]
                key = (*series, apart, low)
                sums = np.correlate(z, x, "valid")
                held[key] = held[key] + sums if key in held else sums
            if len(held) >= 256:
                yield rows(held, fields)
                held = {}
        if held:
            yield rows(held, fields)
    return run


def autocovariance(series: DataFrame, keys: list[str], max_lag: int, first_lag: int = 0,
                   position: str = "iteration", value: str = "value") -> DataFrame:
    """Per series and lag: sum of products of deviations a lag apart, divided by the length.
    Positions are 1, 2, ...; a null value counts for nothing."""
    blocks, stats, rows = lag_blocks(series, keys, position, value)
    wanted = stats.withColumns({
        "first": F.lit(first_lag), "last": F.least(F.lit(max_lag), F.col("n") - 1).cast("int")})
    products = lag_products(blocks, wanted.where("first <= last").drop("n"), keys, rows)
    return attach(products, stats.drop("mean"), keys, rows=rows).select(
        *keys, "lag", (F.col("product") / F.col("n")).alias("autocovariance"))


def effective_size(draws: DataFrame) -> DataFrame:
    """Effective size per parameter from the spectrum at zero of an autoregression fitted to each
    chain (order by AIC up to 10 log10 n), summed over the chains."""
    keys = ["parameter", "chain"]
    chain_lengths(draws)
    blocks, stats, rows = lag_blocks(draws, keys)
    wanted = stats.select(*keys, "mean", F.lit(0).alias("first"), F.least(
        F.greatest(F.lit(1), F.floor(10 * F.log10("n"))), F.col("n") - 1).cast("int").alias("last"))
    lags = lag_products(blocks, wanted, keys, rows)
    vectors = lags.groupBy(*keys).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("lag", "product"))), lambda p: p["product"]).alias(
        "products"))
    per_chain = attach(vectors, stats.drop("mean"), keys, rows=rows).withColumn(
        "cov", F.transform("products", lambda p: p / F.col("n")))
    return per_chain.groupBy("parameter").agg(
        F.sum(autoregressive_size(F.col("cov"), F.col("n"))).alias("ess"),
        F.sum("n").alias("n_draws")).select(
        "parameter", "ess", (F.col("ess") / F.col("n_draws")).alias("ratio"))


def autoregressive_size(cov: Column, n: Column) -> Column:
    """n var / spectrum(0) from the autocovariances at lags 0, 1, ...: the Levinson-Durbin
    recursion as a fold over the lags. Its state is the order, the coefficients and the error of
    the fit so far and of the fit of least AIC; a chain without variance has size 0."""
    fit = "struct<coefficients:array<double>,error:double,aic:double,best:struct<" \
          "aic:double,error:double,order:int,total:double>>"
    length = n.cast("double")
    start = length * F.log(cov[0])
    empty = F.array().cast("array<double>")
    first = F.struct(empty.alias("coefficients"), cov[0].alias("error"), start.alias("aic"), F.struct(
        start.alias("aic"), cov[0].alias("error"), F.lit(0).alias("order"),
        F.lit(0.0).alias("total")).alias("best")).cast(fit)

    def summed(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)

    def step(state: Column, p: Column) -> Column:
        """The fit of order p; once the error is not positive the state stays as it is."""
        old, error = state["coefficients"], state["error"]
        back = F.reverse(F.slice(cov, F.lit(2), p - 1))
        reflection = (F.element_at(cov, p + 1) - summed(F.zip_with(
            old, back, lambda a, c: a * c))) / error
        # a value of one element names the reflection once for the terms that follow
        return F.element_at(F.transform(F.array(reflection), lambda r: fitted(state, p, r)), 1)

    def fitted(state: Column, p: Column, r: Column) -> Column:
        old = state["coefficients"]
        new = F.concat(F.zip_with(old, F.reverse(old), lambda a, c: a - r * c), F.array(r))
        error = state["error"] * (1 - r * r)
        aic = length * F.log(error) + 2 * p
        best = F.when(aic < state["best"]["aic"], F.struct(
            aic.alias("aic"), error.alias("error"), p.cast("int").alias("order"),
            summed(new).alias("total"))).otherwise(state["best"])
        return F.when((state["error"] <= 0) | (error <= 0), F.struct(
            old.alias("coefficients"), F.lit(0.0).alias("error"), state["aic"].alias("aic"),
            state["best"].alias("best")).cast(fit)).otherwise(F.struct(
                new.alias("coefficients"), error.alias("error"), aic.alias("aic"),
                best.alias("best")).cast(fit))

    orders = F.when(F.size(cov) > 1, F.sequence(F.lit(1), F.size(cov) - 1)).otherwise(
        F.array().cast("array<int>"))

    def size(best: Column) -> Column:
        at_zero = best["error"] * length / (length - best["order"] - 1) / F.pow(
            1 - best["total"], F.lit(2.0))
        return length * (cov[0] * length / (length - 1)) / at_zero

    return F.when((n < 2) | (cov[0] <= 0), F.lit(0.0)).otherwise(
        F.aggregate(orders, first, step, lambda state: size(state["best"])))


def chain_lengths(draws: DataFrame) -> tuple[DataFrame, int]:
    """Draws per parameter and chain, settled, and how many rows these are; raises unless they
    are numbered 1, 2, ... without gaps."""
    whole = (F.col("n") == F.col("values")) & (F.col("low") == 1)
    lengths, seen = measured(draws.groupBy("parameter", "chain").agg(
        F.max("iteration").alias("n"), F.min("iteration").alias("low"),
        F.count("value").alias("values")), rows=F.count(F.lit(1)),
        odd=F.count_if(~F.coalesce(whole, F.lit(False))))
    if seen["odd"]:
        raise ValueError("number the draws 1, 2, ... in each chain (see posterior.thin)")
    return lengths.select("parameter", "chain", "n"), seen["rows"]


def split_halves(draws: DataFrame) -> DataFrame:
    """Each chain in two halves of equal length, the middle draw of an odd chain dropped. Adds
    ``half`` and renumbers iterations inside the half."""
    lengths, count = chain_lengths(draws)
    rows = attach(draws, lengths.withColumnRenamed("n", "_n"), ["parameter", "chain"], rows=count)
    size = F.floor(F.col("_n") / 2)
    second = F.col("iteration") > F.col("_n") - size
    kept = rows.where((F.col("iteration") <= size) | second)
    return kept.select(
        "parameter", "chain", second.cast("int").alias("half"),
        F.when(second, F.col("iteration") - (F.col("_n") - size))
        .otherwise(F.col("iteration")).alias("iteration"), "value")


def ranked_values(halves: DataFrame) -> DataFrame:
    """Settled places of the distinct values of every parameter; quantiles and ranks share it."""
    return settle(value_positions(halves, ["parameter"], "value"))


def normal_scores(halves: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """Replace values by normal scores of their average ranks within the parameter. Ranks are
    taken per distinct value; the few values that hold a large share of a parameter are looked
    up by broadcast, the others by an even shuffle."""
    places = ranked_values(halves) if places is None else places
    scored = average_ranks(places).select("parameter", "value", "n", normal_quantile(
        (F.col("rank") - 0.375) / (F.col("total") + 0.25)).alias("z"))
    return lookup_values(halves, scored, "z").withColumn("value", F.col("z")).drop("z")


def lookup_values(draws: DataFrame, places: DataFrame, name: str, share: int = 1000) -> DataFrame:
    """Attach a per-value column. Values with more than 1/share of all rows number fewer than
    ``share``, which bounds their broadcast; the remaining keys are small by definition."""
    rows = places.agg(F.sum("n")).first()[0] or 0
    frequent = places.where(F.col("n") > rows / share).select("parameter", "value", name)
    rare = places.where(F.col("n") <= rows / share).select("parameter", "value", name)
    keys = ["parameter", "value"]
    if frequent.isEmpty():
        return draws.join(rare, keys)
    hot = F.broadcast(frequent)
    return draws.join(hot, keys).unionByName(
        draws.join(F.broadcast(frequent.select(*keys)), keys, "left_anti").join(rare, keys))


def split_rhat(halves: DataFrame) -> DataFrame:
    """sqrt(((N - 1) / N W + B / N) / W) over split chains."""
    parts = halves.groupBy("parameter", "chain", "half").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"),
        F.var_samp("value").alias("s2"))
    t = parts.groupBy("parameter").agg(F.min("n").alias("n"), F.avg("s2").alias("w"),
                                       F.var_samp("mean").alias("vm"))
    return t.select("parameter", F.sqrt(F.try_divide(
        (F.col("n") - 1) / F.col("n") * F.col("w") + F.col("vm"), F.col("w"))).alias("rhat"))


def rank_normalized_rhat(halves: DataFrame, places: DataFrame | None = None,
                         scores: DataFrame | None = None) -> DataFrame:
    """The larger of R-hat on normal scores and on normal scores of |x - median|. ``halves`` are
    split chains; pass their ranked values and normal scores when they are at hand."""
    places = ranked_values(halves) if places is None else places
    scores = normal_scores(halves, places) if scores is None else scores
    median = picked_quantiles(places, ["parameter"], "value", {"_median": 0.5})
    folded = attach(halves, median, ["parameter"]).withColumn(
        "value", F.abs(F.col("value") - F.col("_median"))).drop("_median")
    tails = split_rhat(normal_scores(folded)).withColumnRenamed("rhat", "rhat_folded")
    return split_rhat(scores).withColumnRenamed("rhat", "rhat_bulk").join(
        tails, "parameter").withColumn("rhat", F.greatest("rhat_bulk", "rhat_folded"))


def split_ess(halves: DataFrame, keys: list[str]) -> DataFrame:
    """Effective size per ``keys`` over split chains by the initial monotone sequence; a series
    without variance gets none.

    Lags are worked out in growing ranges. Each series has a range of its own, which ends at its
    own length, and leaves when it has met its first negative pair, so a series that mixes badly
    costs the others nothing and no lag is cut off."""
    parts = [*keys, "chain", "half"]
    blocks, stats, _ = lag_blocks(halves, parts)
    spread = F.aggregate("x", F.lit(0.0), lambda a, v: a + (v - F.col("mean")) * (
        v - F.col("mean")))
    deviations = blocks.join(stats, parts).groupBy(*parts, "n", "mean").agg(
        F.sum(spread).alias("_d"))
    base, count = counted(deviations.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("chains"), F.min("n").alias("n"),
        F.avg(F.try_divide("_d", F.col("n") - 1)).alias("w"),
        F.var_samp("mean").alias("vm")).where("w > 0"))
    waiting, waits, done, low, high = base.select(*keys, "n"), count, [], 0, FIRST_LAGS
    while waits:
        ends = attach(stats.drop("n"), waiting.withColumnRenamed("n", "_n"), keys, rows=waits)
        wanted, tiles = counted(ends.select(
            *parts, "mean", F.lit(low).alias("first"),
            F.least(F.lit(high), "_n").cast("int").alias("_end")).select(
            "*", (F.col("_end") - 1).alias("last")).drop("_end").where("first <= last"))
        products = attach(lag_products(blocks, wanted, parts, tiles), base, keys, rows=count)
        mean = products.groupBy(*keys, "lag", "n", "w", "vm", "chains").agg(
            (F.sum("product") / F.col("n") / F.col("chains")).alias("acov"))
        pairs = settle(mean.select(
            *keys, F.floor(F.col("lag") / 2).alias("pair"), correlation().alias("rho"), "n").groupBy(
            *keys, "pair", "n").agg(F.sum("rho").alias("p"), F.count(F.lit(1)).alias("terms"))
            .where("terms = 2").drop("terms"))
        done.append(pairs.drop("n"))
        waiting, waits = counted(pairs.groupBy(*keys, "n").agg(F.min("p").alias("least")).where(
            F.col("least").isNull() | (F.col("least") >= 0)).where(
            F.col("n") > high).select(*keys, "n"))
        low, high = high, high * 4
    if not done:
        return base.select(*keys, F.lit(None).cast("double").alias("ess"))
    every = reduce(DataFrame.unionByName, done)
    return base.join(every.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(
        "pair", "p"))).alias("pairs")), keys, "left").select(*keys, monotone_size().alias("ess"))


def monotone_size() -> Column:
    """Effective size from the sums of pairs of autocorrelations in order (``pairs``): the running
    least of those before the first negative one is summed. There are at most as many as one
    chain has pairs of lags before its first negative pair, rounded up to the range."""
    start = F.struct(F.lit(0.0).alias("total"), F.lit(float("inf")).alias("least"),
                     F.lit(False).alias("met"))

    def step(state: Column, pair: Column) -> Column:
        met = state["met"] | (pair["p"] < 0)
        least = F.least(state["least"], pair["p"])
        return F.struct(F.when(met, state["total"]).otherwise(state["total"] + least).alias(
            "total"), least.alias("least"), met.alias("met"))

    total = (F.col("chains") * F.col("n")).cast("double")
    kept = F.coalesce(F.aggregate("pairs", start, step, lambda s: s["total"]), F.lit(0.0))
    return total / F.greatest(-1 + 2 * kept, 1 / F.log10(total))


def correlation() -> Column:
    """Autocorrelation at a lag from the mean autocovariance of the split chains."""
    plus = (F.col("n") - 1) / F.col("n") * F.col("w") + F.col("vm")
    return F.when(F.col("lag") == 0, F.lit(1.0)).otherwise(
        1 - (F.col("w") - F.col("acov")) / plus)


def bulk_ess(scores: DataFrame) -> DataFrame:
    """Effective size of the normal scores of split chains."""
    return split_ess(scores, ["parameter"]).withColumnRenamed("ess", "bulk_ess")


def tail_marks(halves: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """Indicators of lying at or below the 5 % and the 95 % point, as two series (``side``)."""
    probs = {"_low": 0.05, "_high": 0.95}
    limits = exact_quantiles(halves, ["parameter"], "value", probs) if places is None \
        else picked_quantiles(places, ["parameter"], "value", probs)
    rows = attach(halves, limits, ["parameter"])
    sides = F.array(*[F.struct(F.lit(name).alias("side"), (F.col("value") <= F.col(limit)).cast(
        "double").alias("mark")) for name, limit in (("low", "_low"), ("high", "_high"))])
    return rows.withColumn("_s", F.explode(sides)).select(
        "parameter", "_s.side", "chain", "half", "iteration", F.col("_s.mark").alias("value"))


def tail_ess(halves: DataFrame) -> DataFrame:
    """The smaller effective size of the two tail indicators of split chains."""
    return split_ess(tail_marks(halves), ["parameter", "side"]).groupBy("parameter").agg(
        F.min("ess").alias("tail_ess"))


def monitor(draws: DataFrame) -> DataFrame:
    """R-hat, bulk and tail ESS per parameter. Halves, ranked values and scores are made once and
    the three series of the two sizes (scores, low tail, high tail) share their lag passes."""
    halves = settle(split_halves(draws))
    places = ranked_values(halves)
    scores = settle(normal_scores(halves, places))
    series = scores.withColumn("side", F.lit("bulk")).unionByName(tail_marks(halves, places))
    sizes = split_ess(series, ["parameter", "side"]).groupBy("parameter").agg(
        F.max(F.when(F.col("side") == "bulk", F.col("ess"))).alias("bulk_ess"),
        F.min(F.when(F.col("side") != "bulk", F.col("ess"))).alias("tail_ess"))
    return rank_normalized_rhat(halves, places, scores).join(sizes, "parameter", "left")


def printed_summary(draws: DataFrame, names: list[str] | None = None,
                    digits: int = 2) -> DataFrame:
    """Mean, sd, interval, scale reduction and effective size of the parameters whose base name
    is listed (all by default), rounded for print."""
    chosen = draws if names is None else with_base(draws, names)
    table = posterior_summary(chosen).join(psrf(chosen), "parameter", "left").join(
        effective_size(chosen).select("parameter", "ess"), "parameter", "left")
    return table.select(
        "parameter", *[F.round(c, digits).alias(c) for c in ("mean", "sd", "q2_5", "q50", "q97_5")],
        F.round("psrf", digits).alias("rhat"), F.round("ess", 0).alias("n_eff"))


def convergence_gate(monitored: DataFrame, target: float = 1.05) -> DataFrame:
    """Worst values over the parameters and whether R-hat meets its target."""
    return monitored.agg(
        F.max("rhat").alias("max_rhat"), F.min("bulk_ess").alias("min_bulk_ess"),
        F.min("tail_ess").alias("min_tail_ess")).withColumn(
        "converged", F.col("max_rhat") < target)
