"""Queries that summarise posterior draws."""

from __future__ import annotations

from pyspark.sql import functions as F

from trapline.operators import filters, posterior, summaries
from trapline.plans.inputs import Inputs
from trapline.plans.registry import query
from trapline.plans.views import normal_quantile, num, uniform


@query("thinned_draws", "draws", """
    SELECT chain, (iteration - 100) // 3 AS iteration, parameter, value FROM draws
    WHERE iteration > 100 AND (iteration - 100) % 3 = 0""")
def thinned_draws(t: Inputs):
    return posterior.thin(t.draws, 100, 3)


@query("trace", "draws", """
    SELECT parameter, chain, iteration, value FROM draws
    WHERE regexp_matches(parameter, 'sigma|beta')""")
def trace(t: Inputs):
    return posterior.trace(filters.matching(t.draws, ["sigma", "beta"]))


def bins_sql(source: str, keys: str, bins: int, place: str, name: str) -> str:
    names = [k.strip() for k in keys.split(",")]
    return f"""
    SELECT {', '.join('g.' + k for k in names)}, g.bin, g.low + (g.bin{place}) * g.width AS {name},
      coalesce(c.n, 0) AS n, coalesce(c.n, 0) / (g.total * nullif(g.width, 0)) AS density
    FROM (SELECT r.*, CAST(unnest(range(0, {bins})) AS INTEGER) AS bin FROM (
        SELECT {keys}, min(value) AS low, (max(value) - min(value)) / {bins} AS width,
          count(value) AS total FROM {source} GROUP BY ALL HAVING count(value) > 0) r) g
    LEFT JOIN (
      SELECT {', '.join('d.' + k for k in names)}, count(*) AS n,
        CAST(least(coalesce(floor((value - low) / nullif(width, 0)), 0), {bins - 1}) AS INTEGER)
          AS bin
      FROM (SELECT * FROM {source} WHERE value IS NOT NULL) d JOIN (SELECT {keys}, min(value) AS low,
          (max(value) - min(value)) / {bins} AS width FROM {source} GROUP BY ALL) r
      ON {' AND '.join(f'r.{k} = d.{k}' for k in names)} GROUP BY ALL) c
    ON {' AND '.join(f'c.{k} = g.{k}' for k in [*names, 'bin'])}"""


@query("histogram", "draws", bins_sql("draws", "parameter", 30, "", "bin_start"),
       "bin_start density")
def histogram(t: Inputs):
    return posterior.histogram(t.draws, ["parameter"], 30)


@query("frequency_polygon", "draws",
       "SELECT parameter, chain, bin, mid, density FROM ("
       + bins_sql("draws", "parameter, chain", 50, " + 0.5e0", "mid") + ")", "mid density")
def frequency_polygon(t: Inputs):
    return posterior.frequency_polygon(t.draws, ["parameter", "chain"], 50)


def _kde_sql(keys: str, points: int, source: str = "draws") -> str:
    names = [k.strip() for k in keys.split(",")]
    on = " AND ".join(f"a.{k} = b.{k}" for k in names)
    firsts = ", ".join(f"a.{k}" for k in names)
    return f"""
    WITH setup AS (
      SELECT {keys}, count(*) AS n, min(value) - 3 * any_value(bw) AS start, any_value(bw) AS bw,
        (max(value) - min(value) + 6 * any_value(bw)) / {points - 1} AS step
      FROM (SELECT a.*, b.bw FROM {source} a JOIN (
          SELECT {keys}, 0.9e0 * CASE WHEN lo > 0 THEN lo WHEN sd > 0 THEN sd
              WHEN abs(low) > 0 THEN abs(low) ELSE 1e0 END * power(n, -0.2e0) AS bw FROM (
            SELECT {keys}, count(*) AS n, min(value) AS low, stddev_samp(value) AS sd,
              least(stddev_samp(value), (quantile_cont(value, 0.75)
                - quantile_cont(value, 0.25)) / 1.34e0) AS lo
            FROM {source} GROUP BY ALL)) b ON {on}) GROUP BY ALL),
    placed AS (
      SELECT {firsts}, least(floor((a.value - b.start) / b.step), {points - 2}) AS k,
        (a.value - b.start) / b.step - least(floor((a.value - b.start) / b.step), {points - 2})
          AS share FROM {source} a JOIN setup b ON {on}),
    weights AS (
      SELECT {keys}, k, sum(w) AS w FROM (
        SELECT {keys}, k, 1 - share AS w FROM placed
        UNION ALL SELECT {keys}, k + 1, share FROM placed) GROUP BY ALL)
    SELECT {firsts}, CAST(g.point AS INTEGER) AS point, any_value(b.start + g.point * b.step) AS x,
      sum(a.w * exp(-0.5e0 * ((g.point - a.k) * b.step / b.bw) ** 2))
        / any_value(b.n * b.bw * sqrt(2 * pi())) AS density
    FROM weights a JOIN setup b ON {on} CROSS JOIN (SELECT unnest(range(0, {points})) AS point) g
    GROUP BY {firsts}, g.point"""


@query("kde", "draws", _kde_sql("parameter", 512), "x density")
def kde(t: Inputs):
    return posterior.kde(t.draws, ["parameter"], 512)


@query("kde_by_chain", "draws", _kde_sql("parameter, chain", 128), "x density")
def kde_by_chain(t: Inputs):
    return posterior.kde(t.draws, ["parameter", "chain"], 128)


@query("tied_kde", "tied_draws", _kde_sql("parameter", 128, "tied_draws"), "x density")
def tied_kde(t: Inputs):
    """Densities of counts that are mostly 0 and of a constant."""
    return posterior.kde(t.tied_draws, ["parameter"], 128)


@query("tied_histogram", "tied_draws", bins_sql("tied_draws", "parameter", 25, "", "bin_start"),
       "bin_start density")
def tied_histogram(t: Inputs):
    return posterior.histogram(t.tied_draws, ["parameter"], 25)


@query("tied_polygon", "tied_draws",
       "SELECT parameter, bin, mid, density FROM ("
       + bins_sql("tied_draws", "parameter", 25, " + 0.5e0", "mid") + ")", "mid density")
def tied_polygon(t: Inputs):
    return posterior.frequency_polygon(t.tied_draws, ["parameter"], 25)


@query("chain_quantiles", "draws", """
    SELECT parameter, chain, quantile_cont(value, 0.1) AS q10, quantile_cont(value, 0.5) AS q50,
      quantile_cont(value, 0.9) AS q90 FROM draws GROUP BY ALL""", "q10 q50 q90")
def chain_quantiles(t: Inputs):
    return posterior.chain_quantiles(t.draws)


LIMITS = """
    SELECT parameter, quantile_cont(value, 0.05) AS outer_low,
      quantile_cont(value, 0.25) AS inner_low, quantile_cont(value, 0.5) AS median,
      quantile_cont(value, 0.75) AS inner_high, quantile_cont(value, 0.95) AS outer_high
    FROM draws GROUP BY 1"""


@query("intervals", "draws", LIMITS, "outer_low inner_low median inner_high outer_high")
def intervals(t: Inputs):
    return posterior.intervals(t.draws)


@query("areas", "draws", f"""
    SELECT k.parameter, point, x, density / max(density) OVER (PARTITION BY k.parameter) AS height,
      CASE WHEN x BETWEEN inner_low AND inner_high THEN 'inner'
        WHEN x BETWEEN outer_low AND outer_high THEN 'outer' ELSE 'tail' END AS band
    FROM ({_kde_sql("parameter", 256)}) k JOIN ({LIMITS}) l ON l.parameter = k.parameter""",
       "x height")
def areas(t: Inputs):
    return posterior.areas(t.draws, 256)


@query("posterior_summary", "draws", """
    SELECT parameter, count(*) AS n_draws, avg(value) AS mean, stddev_samp(value) AS sd,
      quantile_cont(value, 0.025) AS q2_5, quantile_cont(value, 0.05) AS q5,
      quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.95) AS q95,
      quantile_cont(value, 0.975) AS q97_5 FROM draws GROUP BY 1""",
       "mean sd q2_5 q5 q50 q95 q97_5")
def posterior_summary(t: Inputs):
    return posterior.posterior_summary(t.draws)


@query("draw_statistics", "draws", """
    SELECT parameter, stddev_samp(value) AS sd, max(value) AS largest, min(value) AS smallest
    FROM draws GROUP BY 1""", "sd largest smallest")
def draw_statistics(t: Inputs):
    return posterior.draw_statistics(t.draws)


@query("abundance_check", "draws per_site", """
    SELECT p.species, d.site_num, CAST(0 AS BIGINT) AS n_null, minimum, q1, median, q3, maximum, mean, p.n,
      minimum >= p.n AS "check"
    FROM (SELECT CAST(parameter[3] AS INTEGER) AS site_num, min(value) AS minimum,
            quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
            quantile_cont(value, 0.75) AS q3, max(value) AS maximum, avg(value) AS mean
          FROM draws WHERE parameter LIKE 'N[%' GROUP BY 1) d
    JOIN per_site p ON p.site_num = d.site_num""", "minimum q1 median q3 maximum mean", 9)
def abundance_check(t: Inputs):
    return posterior.abundance_check(t.draws, t.per_site)


PROPORTION = """
    SELECT p.species, p.site_num, d.chain, d.iteration, p.n / nullif(d.value, 0) AS p
    FROM draws d JOIN per_site p ON d.parameter = 'N[' || p.site_num || ']'"""


@query("proportion_captured", "draws per_site", PROPORTION, "p")
def proportion_captured(t: Inputs):
    return posterior.proportion_captured(t.draws, t.per_site)


@query("proportion_summary", "draws per_site", f"""
    SELECT species, site_num, count(*) FILTER (p IS NULL) AS n_null, min(p) AS minimum,
      quantile_cont(p, 0.25) AS q1, quantile_cont(p, 0.5) AS median, avg(p) AS mean,
      quantile_cont(p, 0.75) AS q3, max(p) AS maximum FROM ({PROPORTION}) GROUP BY ALL""",
       "minimum q1 median mean q3 maximum", 9)
def proportion_summary(t: Inputs):
    """The six numbers of the captured proportions of every species and site."""
    shares = posterior.proportion_captured(t.draws, t.per_site)
    return summaries.summary_table(shares, ["species", "site_num"], "p")


@query("proportion_histogram", f"draws per_site", f"""
    WITH shares AS (SELECT species, site_num, p AS value FROM ({PROPORTION}))
    {bins_sql("shares", "species, site_num", 50, "", "bin_start")}""", "bin_start density", 10)
def proportion_histogram(t: Inputs):
    shares = posterior.proportion_captured(t.draws, t.per_site).withColumnRenamed("p", "value")
    return posterior.histogram(shares, ["species", "site_num"], 50)


@query("prior_against_posterior", "draws", f"""
    SELECT source, mid AS x, CASE WHEN source = 'posterior' THEN density
      WHEN mid > 0 THEN exp(5 * ln(1.25e0) + 4 * ln(mid) - 1.25e0 * mid - ln(24e0))
      ELSE 0e0 END AS density
    FROM (SELECT * FROM (WITH chosen AS (SELECT * FROM draws WHERE parameter = 'sigma')
      {bins_sql("chosen", "parameter", 50, " + 0.5e0", "mid")}))
    CROSS JOIN (VALUES ('prior'), ('posterior')) AS s(source)""", "x density")
def prior_against_posterior(t: Inputs):
    return posterior.prior_against_posterior(t.draws)


U = f"({uniform(7, 'event_id')} * {num(1 - 2.0 ** -52)} + {num(2.0 ** -53)})"


@query("prior_pushforward", "", f"""
    SELECT event_id, alpha1, sqrt(1 / (2 * alpha1)) AS sigma,
      400 * sqrt(1 / (2 * alpha1)) AS home_range
    FROM (SELECT event_id, 1.5e0 + 2 * {normal_quantile('u')} AS alpha1
          FROM (SELECT event_id, {U} AS u FROM events))
    WHERE alpha1 >= 0.02e0""", "alpha1 sigma home_range")
def prior_pushforward(t: Inputs):
    return posterior.prior_pushforward(t.raw("events"), "event_id")


@query("home_ranges", "draws", """
    SELECT chain, iteration, 2 * 0.675e0 * value * 100 AS home_50,
      2 * 1.96e0 * value * 100 AS home_95 FROM draws WHERE parameter = 'sigma'""",
       "home_50 home_95")
def home_ranges(t: Inputs):
    return posterior.home_ranges(t.draws)


@query("gamma_from_moments", "draws", """
    SELECT parameter, chain, avg(value) ** 2 / var_samp(value) AS shape,
      avg(value) / var_samp(value) AS rate FROM draws GROUP BY ALL""", "shape rate")
def gamma_from_moments(t: Inputs):
    return posterior.gamma_from_moments(t.draws, ["parameter", "chain"], "value")


PRIORS = """(SELECT DISTINCT l_linenumber AS shape, (l_suppkey % 4 + 1) * 0.25e0 AS rate
    FROM lineitem)"""


def _priors(t: Inputs):
    return t.raw("lineitem").select(
        F.col("l_linenumber").alias("shape"),
        ((F.col("l_suppkey") % 4 + 1) * 0.25).alias("rate")).distinct()


@query("gamma_density_table", "", f"""
    SELECT shape, rate, CAST(point AS INTEGER) AS point, x, CASE WHEN x > 0 THEN
      exp(shape * ln(rate) + (shape - 1) * ln(x) - rate * x - ln(factorial(shape - 1)))
      WHEN shape = 1 THEN rate ELSE 0e0 END AS density
    FROM (SELECT *, point * 10e0 / 200 AS x FROM {PRIORS}
          CROSS JOIN (SELECT unnest(range(0, 201)) AS point))""", "rate x density")
def gamma_density_table(t: Inputs):
    return posterior.gamma_density_table(_priors(t))


def _erlang(x: str) -> str:
    return f"""(SELECT 1 - exp(-rate * {x}) * sum(power(rate * {x}, j) / factorial(j::INTEGER))
      FROM range(0, 7) AS r(j) WHERE j < shape)"""


@query("gamma_mass", "", f"""
    SELECT shape, rate, {_erlang('1e0')} AS below_1, {_erlang('2e0')} AS below_2,
      {_erlang('6e0')} - {_erlang('2e0')} AS between_2_6 FROM {PRIORS} AS priors""",
       "rate below_1 below_2 between_2_6")
def gamma_mass(t: Inputs):
    return posterior.gamma_mass(_priors(t))


@query("empirical_mass", "draws", """
    SELECT parameter, avg(CASE WHEN value > 2 AND value <= 6 THEN 1e0 ELSE 0e0 END) AS mass
    FROM draws GROUP BY 1""", "mass")
def empirical_mass(t: Inputs):
    return posterior.empirical_mass(t.draws, 2.0, 6.0)
