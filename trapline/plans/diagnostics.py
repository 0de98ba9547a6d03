"""Queries for convergence of the chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from trapline.operators import convergence, posterior
from trapline.plans.draws import bins_sql
from trapline.plans.inputs import Inputs
from trapline.plans.registry import query
from trapline.plans.views import AUTOREGRESSIVE, ess_sql, rhat_sql
from trapline.session import settle


def _halves(t: Inputs):
    return settle(convergence.split_halves(t.draws))


PSRF = """
    SELECT parameter, sqrt((df + 3) / (df + 1) * v / w) AS psrf FROM (
      SELECT *, 2 * v * v / (((n - 1) ** 2 * vs / m + (1 + 1 / m) ** 2 * 2 * b * b / (m - 1)
        + 2 * (n - 1) * (1 + 1 / m) * (n / m) * (c2 - 2 * mu * c1)) / (n * n)) AS df
      FROM (SELECT *, n * vm AS b, (n - 1) / n * w + (1 + 1 / m) * vm AS v FROM (
        SELECT parameter, CAST(count(*) AS DOUBLE) AS m, CAST(min(n) AS DOUBLE) AS n,
          avg(s2) AS w, var_samp(mean) AS vm, var_samp(s2) AS vs, avg(mean) AS mu,
          covar_samp(s2, mean * mean) AS c2, covar_samp(s2, mean) AS c1
        FROM (SELECT parameter, chain, count(*) AS n, avg(value) AS mean, var_samp(value) AS s2
              FROM draws GROUP BY ALL) GROUP BY 1)))"""


@query("psrf", "draws", PSRF, "psrf")
def psrf(t: Inputs):
    return convergence.psrf(t.draws)


@query("autocovariance", "draws", """
    SELECT x.parameter, x.chain, CAST(y.iteration - x.iteration AS INTEGER) AS lag,
      sum((x.value - m.mean) * (y.value - m.mean)) / any_value(m.n) AS autocovariance
    FROM draws x JOIN draws y ON y.parameter = x.parameter AND y.chain = x.chain
      AND y.iteration BETWEEN x.iteration AND x.iteration + 20
    JOIN (SELECT parameter, chain, avg(value) AS mean, count(*) AS n FROM draws GROUP BY ALL) m
      ON m.parameter = x.parameter AND m.chain = x.chain
    GROUP BY ALL""", "autocovariance", 5)
def autocovariance(t: Inputs):
    return convergence.autocovariance(t.draws, ["parameter", "chain"], 20)


@query("effective_size", "draws", AUTOREGRESSIVE, "ess ratio", 4)
def effective_size(t: Inputs):
    return convergence.effective_size(t.draws)


@query("effective_size_histogram", "draws", bins_sql(
    f"(SELECT 'ess' AS statistic, ess AS value FROM ({AUTOREGRESSIVE}))", "statistic", 50, "",
    "bin_start"), "bin_start density", 4)
def effective_size_histogram(t: Inputs):
    sizes = convergence.effective_size(t.draws).select(
        F.lit("ess").alias("statistic"), F.col("ess").alias("value"))
    return posterior.histogram(sizes, ["statistic"], 50)


@query("posterior_summary_checked", "draws ranked folded", f"""
    SELECT s.parameter, round(s.mean, 2) AS mean, round(s.sd, 2) AS sd,
      round(s.q2_5, 2) AS q2_5, round(s.q50, 2) AS q50, round(s.q97_5, 2) AS q97_5,
      round(greatest(r.rhat_bulk, f.rhat_folded), 4) AS rhat
    FROM (SELECT parameter, avg(value) AS mean, stddev_samp(value) AS sd,
        quantile_cont(value, 0.025) AS q2_5, quantile_cont(value, 0.5) AS q50,
        quantile_cont(value, 0.975) AS q97_5 FROM draws GROUP BY 1) s
    JOIN ({rhat_sql('ranked', 'rhat_bulk')}) r ON r.parameter = s.parameter
    JOIN ({rhat_sql('folded', 'rhat_folded')}) f ON f.parameter = s.parameter""")
def posterior_summary_checked(t: Inputs):
    """The printed summary: two digits, with R-hat."""
    table = posterior.posterior_summary(t.draws).join(
        convergence.rank_normalized_rhat(_halves(t)), "parameter")
    return table.select("parameter", *[F.round(c, 2).alias(c) for c in (
        "mean", "sd", "q2_5", "q50", "q97_5")], F.round("rhat", 4).alias("rhat"))


@query("printed_summary", "draws", f"""
    SELECT s.parameter, round(mean, 2) AS mean, round(sd, 2) AS sd, round(q2_5, 2) AS q2_5,
      round(q50, 2) AS q50, round(q97_5, 2) AS q97_5, round(psrf, 2) AS rhat,
      round(ess, 0) AS n_eff
    FROM (SELECT parameter, avg(value) AS mean, stddev_samp(value) AS sd,
        quantile_cont(value, 0.025) AS q2_5, quantile_cont(value, 0.5) AS q50,
        quantile_cont(value, 0.975) AS q97_5 FROM draws GROUP BY 1) s
    LEFT JOIN ({PSRF}) p ON p.parameter = s.parameter
    LEFT JOIN ({AUTOREGRESSIVE}) e ON e.parameter = s.parameter
    WHERE split_part(s.parameter, '[', 1) IN ('N', 'sigma', 'beta_1', 'alpha0')""")
def printed_summary(t: Inputs):
    return convergence.printed_summary(t.draws, ["N", "sigma", "beta_1", "alpha0"])


@query("rank_normalized_rhat", "ranked folded", f"""
    SELECT b.parameter, rhat_bulk, rhat_folded, greatest(rhat_bulk, rhat_folded) AS rhat
    FROM ({rhat_sql('ranked', 'rhat_bulk')}) b JOIN ({rhat_sql('folded', 'rhat_folded')}) f
      ON f.parameter = b.parameter""", "rhat_bulk rhat_folded rhat")
def rank_normalized_rhat(t: Inputs):
    return convergence.rank_normalized_rhat(_halves(t))


@query("bulk_ess", "ranked", ess_sql("ranked", "bulk_ess"), "bulk_ess", 4)
def bulk_ess(t: Inputs):
    return convergence.bulk_ess(convergence.normal_scores(_halves(t)))


TAIL = f"""
    SELECT regexp_replace(parameter, ' (low|high)$', '') AS parameter, min(ess) AS tail_ess
    FROM ({ess_sql('marks', 'ess')}) GROUP BY 1"""


@query("tail_ess", "marks", TAIL, "tail_ess", 4)
def tail_ess(t: Inputs):
    return convergence.tail_ess(_halves(t))


@query("convergence_gate", "ranked folded marks", f"""
    SELECT max(greatest(rhat_bulk, rhat_folded)) AS max_rhat, min(bulk_ess) AS min_bulk_ess,
      min(tail_ess) AS min_tail_ess, max(greatest(rhat_bulk, rhat_folded)) < 1.05e0 AS converged
    FROM ({rhat_sql('ranked', 'rhat_bulk')}) b
    JOIN ({rhat_sql('folded', 'rhat_folded')}) f ON f.parameter = b.parameter
    JOIN ({ess_sql('ranked', 'bulk_ess')}) e ON e.parameter = b.parameter
    JOIN ({TAIL}) t ON t.parameter = b.parameter""", "max_rhat min_bulk_ess min_tail_ess", 4)
def convergence_gate(t: Inputs):
    return convergence.convergence_gate(convergence.monitor(t.draws))
