"""Diagnostics against brute force in numpy and against series of known answer."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trapline.functions import probability as pr
from trapline.operators import convergence, posterior

DRAWS = "chain int, iteration bigint, parameter string, value double"


def chains(spark, named):
    rows = [(c + 1, i + 1, name, float(v)) for name, series in named.items()
            for c, chain in enumerate(series) for i, v in enumerate(chain)]
    return spark.createDataFrame(rows, DRAWS).repartition(5)


def ar1(rng, phi, n, m=4):
    x = rng.normal(size=(m, n))
    for t in range(1, n):
        x[:, t] = phi * x[:, t - 1] + math.sqrt(1 - phi * phi) * x[:, t]
    return x


def brute_ess(x):
    m, n = x.shape
    d = x - x.mean(axis=1, keepdims=True)
    acov = np.array([(d[:, :n - t] * d[:, t:]).sum(axis=1).mean() / n for t in range(n)])
    w = x.var(axis=1, ddof=1).mean()
    plus = (n - 1) / n * w + x.mean(axis=1).var(ddof=1)
    rho = 1 - (w - acov) / plus
    rho[0] = 1
    total, last = 0.0, math.inf
    for k in range(n // 2):
        pair = rho[2 * k] + rho[2 * k + 1]
        if pair < 0:
            break
        last = min(last, pair)
        total += last
    return m * n / max(-1 + 2 * total, 1 / math.log10(m * n))


def halves_of(x):
    n = x.shape[1] // 2
    return np.vstack([x[:, :n], x[:, x.shape[1] - n:]])


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(3)
    slow = ar1(rng, 0.97, 801)
    shifted = ar1(rng, 0.0, 801)
    shifted[3] += 3
    return {"fast": ar1(rng, 0.0, 801), "slow": slow, "shifted": shifted}


def test_psrf(spark, series):
    got = {r.parameter: r.psrf for r in convergence.psrf(chains(spark, series)).collect()}
    assert got["fast"] == pytest.approx(1, abs=0.02) and got["shifted"] > 1.8


def test_psrf_of_equal_and_shifted_chains(spark):
    flat = [[1.0, -1.0] * 50 for _ in range(4)]
    far = [[1.0, -1.0] * 50 for _ in range(3)] + [[11.0, 9.0] * 50]
    got = {r.parameter: r.psrf for r in convergence.psrf(
        chains(spark, {"flat": flat, "far": far})).collect()}
    assert got["flat"] == pytest.approx(1, abs=0.02) and got["far"] > 5


def test_psrf_refuses_chains_of_unequal_length(spark):
    with pytest.raises(ValueError):
        convergence.psrf(chains(spark, {"a": [[1.0, 2.0, 3.0], [1.0, 2.0]]}))


def test_a_settled_series_does_not_wait_again(spark, series, monkeypatch):
    """Every series has its own range of lags; none is asked for once it has met its end."""
    seen, lags = [], convergence.lag_products

    def counted(blocks, wanted, keys, rows):
        seen.append({(r.parameter, r["first"], r["last"]) for r in wanted.collect()})
        return lags(blocks, wanted, keys, rows)

    monkeypatch.setattr(convergence, "lag_products", counted)
    halves = convergence.split_halves(chains(spark, series | {"short": series["slow"][:, :150]}))
    got = {r.parameter: r.ess for r in convergence.split_ess(halves, ["parameter"]).collect()}
    assert len(seen) > 1 and ("short", 0, 63) in seen[0] and ("slow", 0, 63) in seen[0]
    assert {s[0] for s in seen[1]} <= {"slow", "short", "shifted"}
    assert all(last < 75 for step in seen for name, _, last in step if name == "short")
    assert got["short"] == pytest.approx(brute_ess(halves_of(series["slow"][:, :150])), rel=1e-9)


def test_a_chain_that_never_mixes_is_worked_on_in_tiles(spark, monkeypatch):
    """All lags of 10^5 draws: no task row holds more than two blocks."""
    largest, tile = [], convergence._tile_sums

    def watched(width, size):
        run = tile(width, size)

        def check(batches):
            def each():
                for batch in batches:
                    for side in (width + 4, width + 5):
                        assert max(len(v) for v in batch.column(side)) <= size
                    yield batch
            return run(each())
        largest.append(size)
        return check

    monkeypatch.setattr(convergence, "_tile_sums", watched)
    n = 100_000
    draws = spark.range(n).selectExpr("'a' AS parameter", "1 AS chain", "id + 1 AS iteration",
                                      "cast(id AS double) AS value")
    got = {r.lag: r.autocovariance for r in convergence.autocovariance(
        draws, ["parameter", "chain"], n).collect()}
    assert largest == [4096] and sorted(got) == list(range(n))
    d = np.arange(n) - (n - 1) / 2
    for lag in (0, 1, 4095, 4096, 4097, 50_000, 99_998, 99_999):
        assert got[lag] == pytest.approx(float((d[:n - lag] * d[lag:]).sum()) / n, rel=1e-9)


def test_split_ess_of_slow_chains(spark, series):
    """The slow series needs more lags than the first batch holds."""
    halves = convergence.split_halves(chains(spark, series))
    got = {r.parameter: r.ess for r in convergence.split_ess(halves, ["parameter"]).collect()}
    for name, x in series.items():
        assert got[name] == pytest.approx(brute_ess(halves_of(x)), rel=1e-9)


def test_autocovariance_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(convergence, "BLOCK", 50)
    x = ar1(np.random.default_rng(8), 0.8, 333, m=2)
    got = {(r.chain, r.lag): r.autocovariance for r in convergence.autocovariance(
        chains(spark, {"a": x}), ["parameter", "chain"], 30).collect()}
    d = x - x.mean(axis=1, keepdims=True)
    for c in range(2):
        for t in range(31):
            want = float((d[c, :333 - t] * d[c, t:]).sum()) / 333
            assert got[(c + 1, t)] == pytest.approx(want, rel=1e-9, abs=1e-12)


def test_effective_size(spark, series):
    got = {r.parameter: r.ess for r in
           convergence.effective_size(chains(spark, series)).collect()}
    assert 2400 < got["fast"] < 4200
    assert 20 < got["slow"] < 150


def brute_autoregressive_size(x):
    """Solving the Yule-Walker equations of every order anew."""
    n, d = len(x), np.asarray(x) - np.mean(x)
    top = min(n - 1, max(1, int(10 * math.log10(n))))
    cov = [float((d[:n - t] * d[t:]).sum()) / n for t in range(top + 1)]
    if n < 2 or cov[0] <= 0:
        return 0.0
    fits = [(n * math.log(cov[0]), 0, cov[0], 0.0)]
    for p in range(1, top + 1):
        table = [[cov[abs(i - j)] for j in range(p)] for i in range(p)]
        phi = np.linalg.solve(table, cov[1:p + 1])
        error = cov[0] - float(phi @ cov[1:p + 1])
        if error <= 0:
            break
        fits.append((n * math.log(error) + 2 * p, p, error, float(phi.sum())))
    _, p, error, total = min(fits, key=lambda f: f[0])
    return n * (cov[0] * n / (n - 1)) / (error * n / (n - p - 1) / (1 - total) ** 2)


def test_effective_size_against_equations_of_every_order(spark, series):
    named = series | {"flat": [[2.0] * 30] * 2, "two": [[1.0, 2.0]], "one": [[5.0]],
                      "wave": [np.sin(np.arange(60) / 3)]}
    got = {r.parameter: (r.ess, r.ratio) for r in
           convergence.effective_size(chains(spark, named)).collect()}
    for name, x in named.items():
        want = sum(brute_autoregressive_size(c) for c in x)
        assert got[name][0] == pytest.approx(want, rel=1e-6), name
        assert got[name][1] == pytest.approx(want / sum(map(len, x)), rel=1e-6)


def test_rank_rhat_and_gate(spark, series):
    rows = {r.parameter: r for r in convergence.monitor(chains(spark, series)).collect()}
    assert rows["fast"].rhat < 1.01 and rows["shifted"].rhat > 1.2
    gate = convergence.convergence_gate(convergence.monitor(chains(spark, series))).first()
    assert gate.max_rhat == pytest.approx(max(r.rhat for r in rows.values()))
    assert not gate.converged


def test_normal_scores_with_one_value_in_a_third_of_the_rows(spark):
    x = np.concatenate([np.zeros(400), np.arange(1, 801)]).reshape(4, 300)
    halves = convergence.split_halves(chains(spark, {"a": x}))
    rows = convergence.normal_scores(halves).collect()
    assert len(rows) == 1200
    low = min(r.value for r in rows)
    from statistics import NormalDist
    assert low == pytest.approx(NormalDist().inv_cdf((200.5 - 0.375) / 1200.25), rel=1e-9)
    assert sum(r.value == low for r in rows) == 400


def test_kde_is_close_to_the_exact_kernel_sum(spark):
    x = np.random.default_rng(1).gamma(4, 1, size=600)
    draws = chains(spark, {"a": [x]})
    rows = posterior.kde(draws, ["parameter"]).orderBy("point").collect()
    q1, q3 = np.quantile(x, [0.25, 0.75])
    bw = 0.9 * min(x.std(ddof=1), (q3 - q1) / 1.34) * len(x) ** -0.2
    grid = np.array([r.x for r in rows])
    exact = np.exp(-0.5 * ((grid[:, None] - x) / bw) ** 2).sum(axis=1) / (
        len(x) * bw * math.sqrt(2 * math.pi))
    got = np.array([r.density for r in rows])
    assert len(rows) == 512 and np.abs(got - exact).max() < 2e-4
    assert np.trapezoid(got, grid) == pytest.approx(1, abs=3e-3)


def test_zero_abundance_gives_a_null_share(spark):
    draws = chains(spark, {"N[1]": [[0.0, 4.0]]})
    per_site = spark.createDataFrame([("CPIC", 1, 2)], "species string, site_num int, n int")
    rows = posterior.proportion_captured(draws, per_site).orderBy("iteration").collect()
    assert [r.p for r in rows] == [None, 0.5]


def test_thinning_renumbers(spark):
    draws = chains(spark, {"a": [range(1, 21)]})
    kept = posterior.thin(draws, 5, 3).orderBy("iteration").collect()
    assert [(r.iteration, r.value) for r in kept] == [(1, 8), (2, 11), (3, 14), (4, 17), (5, 20)]


def test_every_bin_is_there(spark):
    draws = chains(spark, {"a": [[2.0] * 5], "b": [[0.0, 0.0, 9.9]]})
    rows = posterior.histogram(draws, ["parameter"], 10).orderBy("parameter", "bin").collect()
    assert [(r.bin, r.n) for r in rows] == [
        *[(k, 5 * (k == 0)) for k in range(10)], *[(k, {0: 2, 9: 1}.get(k, 0)) for k in range(10)]]
    assert {r.density for r in rows[:10]} == {None} and rows[11].density == 0.0


def test_bandwidth_of_tied_and_constant_parameters(spark):
    tied = [0.0] * 17 + [1.0, 2.0, 3.0]
    draws = chains(spark, {"tied": [tied], "same": [[2.0] * 8], "zero": [[0.0] * 8]})
    got = {r.parameter: r.bw for r in posterior.density_setup(draws, ["parameter"], 64).collect()}
    assert got["tied"] == pytest.approx(0.9 * np.std(tied, ddof=1) * 20 ** -0.2)
    assert got["same"] == pytest.approx(0.9 * 2 * 8 ** -0.2)
    assert got["zero"] == pytest.approx(0.9 * 8 ** -0.2)
    rows = posterior.kde(draws, ["parameter"], 64).groupBy("parameter").agg(
        F.sum("density").alias("total"), F.count("*").alias("n"),
        ((F.max("x") - F.min("x")) / 63).alias("step")).collect()
    assert len(rows) == 3
    assert all(r.n == 64 and r.total * r.step == pytest.approx(1, abs=0.02) for r in rows)


def test_normal_quantile_and_erlang(spark):
    from statistics import NormalDist
    ps = [1e-12, 1e-4, 0.07, 0.5, 0.6, 0.99, 1 - 1e-9]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    got = [r[0] for r in df.select(pr.normal_quantile(F.col("p"))).collect()]
    assert got == pytest.approx([NormalDist().inv_cdf(p) for p in ps], rel=1e-9, abs=1e-12)
    mass = posterior.gamma_mass(spark.createDataFrame(
        [(4, 1.0), (5, 1.25)], "shape int, rate double")).orderBy("shape").collect()
    assert mass[0].between_2_6 == pytest.approx(0.7059, abs=1e-3)
    assert mass[1].below_1 == pytest.approx(0.0091, abs=1e-3)


def test_uniforms_are_flat_and_independent_of_neighbours(spark):
    u = np.array([r[0] for r in spark.range(20000).select(
        pr.uniform(1, F.col("id")).alias("u")).collect()])
    counts, _ = np.histogram(u, bins=20, range=(0, 1))
    assert ((counts - 1000) ** 2 / 1000).sum() < 50
    assert abs(np.corrcoef(u[:-1], u[1:])[0, 1]) < 0.03


def test_prior_pushforward_keeps_the_cut(spark):
    rows = posterior.prior_pushforward(spark.range(5000).withColumnRenamed("id", "k"), "k")
    low, n = rows.agg(F.min("alpha1"), F.count(F.lit(1))).first()
    assert low >= 0.02 and 0.74 < n / 5000 < 0.80


def test_gaps_in_the_numbering_are_refused(spark):
    draws = chains(spark, {"a": [range(10)]}).where("iteration <> 4")
    with pytest.raises(ValueError):
        convergence.split_halves(draws)
