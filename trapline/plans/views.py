"""The adapters and shared intermediate tables as SQL, for the twins of the registered queries.

Each view is written from its definition (grids, joins, windows) and not from the way the Spark
operators compute it."""

from __future__ import annotations

from trapline.functions import probability as pr
from trapline.functions.projection import ECCENTRICITY, RADIUS, SCALE, SERIES
from trapline.sources.lookups import SITE_COVARIATES, SITES, SPECIES_CAPS


def num(x: float) -> str:
    """Number as a double literal."""
    return f"{x:.17e}"


def _values(rows, names: str) -> str:
    body = ", ".join("(" + ", ".join(
        f"'{v}'" if isinstance(v, str) else num(v) if isinstance(v, float) else str(v)
        for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({names})"


def _horner(coefficients, x: str) -> str:
    total = num(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        total = f"({total} * {x} + {num(c)})"
    return total


def normal_quantile(p: str) -> str:
    q = f"({p} - 0.5e0)"
    central = f"(0.180625e0 - {q} * {q})"
    tail = f"sqrt(-ln(least({p}, 1e0 - {p})))"
    near, far = f"({tail} - 1.6e0)", f"({tail} - 5e0)"
    return (f"(CASE WHEN abs({q}) <= 0.425e0 THEN {q} * {_horner(pr.CENTRAL_NUM, central)} / "
            f"{_horner(pr.CENTRAL_DEN, central)} ELSE sign({q}) * (CASE WHEN {tail} <= 5e0 THEN "
            f"{_horner(pr.MIDDLE_NUM, near)} / {_horner(pr.MIDDLE_DEN, near)} ELSE "
            f"{_horner(pr.FAR_NUM, far)} / {_horner(pr.FAR_DEN, far)} END) END)")


def uniform(seed: int, *keys: str) -> str:
    text = " || ':' || ".join([f"'{seed}'", *[f"CAST({k} AS VARCHAR)" for k in keys]])
    return f"(CAST(CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT) AS DOUBLE) / {num(2 ** 52)})"


def _series(outer: str, inner: str) -> str:
    return " + ".join(f"{num(a)} * {outer}({2 * j} * xi) * {inner}({2 * j} * eta)"
                      for j, a in enumerate(SERIES, start=1))


def logistic(x: str) -> str:
    return f"(1e0 / (1e0 + exp(-({x}))))"


def utm_sql(names: str, source: str) -> str:
    return f"""
        SELECT {names},
          5e5 + {num(SCALE * RADIUS)} * (eta + {_series("cos", "sinh")}) AS easting,
          {num(SCALE * RADIUS)} * (xi + {_series("sin", "cosh")}) AS northing
        FROM (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta
          FROM (SELECT *, sinh(atanh(sin(phi)) - {num(ECCENTRICITY)}
                  * atanh({num(ECCENTRICITY)} * sin(phi))) AS t
            FROM (SELECT *, radians(lat) AS phi, radians(lon + 81e0) AS lam FROM {source})))"""


def distance_sql(source: str) -> str:
    return f"""
        SELECT u.*, fe, fn, sqrt((easting - fe) ** 2 + (northing - fn) ** 2) AS distance
        FROM {source} u JOIN (SELECT site_num, first(easting ORDER BY trap_id) AS fe,
          first(northing ORDER BY trap_id) AS fn FROM {source} GROUP BY 1) o
        ON o.site_num = u.site_num"""


VIEWS: dict[str, tuple[str, str]] = {
    "effort": ("", _values(SITES, "site, site_num, max_traps")),
    "covariates": ("", _values(SITE_COVARIATES, "site_num, forest, depth, width_m")),
    "caps": ("", _values(SPECIES_CAPS, "species, cap")),
    "days": ("captures", """
        SELECT CAST(unnest(range(1, 1 + n)) AS INTEGER) AS day
        FROM (SELECT greatest(4, max(day)) AS n FROM captures)"""),
    "alltraps": ("captures", """
        SELECT CAST(unnest(range(1, 1 + n)) AS INTEGER) AS trap
        FROM (SELECT greatest(max(trap), (SELECT max(max_traps) FROM effort)) AS n
              FROM captures)"""),
    "captures": ("effort", """
        SELECT e.event_id AS capture_id, e.site, f.site_num,
          CASE e.user_id % 4 WHEN 0 THEN 'CPIC' WHEN 1 THEN 'PRUB' WHEN 2 THEN 'CSER'
            ELSE 'SODO' END AS species,
          e.user_id AS ind,
          CASE WHEN e.user_id % 25 = 3 THEN 'U' WHEN e.user_id % 25 = 4 THEN NULL
            WHEN e.user_id % 3 = 0 THEN 'M' ELSE 'F' END AS sex,
          CASE WHEN e.event_id % 41 = 0 THEN 5
            ELSE CAST((day(e.ts) - 1) % 4 AS INTEGER) + 1 END AS day,
          CASE WHEN e.event_id % 53 = 0 THEN coalesce(f.max_traps, 3) + 1
            ELSE CAST(e.event_id % coalesce(f.max_traps, 3) AS INTEGER) + 1 END AS trap,
          CASE WHEN row_number() OVER (PARTITION BY e.user_id ORDER BY e.ts, e.event_id) = 1
            THEN 'N' ELSE 'R' END AS recap,
          CASE WHEN e.event_id % 97 = 0 THEN NULL ELSE e.value END AS carapace,
          e.value * 2 AS mass, e.ts
        FROM (SELECT *, substr('ACDEFGJKLMNOHI', CAST(user_id % 14 AS INTEGER) + 1, 1) AS site
              FROM events) e
        LEFT JOIN effort f ON e.site = f.site"""),
    "traps": ("", """
        SELECT s_suppkey AS trap_id, CAST(s_nationkey % 12 AS INTEGER) + 1 AS site_num,
          39.5e0 + (s_suppkey % 50) * 2e-4 AS lat, -78.7e0 + (s_suppkey % 50) * 3e-4 AS lon
        FROM supplier"""),
    "draws": ("", """
        SELECT CAST(event_id % 4 AS INTEGER) + 1 AS chain, event_id // 20 + 1 AS iteration,
          CASE (event_id // 4) % 5 WHEN 0 THEN 'N[1]' WHEN 1 THEN 'N[2]' WHEN 2 THEN 'sigma'
            WHEN 3 THEN 'beta_1' ELSE 'alpha0[1,1]' END AS parameter, value
        FROM events"""),
    "prior_draws": ("", """
        SELECT CAST(event_id % 4 AS INTEGER) + 1 AS chain, event_id // 32 + 1 AS iteration,
          (['sigma', 'beta_1', 'alpha0[1,1]', 'alpha0[1,2]', 'mu_0', 'sd_0', 'psi[1]', 'N[1]'])[
            CAST((event_id // 4) % 8 AS INTEGER) + 1] AS parameter,
          CASE (event_id // 4) % 8 WHEN 5 THEN event_id % 13 / 2e0 - 0.5e0
            WHEN 6 THEN event_id % 11 / 10e0 ELSE value / 10 - 1 END AS value
        FROM events"""),
    "tied_draws": ("", """
        SELECT CAST(event_id % 4 AS INTEGER) + 1 AS chain, event_id // 12 + 1 AS iteration,
          CASE (event_id // 4) % 3 WHEN 0 THEN 'N[3]' WHEN 1 THEN 'beta_2' ELSE 'sigma' END
            AS parameter,
          CASE (event_id // 4) % 3 WHEN 0 THEN CASE WHEN event_id % 5 < 4 THEN 0e0
              ELSE CAST(event_id % 7 AS DOUBLE) END
            WHEN 1 THEN 0.5e0 ELSE value END AS value
        FROM events"""),
    "latent": ("", """
        SELECT CAST(l_orderkey % 4 AS INTEGER) + 1 AS chain,
          CAST(l_linenumber AS BIGINT) + 7 * (l_orderkey // 15000) AS iteration,
          CAST(l_suppkey % 12 AS INTEGER) + 1 AS site_num,
          CAST(l_partkey % 200 AS INTEGER) + 1 AS id_site,
          max(CASE WHEN l_discount >= 5e-2 THEN 1 ELSE 0 END) AS z, min(l_quantity) / 10e0 AS s,
          CAST(max(l_partkey % 2) AS INTEGER) AS sex
        FROM lineitem GROUP BY 1, 2, 3, 4"""),
    "params": ("latent effort days", """
        SELECT c.chain, c.iteration, e.site_num, d.day,
          -3e0 + (c.chain + c.iteration % 7 + e.site_num + d.day) / 20e0 AS alpha0,
          0.5e0 AS alpha2, 0.3e0 AS alpha3, 1e0 + c.iteration % 7 / 10e0 AS sigma,
          1.2e0 + c.iteration % 7 / 8e0 + e.site_num / 50e0 AS sigma_f,
          0.1e0 + c.chain / 20e0 + e.site_num / 60e0 AS psi
        FROM (SELECT DISTINCT chain, iteration FROM latent) c CROSS JOIN effort e
        CROSS JOIN days d"""),
    "kept": ("captures", """
        SELECT * FROM captures WHERE sex <> 'U' AND sex IS NOT NULL AND site <> 'H'
          AND site <> 'I' AND (ind <> 70 OR species <> 'CSER')"""),
    "counts": ("kept", """
        SELECT species, site_num, ind, trap, day, sex, count(*) AS count FROM kept
        GROUP BY ALL"""),
    "em": ("counts", """
        SELECT *, CASE WHEN ind IS NOT NULL THEN CAST(dense_rank() OVER (
          PARTITION BY species, site_num, ind IS NULL ORDER BY ind) AS INTEGER) END AS id_site
        FROM counts"""),
    "per_site": ("em effort caps", """
        SELECT p.species, e.site_num, e.max_traps, p.cap, coalesce(m.n, 0) AS n
        FROM effort e CROSS JOIN caps p LEFT JOIN (
          SELECT species, site_num, max(id_site) AS n FROM em GROUP BY ALL) m
        ON m.species = p.species AND m.site_num = e.site_num"""),
    "sizes": ("per_site", """
        SELECT *, least(CAST(floor(m_raw) AS INTEGER), cap) AS m FROM (
          SELECT *, CASE WHEN n > 0 THEN n / 1e-2 + 10 ELSE 500e0 END AS m_raw FROM per_site)"""),
    "slots": ("sizes", """
        SELECT species, site_num, n, max_traps, CAST(unnest(range(1, m + 1)) AS INTEGER) AS id_site
        FROM sizes"""),
    "tuples": ("em effort caps days", """
        SELECT DISTINCT species, site_num, ind, id_site FROM em
        UNION
        SELECT DISTINCT p.species, g.site_num, CAST(NULL AS BIGINT), CAST(NULL AS INTEGER)
        FROM (SELECT e.site_num, d.day, unnest(range(1, e.max_traps + 1)) AS trap
              FROM effort e CROSS JOIN days d) g
        CROSS JOIN caps p
        LEFT JOIN em ON em.species = p.species AND em.site_num = g.site_num
          AND em.trap = g.trap AND em.day = g.day
        WHERE em.species IS NULL"""),
    "history": ("tuples em effort days alltraps", """
        SELECT t.species, t.site_num, t.ind, t.id_site, a.trap, d.day, e.max_traps,
          CASE WHEN c.count IS NULL AND a.trap <= e.max_traps AND t.ind IS NOT NULL THEN 0
            ELSE c.count END AS count
        FROM tuples t CROSS JOIN alltraps a CROSS JOIN days d
        JOIN effort e ON e.site_num = t.site_num
        LEFT JOIN (SELECT species, site_num, ind, trap, day, CAST(sum(count) AS BIGINT) AS count
                   FROM em GROUP BY ALL) c
          ON c.species = t.species AND c.site_num = t.site_num AND c.ind IS NOT DISTINCT FROM t.ind
          AND c.trap = a.trap AND c.day = d.day"""),
    "flags": ("history", """
        SELECT species, site_num, ind, id_site, day, CAST(least(caps - count, 1) AS INTEGER) AS recap
        FROM (SELECT *, sum(count) OVER (PARTITION BY species, site_num, ind ORDER BY day) AS caps
              FROM (SELECT species, site_num, ind, id_site, day, coalesce(sum(count), 0) AS count
                    FROM history GROUP BY ALL))
        WHERE id_site IS NOT NULL"""),
    "centres": ("history", """
        SELECT species, site_num, id_site, (avg(trap) - 1) * 25 / 100 AS loc FROM history
        WHERE count <> 0 AND id_site IS NOT NULL GROUP BY ALL"""),
    "sexes": ("em", """
        SELECT species, site_num, id_site,
          CASE WHEN min(sex) = max(sex) THEN min(sex) END AS sex
        FROM em WHERE id_site IS NOT NULL GROUP BY ALL"""),
    "caps_day": ("history", """
        SELECT species, day, CAST(coalesce(sum(count), 0) AS BIGINT) AS caps FROM history
        GROUP BY ALL"""),
    "places": ("traps effort", """
        SELECT g.site_num, g.trap, g.site_num * 100 + g.trap AS trap_id,
          39.5e0 + g.trap * 2e-4 + coalesce(o.shift, 0e0) * 1e-6 AS lat,
          -78.7e0 + g.trap * 3e-4 + coalesce(o.shift, 0e0) * 1.5e-6 AS lon
        FROM (SELECT site_num, CAST(unnest(range(1, max_traps + 1)) AS INTEGER) AS trap
              FROM effort) g
        LEFT JOIN (SELECT t.site_num, CAST(t.trap_id % e.max_traps AS INTEGER) + 1 AS trap,
                     avg(t.trap_id % 50) AS shift
                   FROM traps t JOIN effort e ON e.site_num = t.site_num GROUP BY ALL) o
          ON o.site_num = g.site_num AND o.trap = g.trap"""),
    "utm": ("traps", utm_sql("trap_id, site_num, lat, lon", "traps")),
    "distances": ("utm", distance_sql("utm")),
    "place_utm": ("places", utm_sql("trap_id, site_num, trap, lat, lon", "places")),
    "place_distances": ("place_utm", distance_sql("place_utm")),
    "positions": ("place_distances", """
        SELECT site_num, trap, distance / 100 AS pos FROM place_distances"""),
    "space": ("place_distances", """
        SELECT site_num, (min(distance) - 1000) / 100 AS xlim1,
          (max(distance) + 1000) / 100 AS xlim2 FROM place_distances GROUP BY 1"""),
    "scaled": ("covariates", """
        SELECT site_num, width_m, (forest - avg(forest) OVER ()) / stddev_samp(forest) OVER () AS forest_std,
          (depth - avg(depth) OVER ()) / stddev_samp(depth) OVER () AS depth_std,
          (width_m - avg(width_m) OVER ()) / stddev_samp(width_m) OVER () AS width_m_std
        FROM covariates"""),
    "cells": ("latent params positions", f"""
        SELECT l.*, t.trap, k.day, k.sigma, k.sigma_f, k.alpha3, k.alpha0, k.alpha2,
          abs(l.s - t.pos) AS d, {logistic('k.alpha0')} AS p0,
          {logistic('k.alpha0')} * exp(-((l.s - t.pos) ** 2) / (2 * k.sigma ** 2)) AS p
        FROM latent l JOIN params k ON k.chain = l.chain AND k.iteration = l.iteration
          AND k.site_num = l.site_num
        JOIN positions t ON t.site_num = l.site_num"""),
    "per_draw": ("latent", """
        SELECT chain, iteration, site_num, CAST(sum(z) AS BIGINT) AS abundance FROM latent
        GROUP BY ALL"""),
    "observed": ("cells history flags", f"""
        SELECT h.species, c.chain, c.iteration, c.site_num, least(h.count, 1) AS y,
          {logistic('c.alpha0 + c.alpha2 * f.recap')}
            * exp(-c.d * c.d / (2 * c.sigma * c.sigma)) AS p
        FROM cells c JOIN history h ON h.site_num = c.site_num AND h.id_site = c.id_site
          AND h.trap = c.trap AND h.day = c.day
        JOIN flags f ON f.species = h.species AND f.site_num = h.site_num
          AND f.id_site = h.id_site AND f.day = h.day"""),
    "unplaced": ("history positions", """
        SELECT h.species, h.site_num, count(*) AS unplaced
        FROM history h LEFT JOIN positions t ON t.site_num = h.site_num AND t.trap = h.trap
        WHERE h.id_site IS NOT NULL AND h.count > 0 AND t.pos IS NULL GROUP BY ALL"""),
    "observed_ll": ("observed", """
        SELECT species, chain, iteration, site_num,
          sum(CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END) AS loglik
        FROM observed GROUP BY ALL"""),
    "zeros_ll": ("cells per_site", """
        SELECT n.species, c.chain, c.iteration, c.site_num, sum(ln(1 - c.p * c.z)) AS loglik
        FROM cells c JOIN per_site n ON n.site_num = c.site_num WHERE c.id_site > n.n
        GROUP BY ALL"""),
    "halves": ("draws", """
        SELECT parameter, chain, half, iteration - CASE WHEN half = 1 THEN m - size ELSE 0 END
          AS iteration, value
        FROM (SELECT *, CASE WHEN iteration > m - size THEN 1 ELSE 0 END AS half
              FROM (SELECT *, max(iteration) OVER (PARTITION BY parameter, chain) AS m,
                      max(iteration) OVER (PARTITION BY parameter, chain) // 2 AS size FROM draws))
        WHERE iteration <= size OR half = 1"""),
    "ranked": ("halves", f"""
        SELECT parameter, chain, half, iteration, {normal_quantile('u')} AS value
        FROM (SELECT *, (rank() OVER (PARTITION BY parameter ORDER BY value)
                + (count(*) OVER (PARTITION BY parameter, value) - 1) / 2e0 - 0.375e0)
                / (count(*) OVER (PARTITION BY parameter) + 0.25e0) AS u FROM halves)"""),
    "folded": ("halves", f"""
        SELECT parameter, chain, half, iteration, {normal_quantile('u')} AS value
        FROM (SELECT *, (rank() OVER (PARTITION BY parameter ORDER BY away)
                + (count(*) OVER (PARTITION BY parameter, away) - 1) / 2e0 - 0.375e0)
                / (count(*) OVER (PARTITION BY parameter) + 0.25e0) AS u
              FROM (SELECT h.*, abs(h.value - q.median) AS away FROM halves h JOIN (
                SELECT parameter, quantile_cont(value, 0.5) AS median FROM halves GROUP BY 1) q
                ON q.parameter = h.parameter))"""),
    "marks": ("halves", """
        SELECT h.parameter || side AS parameter, h.chain, h.half, h.iteration,
          CASE WHEN h.value <= CASE side WHEN ' low' THEN q.low ELSE q.high END THEN 1e0
            ELSE 0e0 END AS value
        FROM halves h JOIN (SELECT parameter, quantile_cont(value, 0.05) AS low,
          quantile_cont(value, 0.95) AS high FROM halves GROUP BY 1) q
          ON q.parameter = h.parameter
        CROSS JOIN (VALUES (' low'), (' high')) AS s(side)"""),
}


def rhat_sql(source: str, name: str) -> str:
    """R-hat over split chains of a view."""
    return f"""SELECT parameter, sqrt(((n - 1) / n * w + vm) / w) AS {name} FROM (
        SELECT parameter, CAST(min(n) AS DOUBLE) AS n, avg(s2) AS w, var_samp(mean) AS vm FROM (
          SELECT parameter, chain, half, count(*) AS n, avg(value) AS mean,
            var_samp(value) AS s2 FROM {source} GROUP BY ALL) GROUP BY parameter)"""


def ess_sql(source: str, name: str) -> str:
    """Effective size by the initial monotone sequence over split chains of a view."""
    return f"""
      SELECT b.parameter, total / greatest(-1 + 2 * coalesce(s.s, 0e0), 1 / log10(total)) AS {name}
      FROM (SELECT parameter, CAST(count(*) * min(n) AS DOUBLE) AS total FROM (
              SELECT parameter, chain, half, count(*) AS n FROM {source} GROUP BY ALL)
            GROUP BY 1) b
      LEFT JOIN (
        SELECT parameter, sum(mono) AS s FROM (
          SELECT parameter, pair, min(p) OVER (PARTITION BY parameter ORDER BY pair) AS mono,
            min(p) OVER (PARTITION BY parameter ORDER BY pair) AS lowest FROM (
            SELECT parameter, lag // 2 AS pair, sum(rho) AS p FROM (
              SELECT a.parameter, a.lag, CASE WHEN a.lag = 0 THEN 1e0 ELSE
                1 - (w - acov) / ((n - 1) / n * w + vm) END AS rho
              FROM (SELECT parameter, lag, avg(acov) AS acov FROM (
                  SELECT x.parameter, x.chain, x.half, y.iteration - x.iteration AS lag,
                    sum((x.value - m.mean) * (y.value - m.mean)) / any_value(m.n) AS acov
                  FROM {source} x JOIN {source} y ON y.parameter = x.parameter
                    AND y.chain = x.chain AND y.half = x.half AND y.iteration >= x.iteration
                  JOIN (SELECT parameter, chain, half, avg(value) AS mean, count(*) AS n
                        FROM {source} GROUP BY ALL) m
                    ON m.parameter = x.parameter AND m.chain = x.chain AND m.half = x.half
                  GROUP BY ALL) GROUP BY ALL) a
              JOIN (SELECT parameter, CAST(min(n) AS DOUBLE) AS n, avg(s2) AS w,
                      var_samp(mean) AS vm FROM (
                  SELECT parameter, chain, half, count(*) AS n, avg(value) AS mean,
                    var_samp(value) AS s2 FROM {source} GROUP BY ALL) GROUP BY 1) v
              ON v.parameter = a.parameter)
            GROUP BY ALL HAVING count(*) = 2))
        WHERE lowest >= 0 GROUP BY parameter) s
      ON s.parameter = b.parameter"""


#: Effective size of a parameter by autoregressions: the recursion over the order as a recursive
#: query, of which each chain keeps the order of least AIC.
AUTOREGRESSIVE = """
    SELECT parameter, sum(ess) AS ess, sum(ess) / sum(n) AS ratio FROM (
      WITH RECURSIVE m AS (
        SELECT parameter, chain, avg(value) AS mean, count(*) AS n,
          least(greatest(1, floor(10 * log10(count(*)))), count(*) - 1) AS top
        FROM draws GROUP BY ALL),
      lags AS (
        SELECT x.parameter, x.chain, any_value(n) AS n, y.iteration - x.iteration AS lag,
          sum((x.value - mean) * (y.value - mean)) / any_value(n) AS cov
        FROM draws x JOIN m ON m.parameter = x.parameter AND m.chain = x.chain
        JOIN draws y ON y.parameter = x.parameter AND y.chain = x.chain
          AND y.iteration BETWEEN x.iteration AND x.iteration + top
        GROUP BY x.parameter, x.chain, y.iteration - x.iteration),
      v AS (SELECT parameter, chain, n, list(cov ORDER BY lag) AS cov FROM (
              SELECT parameter, chain, CAST(n AS DOUBLE) AS n, lag, cov FROM lags) GROUP BY ALL),
      fit AS (
        SELECT parameter, chain, n, cov, 0 AS p, CAST([] AS DOUBLE[]) AS phi, cov[1] AS error
        FROM v WHERE n >= 2 AND cov[1] > 0
        UNION ALL
        SELECT parameter, chain, n, cov, p + 1,
          list_append(list_transform(range(1, p + 1), lambda j: phi[j] - r * phi[p + 1 - j]), r),
          error * (1 - r * r)
        FROM (SELECT *, (cov[p + 2] - coalesce(list_sum(list_transform(range(1, p + 1),
                lambda j: phi[j] * cov[p + 2 - j])), 0)) / error AS r
              FROM fit WHERE p + 1 < len(cov))
        WHERE error * (1 - r * r) > 0),
      best AS (
        SELECT *, row_number() OVER (PARTITION BY parameter, chain
          ORDER BY n * ln(error) + 2 * p, p) AS place FROM fit)
      SELECT v.parameter, v.chain, v.n, coalesce(v.n * (v.cov[1] * v.n / (v.n - 1))
          / (error * v.n / (v.n - p - 1) / (1 - coalesce(list_sum(phi), 0)) ** 2), 0) AS ess
      FROM v LEFT JOIN best b ON b.parameter = v.parameter AND b.chain = v.chain AND b.place = 1)
    GROUP BY parameter"""


VIEWS |= {
    "sparse": VIEWS["latent"],
    "whole_latent": ("sparse per_site", """
        SELECT k.chain, k.iteration, g.site_num, g.id_site, coalesce(l.z, 0) AS z,
          coalesce(l.s, (g.id_site % 50 + 1) / 10e0) AS s, coalesce(l.sex, g.id_site % 2) AS sex
        FROM (SELECT DISTINCT chain, iteration FROM sparse) k
        CROSS JOIN (
          SELECT site_num, CAST(unnest(range(1, width + 1)) AS INTEGER) AS id_site
          FROM (SELECT site_num, greatest(200, max(n)) AS width FROM per_site GROUP BY 1)) g
        LEFT JOIN sparse l ON l.chain = k.chain AND l.iteration = k.iteration
          AND l.site_num = g.site_num AND l.id_site = g.id_site"""),
}


def with_views(names: str, body: str, instead: dict[str, str] | None = None) -> str:
    """Prefix the body with the views it names and those they need, in order. ``instead`` gives
    the views that take the place of others under their names."""
    ordered: list[str] = []
    views = VIEWS | {name: VIEWS[other] for name, other in (instead or {}).items()}

    def need(name: str) -> None:
        if name in ordered:
            return
        for other in views[name][0].split():
            need(other)
        ordered.append(name)

    for name in names.split():
        need(name)
    if not ordered:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({views[n][1]})" for n in ordered) + "\n" + body
