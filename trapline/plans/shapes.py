"""Queries that reshape histories, build augmented slots and start values."""

from __future__ import annotations

from pyspark.sql import functions as F

from trapline.operators import filters, histories, posterior, starts, summaries
from trapline.plans.inputs import Inputs
from trapline.plans.registry import query
from trapline.plans.views import uniform

WIDE = ", ".join(f"max(CASE WHEN trap = {j} THEN count END) AS trap_{j}" for j in range(1, 16))


@query("history_wide", "history", f"""
    SELECT species, site_num, ind, id_site, day, max_traps, {WIDE} FROM history GROUP BY ALL""")
def history_wide(t: Inputs):
    return histories.history_wide(t.histories, *t.span)


@query("recaptures_wide", "flags", """
    SELECT species, site_num, id_site, max(CASE WHEN day = 1 THEN recap END) AS day_1,
      max(CASE WHEN day = 2 THEN recap END) AS day_2,
      max(CASE WHEN day = 3 THEN recap END) AS day_3,
      max(CASE WHEN day = 4 THEN recap END) AS day_4,
      max(CASE WHEN day = 5 THEN recap END) AS day_5 FROM flags GROUP BY ALL""")
def recaptures_wide(t: Inputs):
    return histories.recaptures_wide(t.known, t.widths.days)


SEEN = ", ".join(f"nullif(count(*) FILTER (trap = {j}), 0) AS trap_{j}" for j in range(1, 16))


@query("spatial_recaptures", "captures", f"""
    SELECT site, ind, day, {SEEN} FROM captures WHERE species = 'SODO' GROUP BY ALL""")
def spatial_recaptures(t: Inputs):
    return summaries.spatial_recaptures(t.captures, "SODO", t.widths.traps)


ZERO = ", ".join(f"coalesce(CAST(sum(count) FILTER (day = {k}) AS BIGINT), 0) AS day_{k}"
                 for k in range(1, 6))


@query("spread_zero", "counts", f"""
    SELECT species, site_num, trap, {ZERO} FROM counts GROUP BY ALL""")
def spread_zero(t: Inputs):
    return summaries.spread_zero(histories.capture_counts(t.kept),
                                 ["species", "site_num", "trap"], "day",
                                 list(range(1, t.widths.days + 1)), "day_")


@query("sex_matrix", "slots sexes", """
    SELECT species, site_num, block, string_agg(code, '' ORDER BY id_site) AS codes FROM (
      SELECT s.species, s.site_num, s.id_site, (s.id_site - 1) // 1000 AS block,
        CASE x.sex WHEN 'M' THEN '0' WHEN 'F' THEN '1' ELSE '-' END AS code
      FROM slots s LEFT JOIN sexes x ON x.species = s.species AND x.site_num = s.site_num
        AND x.id_site = s.id_site) GROUP BY ALL""")
def sex_matrix(t: Inputs):
    table = starts.sex_table(t.sizes, histories.first_sex(t.numbered))
    blocks = starts.site_matrix(table, "sex")
    return blocks.select("species", "site_num", "block", F.array_join(F.transform(
        "row", lambda x: F.coalesce(x.cast("string"), F.lit("-"))), "").alias("codes"))


@query("wide_to_long", "captures", """
    SELECT capture_id, 'carapace' AS variable, carapace AS value FROM captures
    UNION ALL SELECT capture_id, 'mass', mass FROM captures""", "value")
def wide_to_long(t: Inputs):
    return summaries.unpivoted(t.captures, ["capture_id"], ["carapace", "mass"])


@query("capture_array", "history days alltraps", """
    SELECT species, site_num, id_site, string_agg(row, ';' ORDER BY day) AS slab FROM (
      SELECT species, site_num, id_site, day,
        string_agg(coalesce(CAST(count AS VARCHAR), 'NA'), ',' ORDER BY trap) AS row
      FROM history WHERE id_site IS NOT NULL GROUP BY ALL) GROUP BY ALL""")
def capture_array(t: Inputs):
    slabs = histories.capture_array(t.known, *t.span)
    return slabs.withColumn("slab", F.array_join(F.transform("slab", lambda row: F.array_join(
        row.cast("array<string>"), ",", "NA")), ";"))


@query("recapture_array", "flags per_site days", """
    SELECT g.species, g.site_num, g.day, CAST(coalesce(sum(f.recap), 0) AS BIGINT) AS recaptured,
      count(*) AS cells
    FROM (SELECT species, site_num, day, unnest(range(1, widest + 1)) AS id_site FROM (
        SELECT *, max(n) OVER (PARTITION BY species) AS widest FROM per_site)
      CROSS JOIN days) g
    LEFT JOIN flags f ON f.species = g.species AND f.site_num = g.site_num
      AND f.id_site = g.id_site AND f.day = g.day GROUP BY ALL""")
def recapture_array(t: Inputs):
    """Array of flags with 0 wherever an individual does not exist, summed per slice."""
    flags = histories.recapture_flags(t.known, t.widths.days).select(
        "species", "site_num", "id_site", "day", "recap")
    widest = t.per_site.groupBy("species").agg(F.max("n").alias("m"))
    full = t.per_site.join(F.broadcast(widest), "species")
    padded = starts.padded_history(full, flags, True, t.widths.days, traps=False)
    return padded.groupBy("species", "site_num", "day").agg(
        F.sum("recap").alias("recaptured"), F.count(F.lit(1)).alias("cells"))


@query("zero_rows", "slots days", """
    SELECT species, site_num, day, count(*) FILTER (id_site > n) AS zero_rows, count(*) AS rows
    FROM slots CROSS JOIN days GROUP BY ALL""")
def zero_rows(t: Inputs):
    days = histories.recapture_flags(t.known, t.widths.days).select(
        "species", "site_num", "id_site", "day", F.lit(1).alias("real"))
    rows = starts.padded_history(t.sizes, days, True, t.widths.days, traps=False)
    return rows.groupBy("species", "site_num", "day").agg(
        F.count_if(F.col("real") == 0).alias("zero_rows"), F.count(F.lit(1)).alias("rows"))


PADDED = """
    SELECT s.species, s.site_num, t.trap, d.day, count(*) AS cells, count(h.count) AS filled,
      CAST(coalesce(sum(h.count), 0) AS BIGINT) AS captures
    FROM slots s CROSS JOIN days d JOIN alltraps t ON t.trap <= s.max_traps
    LEFT JOIN history h ON h.species = s.species AND h.site_num = s.site_num
      AND h.id_site = s.id_site AND h.trap = t.trap AND h.day = d.day GROUP BY ALL"""


def _padded(t: Inputs, zero: bool):
    cells = histories.observed_history(t.known, t.widths.days).select(
        "species", "site_num", "id_site", "trap", "day", "count")
    return starts.padded_history(t.sizes, cells, zero, t.widths.days)


@query("history_padded_null", "slots days alltraps history", PADDED)
def history_padded_null(t: Inputs):
    return _padded(t, False).groupBy("species", "site_num", "trap", "day").agg(
        F.count(F.lit(1)).alias("cells"), F.count("count").alias("filled"),
        F.coalesce(F.sum("count"), F.lit(0)).alias("captures"))


@query("history_padded_zero", "slots days alltraps history",
       PADDED.replace("count(h.count) AS filled", "count(*) AS filled"))
def history_padded_zero(t: Inputs):
    return _padded(t, True).groupBy("species", "site_num", "trap", "day").agg(
        F.count(F.lit(1)).alias("cells"), F.count("count").alias("filled"),
        F.sum("count").alias("captures"))


@query("zero_slots", "slots", """
    SELECT species, site_num, count(*) AS n_slots, CAST(0 AS BIGINT) AS total FROM slots
    GROUP BY ALL""")
def zero_slots(t: Inputs):
    return starts.zero_slots(t.sizes).groupBy("species", "site_num").agg(
        F.count(F.lit(1)).alias("n_slots"), F.sum("zero").alias("total"))


@query("stacked_chains", "draws", "SELECT iteration, parameter, value, chain FROM draws")
def stacked_chains(t: Inputs):
    chains = {c: t.draws.where(F.col("chain") == c).drop("chain") for c in range(1, 5)}
    return summaries.stacked_chains(chains)


@query("permuted_draws", "draws", """
    SELECT iteration, chain, parameter, value FROM draws""")
def permuted_draws(t: Inputs):
    return t.draws.select("iteration", "chain", "parameter", "value")


@query("bound_rows", "captures", """
    SELECT species, site_num, ind, trap, NULL AS mass FROM captures
    UNION ALL SELECT species, site_num, ind, NULL, mass FROM captures""", "mass")
def bound_rows(t: Inputs):
    places = t.captures.select("species", "site_num", "ind", "trap")
    sizes = t.captures.select("species", "site_num", "ind", "mass")
    return places.unionByName(sizes, allowMissingColumns=True)


@query("complete_captures", "captures", """
    SELECT capture_id, site_num, sex, carapace FROM captures
    WHERE site_num IS NOT NULL AND sex IS NOT NULL AND carapace IS NOT NULL""", "carapace")
def complete_captures(t: Inputs):
    return filters.complete_rows(t.captures.select("capture_id", "site_num", "sex", "carapace"))


# ---- start values ----------------------------------------------------------------------------

Z_START = (f"CASE WHEN id_site <= n THEN 1 WHEN {uniform(1, 'species', 'site_num', 'id_site')} "
           "< 0.2e0 THEN 1 ELSE 0 END")


@query("start_membership", "slots", f"""
    SELECT species, site_num, id_site, {Z_START} AS z FROM slots""")
def start_membership(t: Inputs):
    return starts.init_membership(t.sizes, 0.2)


@query("start_membership_drawn", "slots", f"""
    SELECT species, site_num, CAST(sum(CASE WHEN id_site <= n THEN 1
      WHEN {uniform(1, 'species', 'site_num', 'id_site')} < 0.05e0 + 0.15e0 * {uniform(1, "'psi'")}
      THEN 1 ELSE 0 END) AS BIGINT) AS members FROM slots GROUP BY ALL""")
def start_membership_drawn(t: Inputs):
    return starts.init_membership(t.sizes).groupBy("species", "site_num").agg(
        F.sum("z").alias("members"))


@query("start_activity_centres", "slots centres", f"""
    SELECT s.species, s.site_num, s.id_site, coalesce(c.loc, -1.5e0 + ((least_traps - 1) * 25e0
      + 150e0 + 150e0) / 100 * {uniform(2, 's.species', 's.site_num', 's.id_site')}) AS s
    FROM (SELECT *, (SELECT min(max_traps) FROM sizes) AS least_traps FROM slots) s
    LEFT JOIN centres c ON c.species = s.species AND c.site_num = s.site_num
      AND c.id_site = s.id_site""", "s", 3)
def start_activity_centres(t: Inputs):
    return starts.init_activity_centres(
        t.sizes, histories.observed_activity_centres(t.known))


@query("start_centres_own_site", "slots centres space", f"""
    SELECT s.species, s.site_num, s.id_site, coalesce(c.loc, x.xlim1 + (x.xlim2 - x.xlim1)
      * {uniform(2, 's.species', 's.site_num', 's.id_site')}) AS s
    FROM slots s JOIN space x ON x.site_num = s.site_num
    LEFT JOIN centres c ON c.species = s.species AND c.site_num = s.site_num
      AND c.id_site = s.id_site""", "s", 3)
def start_centres_own_site(t: Inputs):
    return starts.init_activity_centres(
        t.sizes, histories.observed_activity_centres(t.known), state_space=t.space)


@query("older_activity_centres", "slots em positions space", f"""
    SELECT s.species, s.site_num, s.id_site, coalesce(c.loc, x.xlim1 + (x.xlim2 - x.xlim1)
      * {uniform(3, 's.species', 's.site_num', 's.id_site')}) AS s
    FROM slots s JOIN space x ON x.site_num = s.site_num
    LEFT JOIN (SELECT e.species, e.site_num, e.id_site, sum(e.count * p.pos) / sum(e.count) AS loc
               FROM em e JOIN positions p ON p.site_num = e.site_num AND p.trap = e.trap
               GROUP BY ALL) c
      ON c.species = s.species AND c.site_num = s.site_num AND c.id_site = s.id_site""", "s", 3)
def older_activity_centres(t: Inputs):
    return starts.older_activity_centres(t.sizes, t.numbered, t.positions, t.space)


@query("blank_beyond_size", "sizes", """
    SELECT species, site_num, count(*) AS width, count(s) AS filled FROM (
      SELECT species, site_num, CASE WHEN id_site <= m THEN 0 END AS s FROM (
        SELECT species, site_num, m, unnest(range(1, widest + 1)) AS id_site FROM (
          SELECT *, max(m) OVER (PARTITION BY species) AS widest FROM sizes)))
    GROUP BY ALL""")
def blank_beyond_size(t: Inputs):
    widest = t.sizes.groupBy("species").agg(F.max("m").alias("m"))
    full = starts.zero_slots(t.sizes.drop("m").join(F.broadcast(widest), "species"), "s")
    return starts.blank_beyond_size(full, t.sizes, ["s"]).groupBy("species", "site_num").agg(
        F.count(F.lit(1)).alias("width"), F.count("s").alias("filled"))


@query("start_psi", "slots", f"""
    SELECT species, site_num, (any_value(n) + 1) / sum({Z_START}) AS psi FROM slots
    GROUP BY ALL""", "psi")
def start_psi(t: Inputs):
    return starts.init_psi(starts.init_membership(t.sizes, 0.2), t.sizes)


@query("start_psi_sex", "slots sexes", f"""
    SELECT s.species, (coalesce(sum(CASE x.sex WHEN 'F' THEN 1 WHEN 'M' THEN 0 END * z), 0) + 1)
      / sum(z) AS psi_sex
    FROM (SELECT *, {Z_START} AS z FROM slots) s
    LEFT JOIN sexes x ON x.species = s.species AND x.site_num = s.site_num
      AND x.id_site = s.id_site GROUP BY 1""", "psi_sex")
def start_psi_sex(t: Inputs):
    table = starts.sex_table(t.sizes, histories.first_sex(t.numbered))
    return starts.init_psi_sex(starts.init_membership(t.sizes, 0.2), table)


SEX = """SELECT s.species, s.site_num, s.id_site,
      CASE x.sex WHEN 'M' THEN 0 WHEN 'F' THEN 1 END AS sex
    FROM slots s LEFT JOIN sexes x ON x.species = s.species AND x.site_num = s.site_num
      AND x.id_site = s.id_site"""


@query("sex_table", "slots sexes", SEX)
def sex_table(t: Inputs):
    return starts.sex_table(t.sizes, histories.first_sex(t.numbered))


@query("imputed_sex", "slots sexes", f"""
    SELECT species, site_num, id_site, coalesce(sex, CASE WHEN
      {uniform(4, 'species', 'site_num', 'id_site')} < 0.3e0 + 0.5e0 * {uniform(4, "'p'")}
      THEN 1 ELSE 0 END) AS sex FROM ({SEX})""")
def imputed_sex(t: Inputs):
    return starts.impute_sex(starts.sex_table(t.sizes, histories.first_sex(t.numbered)))


@query("draws_wide", "draws", """
    SELECT chain, iteration, max(value) FILTER (parameter = 'N[1]') AS n_1,
      max(value) FILTER (parameter = 'sigma') AS sigma FROM draws
    WHERE parameter IN ('N[1]', 'sigma') GROUP BY ALL""")
def draws_wide(t: Inputs):
    return posterior.draws_wide(t.draws, ["N[1]", "sigma"], ["n_1", "sigma"])
