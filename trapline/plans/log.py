"""Queries over the capture log: files, filters, joins, counts and ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from trapline.operators import filters, histories, ranks, summaries
from trapline.plans.inputs import Inputs
from trapline.plans.registry import query
from trapline.session import scratch
from trapline.sources import files, store
from trapline.sources.lookups import RunConfig


def _scratch(t: Inputs, name: str) -> str:
    return scratch(t.spark, name)


# ---- files and store -------------------------------------------------------------------------

@query("csv_table", "captures", """
    SELECT site, species, count(*) AS n, count(sex) AS n_sexed, count(carapace) AS n_measured,
      sum(mass) AS mass FROM captures GROUP BY ALL""", "mass")
def csv_table(t: Inputs):
    path = _scratch(t, "captures")
    t.captures.select("site", "species", "ind", "sex", "day", "trap", "carapace", "mass").write.csv(
        path, header=True, nullValue="NA")
    back = files.read_table(t.spark, path, "site STRING, species STRING, ind BIGINT, sex STRING, "
                            "day INT, trap INT, carapace DOUBLE, mass DOUBLE")
    return back.groupBy("site", "species").agg(
        F.count(F.lit(1)).alias("n"), F.count("sex").alias("n_sexed"),
        F.count("carapace").alias("n_measured"), F.sum("mass").alias("mass"))


@query("csv_vector", "captures", """
    SELECT count(carapace) AS n, sum(carapace) AS total, max(carapace) AS largest
    FROM captures""", "total largest")
def csv_vector(t: Inputs):
    path = _scratch(t, "vector")
    t.captures.select("carapace").write.csv(path, header=False, nullValue="NA")
    vector = files.read_vector(t.spark, path)
    return vector.agg(F.count("v").alias("n"), F.sum("v").alias("total"),
                      F.max("v").alias("largest"))


@query("csv_trailing_column", "captures", """
    SELECT count(mass) AS n, avg(mass) AS mean FROM captures""", "mean")
def csv_trailing_column(t: Inputs):
    path = _scratch(t, "trailing")
    t.captures.select("mass", F.lit("").alias(" ")).write.csv(path, header=True, emptyValue="")
    mass = files.read_column(t.spark, path, "mass")
    return mass.agg(F.count("mass").alias("n"), F.avg("mass").alias("mean"))


@query("csv_row_keys", "", """
    SELECT CAST(row_number() OVER (ORDER BY s_suppkey) AS BIGINT) AS row_key, s_acctbal AS v
    FROM supplier""", "v")
def csv_row_keys(t: Inputs):
    """Supplier balances in key order as one vector file; the place in the file is the key."""
    path = _scratch(t, "rows")
    balances = t.raw("supplier").select("s_suppkey", "s_acctbal")
    ranged = balances.repartitionByRange("s_suppkey").sortWithinPartitions("s_suppkey")
    ranged.select("s_acctbal").write.csv(path, header=False)
    return files.with_row_key(files.read_vector(t.spark, path), across=True)


@query("stored_history", "history", """
    SELECT site_num, ind, id_site, trap, day, max_traps, count FROM history
    WHERE species = 'SODO'""")
def stored_history(t: Inputs):
    root = _scratch(t, "derived")
    history = histories.complete_history(t.histories, *t.span)
    store.save_derived({"history": history}, root, "2020-05-23")
    config = RunConfig("SODO", "2020-05-23")
    return store.load_derived(t.spark, root, "history", config).drop("species").select(
        "site_num", "ind", "id_site", "trap", "day", "max_traps", "count")


@query("stored_draws", "draws", "SELECT chain, iteration, parameter, value FROM draws")
def stored_draws(t: Inputs):
    root = _scratch(t, "draws")
    config = RunConfig("CPIC", "2020-05-23")
    store.save_draws(t.draws, root, config)
    return store.load_draws(t.spark, root, config).select(
        "chain", "iteration", "parameter", "value")


@query("run_sizes", "per_site caps", """
    SELECT p.species, p.site_num, CAST(c.cap AS INTEGER) AS cap,
      CASE WHEN p.n > c.cap THEN c.cap ELSE p.n END AS n_used
    FROM per_site p JOIN caps c ON c.species = p.species""")
def run_sizes(t: Inputs):
    return t.per_site.select("species", "site_num", "cap", F.least("n", "cap").alias("n_used"))


# ---- filters and projections -----------------------------------------------------------------

@query("sexed_captures", "captures", """
    SELECT capture_id, site, sex FROM captures WHERE sex <> 'U' AND sex IS NOT NULL""")
def sexed_captures(t: Inputs):
    return filters.sexed_only(t.captures).select("capture_id", "site", "sex")


@query("species_captures", "captures", """
    SELECT capture_id, site_num, ind FROM captures
    WHERE site NOT IN ('H', 'I') AND species = 'CPIC'""")
def species_captures(t: Inputs):
    return filters.select_species(t.captures, "CPIC").select("capture_id", "site_num", "ind")


@query("without_individual", "captures", """
    SELECT species, ind, count(*) AS n FROM captures WHERE ind <> 70 OR species <> 'CSER'
    GROUP BY ALL""")
def without_individual(t: Inputs):
    return filters.exclude_individual(t.captures).groupBy("species", "ind").agg(
        F.count(F.lit(1)).alias("n"))


@query("projected_captures", "captures", """
    SELECT capture_id, site_num AS session, ind AS individual, trap AS trap_number, day
    FROM captures""")
def projected_captures(t: Inputs):
    return t.captures.drop("mass", "carapace", "ts", "species", "sex", "site").withColumnsRenamed(
        {"site_num": "session", "ind": "individual", "trap": "trap_number"})


@query("filled_counts", "history effort", """
    SELECT species, site_num, count(*) AS cells, count(*) FILTER (count IS NULL) AS missing,
      count(*) FILTER (count = 0) AS zeros, CAST(coalesce(sum(count), 0) AS BIGINT) AS captures
    FROM history GROUP BY ALL""")
def filled_counts(t: Inputs):
    rows = histories.complete_history(t.histories, *t.span)
    return rows.groupBy("species", "site_num").agg(
        F.count(F.lit(1)).alias("cells"), F.count_if(F.col("count").isNull()).alias("missing"),
        F.count_if(F.col("count") == 0).alias("zeros"),
        F.coalesce(F.sum("count"), F.lit(0)).alias("captures"))


@query("sex_codes", "captures", """
    SELECT sex, CASE sex WHEN 'M' THEN 0 WHEN 'F' THEN 1 END AS sex_code, count(*) AS n
    FROM captures GROUP BY ALL""")
def sex_codes(t: Inputs):
    return t.captures.groupBy("sex", filters.sex_code(F.col("sex")).alias("sex_code")).agg(
        F.count(F.lit(1)).alias("n"))


@query("truncated_sizes", "sizes", """
    SELECT species, site_num, CAST(trunc(m_raw) AS INTEGER) AS m FROM sizes""")
def truncated_sizes(t: Inputs):
    return t.sizes.select("species", "site_num", filters.truncated(F.col("m_raw")).alias("m"))


@query("closed_trap_ids", "traps", """
    SELECT trap_id, CASE WHEN trap_id >= 61 THEN trap_id - 6 ELSE trap_id END AS closed_id
    FROM traps""")
def closed_trap_ids(t: Inputs):
    return t.traps.select("trap_id", filters.closed_trap_id(F.col("trap_id")).alias("closed_id"))


@query("prefix_parameters", "draws", """
    SELECT parameter, count(*) AS n, max(value) AS largest FROM draws
    WHERE parameter LIKE 'N[%' GROUP BY ALL""", "largest")
def prefix_parameters(t: Inputs):
    return filters.with_prefix(t.draws, "N[").groupBy("parameter").agg(
        F.count(F.lit(1)).alias("n"), F.max("value").alias("largest"))


@query("pattern_parameters", "draws", """
    SELECT parameter, chain, count(*) AS n FROM draws
    WHERE regexp_matches(parameter, 'sig|^alpha0') GROUP BY ALL""")
def pattern_parameters(t: Inputs):
    return filters.matching(t.draws, ["sig", "^alpha0"]).groupBy("parameter", "chain").agg(
        F.count(F.lit(1)).alias("n"))


@query("base_parameters", "draws", """
    SELECT parameter, count(*) AS n FROM draws
    WHERE split_part(parameter, '[', 1) IN ('N', 'sigma') GROUP BY ALL""")
def base_parameters(t: Inputs):
    return filters.with_base(t.draws, ["N", "sigma"]).groupBy("parameter").agg(
        F.count(F.lit(1)).alias("n"))


@query("parsed_parameters", "draws", """
    SELECT parameter, split_part(parameter, '[', 1) AS base,
      CAST(nullif(regexp_extract(parameter, '\\[(\\d+)', 1), '') AS INTEGER) AS first_index,
      CAST(nullif(regexp_extract(parameter, ',(\\d+)\\]', 1), '') AS INTEGER) AS second_index,
      count(*) AS n
    FROM draws GROUP BY ALL""")
def parsed_parameters(t: Inputs):
    rows = filters.parsed(t.draws)
    return rows.groupBy("parameter", "base", F.get("idx", F.lit(0)).alias("first_index"),
                        F.get("idx", F.lit(1)).alias("second_index")).agg(
        F.count(F.lit(1)).alias("n"))


@query("caught_cells", "history", """
    SELECT species, site_num, id_site, trap, day, count FROM history
    WHERE count <> 0 AND id_site IS NOT NULL""")
def caught_cells(t: Inputs):
    return histories.caught_cells(t.known).select(
        "species", "site_num", "id_site", "trap", "day", "count")


@query("unsexed_captures", "captures", """
    SELECT capture_id, site, species, sex FROM captures WHERE sex = 'U' OR sex IS NULL""")
def unsexed_captures(t: Inputs):
    return t.captures.where((F.col("sex") == "U") | F.col("sex").isNull()).select(
        "capture_id", "site", "species", "sex")


# ---- joins -----------------------------------------------------------------------------------

@query("site_lookup", "captures", "SELECT capture_id, site, site_num FROM captures")
def site_lookup(t: Inputs):
    log = t.captures.select("capture_id", "site")
    return histories.attach_site(log, t.effort.select("site", "site_num"))


@query("effort_lookup", "counts effort", """
    SELECT c.species, c.site_num, c.ind, c.trap, c.day, c.count, e.max_traps
    FROM counts c LEFT JOIN effort e ON e.site_num = c.site_num""")
def effort_lookup(t: Inputs):
    return histories.attach_effort(histories.capture_counts(t.kept), t.effort).select(
        "species", "site_num", "ind", "trap", "day", "count", "max_traps")


@query("all_sites", "captures effort caps", """
    SELECT p.species, e.site_num, coalesce(c.n, 0) AS n FROM effort e CROSS JOIN caps p
    LEFT JOIN (SELECT species, site_num, count(*) AS n FROM captures GROUP BY ALL) c
    ON c.species = p.species AND c.site_num = e.site_num""")
def all_sites(t: Inputs):
    found = t.captures.where("site_num IS NOT NULL").groupBy("species", "site_num").agg(
        F.count(F.lit(1)).alias("n"))
    every = histories.site_species(t.effort, t.species_caps).select("species", "site_num")
    return found.join(every, ["species", "site_num"], "full").withColumn(
        "n", F.coalesce("n", F.lit(0)))


@query("trap_use", "effort captures", """
    SELECT g.site_num, CAST(g.trap AS INTEGER) AS trap, count(c.capture_id) AS n
    FROM (SELECT site_num, unnest(range(1, max_traps + 1)) AS trap FROM effort) g
    LEFT JOIN captures c ON c.site_num = g.site_num AND c.trap = g.trap GROUP BY ALL""")
def trap_use(t: Inputs):
    used = t.captures.groupBy("site_num", "trap").agg(F.count(F.lit(1)).alias("n"))
    return histories.trap_grid(t.effort).select("site_num", "trap").join(
        used, ["site_num", "trap"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query("trap_day_use", "effort days captures", """
    SELECT g.site_num, CAST(g.trap AS INTEGER) AS trap, g.day, count(c.capture_id) AS n
    FROM (SELECT site_num, unnest(range(1, max_traps + 1)) AS trap, day
          FROM effort CROSS JOIN days) g
    LEFT JOIN captures c ON c.site_num = g.site_num AND c.trap = g.trap AND c.day = g.day
    GROUP BY ALL""")
def trap_day_use(t: Inputs):
    used = t.captures.groupBy("site_num", "trap", "day").agg(F.count(F.lit(1)).alias("n"))
    keys = ["site_num", "trap", "day"]
    return histories.trap_day_grid(t.effort, t.widths.days).select(*keys).join(used, keys, "left").withColumn(
        "n", F.coalesce("n", F.lit(0)))


@query("complete_history", "history", """
    SELECT species, site_num, ind, id_site, trap, day, max_traps, count FROM history""")
def complete_history(t: Inputs):
    return histories.complete_history(t.histories, *t.span)


@query("older_history", "em", """
    SELECT i.species, i.site_num, i.ind, i.id_site, t.trap, d.day, c.count
    FROM (SELECT DISTINCT species, site_num, ind, id_site FROM em) i
    JOIN (SELECT DISTINCT species, trap FROM em) t ON t.species = i.species
    JOIN (SELECT DISTINCT species, day FROM em) d ON d.species = i.species
    LEFT JOIN (SELECT species, site_num, ind, trap, day, CAST(sum(count) AS BIGINT) AS count
               FROM em GROUP BY ALL) c
      ON c.species = i.species AND c.site_num = i.site_num AND c.ind IS NOT DISTINCT FROM i.ind
      AND c.trap = t.trap AND c.day = d.day""")
def older_history(t: Inputs):
    return histories.older_history(t.numbered)


@query("null_safe_lookup", "captures", """
    SELECT a.species, a.sex, a.n, b.last_day FROM
      (SELECT species, sex, count(*) AS n FROM captures GROUP BY ALL) a
    LEFT JOIN (SELECT species, sex, max(day) AS last_day FROM captures
               WHERE site NOT IN ('H', 'I') GROUP BY ALL) b
      ON b.species = a.species AND b.sex IS NOT DISTINCT FROM a.sex""")
def null_safe_lookup(t: Inputs):
    n = t.captures.groupBy("species", "sex").agg(F.count(F.lit(1)).alias("n"))
    last = filters.select_species(t.captures).groupBy("species", "sex").agg(
        F.max("day").alias("last_day"))
    return histories.null_safe_join(n, last, ["species", "sex"])


@query("first_match", "kept effort caps days", """
    SELECT g.species, g.site_num, g.day, f.ind, f.trap FROM
      (SELECT p.species, e.site_num, d.day
       FROM effort e CROSS JOIN caps p CROSS JOIN days d) g
    LEFT JOIN (SELECT species, site_num, day, ind, trap, row_number() OVER (
        PARTITION BY species, site_num, day ORDER BY ts, capture_id) AS place FROM kept) f
      ON f.species = g.species AND f.site_num = g.site_num AND f.day = g.day AND f.place = 1""")
def first_match(t: Inputs):
    grid = histories.site_species(t.effort, t.species_caps).select(
        "species", "site_num", F.explode(F.sequence(
            F.lit(1), F.lit(t.widths.days))).alias("day"))
    return summaries.first_match(grid, t.kept, ["species", "site_num", "day"],
                                 ["ts", "capture_id"], ["ind", "trap"])


# ---- counts ----------------------------------------------------------------------------------

@query("capture_counts", "counts", "SELECT * FROM counts")
def capture_counts(t: Inputs):
    return histories.capture_counts(t.kept)


@query("individuals_per_site", "per_site", "SELECT species, site_num, n FROM per_site")
def individuals_per_site(t: Inputs):
    return t.per_site.select("species", "site_num", "n")


@query("distinct_individuals", "captures", """
    SELECT species, site_num, count(*) AS n_ind FROM (
      SELECT DISTINCT species, site_num, ind FROM captures WHERE site NOT IN ('H', 'I'))
    GROUP BY ALL""")
def distinct_individuals(t: Inputs):
    return histories.distinct_individuals(filters.select_species(t.captures))


@query("augmentation_size", "sizes", """
    SELECT species, site_num, n, m_raw, m FROM sizes""", "m_raw")
def augmentation_size(t: Inputs):
    return t.sizes.select("species", "site_num", "n", "m_raw", "m")


@query("older_augmentation_size", "per_site", """
    SELECT species, site_num, greatest(CAST(floor(n / 3e-2 + 10) AS INTEGER), 14) AS m
    FROM per_site""")
def older_augmentation_size(t: Inputs):
    return histories.older_augmentation_size(t.per_site, extra=10, floor_at=14).select(
        "species", "site_num", "m")


@query("individual_covariates", "captures", """
    SELECT site_num, site, ind, species, sex,
      CASE WHEN count(carapace) = count(*) THEN avg(carapace) END AS carapace,
      CASE WHEN count(mass) = count(*) THEN avg(mass) END AS mass,
      count(*) AS n_measurements, avg(trap) AS mean_trap
    FROM captures WHERE sex <> 'U' AND sex IS NOT NULL GROUP BY ALL""",
       "carapace mass mean_trap", 9)
def individual_covariates(t: Inputs):
    return histories.individual_covariates(filters.sexed_only(t.captures))


@query("captures_by_day", "caps_day", "SELECT species, day, caps FROM caps_day")
def captures_by_day(t: Inputs):
    return histories.captures_by_day(t.histories, t.widths.days)


@query("observed_activity_centres", "centres", "SELECT * FROM centres", "loc")
def observed_activity_centres(t: Inputs):
    return histories.observed_activity_centres(t.known)


@query("capture_summary", "captures", """
    SELECT variable, count(*) - count(value) AS n_null, min(value) AS minimum,
      quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
      quantile_cont(value, 0.75) AS q3, max(value) AS maximum, avg(value) AS mean
    FROM (SELECT 'carapace' AS variable, carapace AS value FROM captures
          UNION ALL SELECT 'mass', mass FROM captures
          UNION ALL SELECT 'trap', CAST(trap AS DOUBLE) FROM captures)
    GROUP BY 1""", "minimum q1 median q3 maximum mean", 9)
def capture_summary(t: Inputs):
    return summaries.column_summary(t.captures, ["carapace", "mass", "trap"])


@query("array_size", "per_site alltraps days", """
    SELECT species, CAST(max(n) * (SELECT count(*) FROM alltraps CROSS JOIN days) * count(*)
        AS BIGINT) AS array_size,
      CAST(sum(n * max_traps * (SELECT count(*) FROM days)) AS BIGINT) AS likelihood_cells
    FROM per_site GROUP BY 1""")
def array_size(t: Inputs):
    return summaries.array_size(t.per_site, *t.span)


@query("expected_rows_check", "history per_site", """
    SELECT e.species, expected_rows, history_rows, expected_rows = history_rows AS rows_ok,
      expected_wide, wide_rows, expected_wide = wide_rows AS wide_ok
    FROM (SELECT species, CAST(sum(n * (SELECT count(*) FROM alltraps CROSS JOIN days)) AS BIGINT)
              AS expected_rows,
            CAST(sum(n * (SELECT count(*) FROM days)) AS BIGINT) AS expected_wide
          FROM per_site GROUP BY 1) e
    LEFT JOIN (SELECT species, count(*) AS history_rows FROM history GROUP BY 1) h
      ON h.species = e.species
    LEFT JOIN (SELECT species, count(*) AS wide_rows FROM (
        SELECT DISTINCT species, site_num, ind, day FROM history)
      GROUP BY 1) w ON w.species = e.species""")
def expected_rows_check(t: Inputs):
    return summaries.expected_rows_check(histories.complete_history(t.histories, *t.span),
                                         histories.history_wide(t.histories, *t.span), t.per_site,
                                         *t.span)


@query("new_captures", "captures", """
    SELECT species, site_num, count(*) FILTER (recap = 'N') AS n_new
    FROM captures WHERE site NOT IN ('H', 'I')
    GROUP BY GROUPING SETS ((species, site_num), (species))""")
def new_captures(t: Inputs):
    return summaries.new_captures(filters.select_species(t.marked_captures))


@query("last_day", "captures", "SELECT max(day) AS max_day FROM captures")
def last_day(t: Inputs):
    return summaries.maximum(t.captures, "day", strict=True)


@query("distinct_sexes", "kept", "SELECT DISTINCT species, sex FROM kept")
def distinct_sexes(t: Inputs):
    return t.kept.select("species", "sex").distinct()


@query("collapsed_days", "history", """
    SELECT species, site_num, id_site, trap, CAST(sum(count) AS BIGINT) AS captures,
      CASE WHEN max(count) > 0 THEN 1 ELSE 0 END AS caught
    FROM history WHERE id_site IS NOT NULL AND trap <= max_traps GROUP BY ALL""")
def collapsed_days(t: Inputs):
    return summaries.collapsed(histories.observed_history(t.known, t.widths.days),
                               ["species", "site_num", "id_site", "trap"])


@query("ever_caught", "history", """
    SELECT species, site_num, id_site, CAST(sum(count) AS BIGINT) AS captures,
      CASE WHEN max(count) > 0 THEN 1 ELSE 0 END AS caught
    FROM history WHERE id_site IS NOT NULL GROUP BY ALL""")
def ever_caught(t: Inputs):
    return summaries.collapsed(histories.caught_cells(t.known),
                               ["species", "site_num", "id_site"])


@query("latent_sums", "latent", """
    SELECT chain, iteration, site_num, CAST(sum(z) AS BIGINT) AS members,
      CAST(sum(sex * z) AS BIGINT) AS female_members FROM latent GROUP BY ALL""")
def latent_sums(t: Inputs):
    return summaries.latent_sums(t.latent)


# ---- ids, running flags and order ------------------------------------------------------------

@query("site_individual_ids", "em", """
    SELECT DISTINCT species, site_num, ind, id_site FROM em WHERE ind IS NOT NULL""")
def site_individual_ids(t: Inputs):
    return histories.individual_ids(histories.capture_counts(t.kept)).select(
        "species", "site_num", "ind", "id_site")


@query("global_ids", "captures", """
    SELECT DISTINCT ind, CAST(dense_rank() OVER (ORDER BY ind) AS BIGINT) AS id FROM captures""")
def global_ids(t: Inputs):
    return ranks.dense_ids(t.captures, [], "ind", "id", "bigint")


@query("site_traps", "captures", """
    SELECT DISTINCT species, site_num, trap, CAST(dense_rank() OVER (
      PARTITION BY species, site_num ORDER BY trap) AS INTEGER) AS site_trap
    FROM captures WHERE site NOT IN ('H', 'I')""")
def site_traps(t: Inputs):
    kept = filters.select_species(t.captures)
    return ranks.dense_ids(kept, ["species", "site_num"], "trap", "site_trap")


@query("lettered_sites", "captures", """
    SELECT DISTINCT site, CAST(dense_rank() OVER (ORDER BY site) AS INTEGER) AS site_code
    FROM captures""")
def lettered_sites(t: Inputs):
    return ranks.dense_ids(t.captures, [], "site", "site_code")


@query("coded_captures", "captures", """
    SELECT capture_id, ind, CAST(dense_rank() OVER (ORDER BY ind) AS INTEGER) AS id
    FROM captures""")
def coded_captures(t: Inputs):
    return summaries.coded(t.captures.select("capture_id", "ind"), [], "ind", "id").select(
        "capture_id", "ind", "id")


@query("recapture_flags", "flags", """
    SELECT species, site_num, ind, id_site, day, recap FROM flags""")
def recapture_flags(t: Inputs):
    return histories.recapture_flags(t.known, t.widths.days)


@query("behaviour_from_flag", "captures days", """
    SELECT i.species, i.site_num, i.ind, d.day,
      CASE WHEN d.day > i.marked THEN 1 ELSE 0 END AS behaviour
    FROM (SELECT species, site_num, ind, min(CASE WHEN recap = 'N' THEN day END) AS marked
          FROM captures WHERE site NOT IN ('H', 'I') GROUP BY ALL) i CROSS JOIN days d""")
def behaviour_from_flag(t: Inputs):
    return histories.behaviour_from_flag(filters.select_species(t.marked_captures),
                                         t.widths.days)


@query("standardized_captures", "captures", """
    SELECT capture_id, (carapace - avg(carapace) OVER ()) / stddev_samp(carapace) OVER ()
      AS carapace_std, (mass - avg(mass) OVER ()) / stddev_samp(mass) OVER () AS mass_std
    FROM captures""", "carapace_std mass_std")
def standardized_captures(t: Inputs):
    return summaries.standardize(t.captures, ["carapace", "mass"]).select(
        "capture_id", "carapace_std", "mass_std")


@query("arranged_covariates", "captures", """
    SELECT site_num, species, ind, count(*) AS n FROM captures
    WHERE site_num IS NOT NULL GROUP BY ALL""")
def arranged_covariates(t: Inputs):
    return t.captures.where("site_num IS NOT NULL").groupBy("site_num", "species", "ind").agg(
        F.count(F.lit(1)).alias("n")).orderBy("site_num", "species", "ind")


@query("stored_order", "captures", """
    SELECT *, row_number() OVER (ORDER BY site_num, species, ind) AS place FROM (
      SELECT site_num, species, ind, count(*) AS n FROM captures
      WHERE site_num IS NOT NULL GROUP BY ALL)""")
def stored_order(t: Inputs):
    """The order itself: rows come back from the ordered store with their places."""
    path, order = scratch(t.spark, "ordered"), ["site_num", "species", "ind"]
    store.save_ordered(arranged_covariates(t), path, order)
    return store.load_ordered(t.spark, path, order)


@query("last_captures", "captures", """
    SELECT site, ind, day, capture_id FROM captures
    ORDER BY site DESC, ind DESC, day DESC, capture_id DESC LIMIT 20""")
def last_captures(t: Inputs):
    rows = t.captures.select("site", "ind", "day", "capture_id")
    return summaries.top_rows(rows, [F.desc(c) for c in rows.columns], 20)


# ---- flagship --------------------------------------------------------------------------------

@query("recaptures_by_site_day", "history flags", """
    SELECT h.species, h.site_num, h.day, count(*) FILTER (h.caps > 0) AS individuals,
      count(*) FILTER (h.caps > 0 AND f.recap = 1) AS recaptured,
      CAST(sum(h.caps) AS BIGINT) AS captures
    FROM (SELECT species, site_num, id_site, day, coalesce(sum(count), 0) AS caps FROM history
          WHERE id_site IS NOT NULL GROUP BY ALL) h
    JOIN flags f ON f.species = h.species AND f.site_num = h.site_num AND f.id_site = h.id_site
      AND f.day = h.day
    GROUP BY ALL""")
def recaptures_by_site_day(t: Inputs):
    days = histories.daily_captures(t.known, t.widths.days)
    again = (F.col("captures") > 0) & (F.col("day") > F.col("first_day"))
    return days.groupBy("species", "site_num", "day").agg(
        F.count_if(F.col("captures") > 0).alias("individuals"),
        F.count_if(again).alias("recaptured"), F.sum("captures").alias("captures"))
