"""The driver tables shaped as captures, traps, draws, latent states and parameters."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trapline.operators.histories import Widths, widths
from trapline.sources.lookups import N_DAYS, covariate_table, effort_table, species_caps

LETTERS = "ACDEFGJKLMNOHI"
#: Latent slots of a site that rows of lineitem fall on.
SLOTS = 200
PARAMETERS = ("N[1]", "N[2]", "sigma", "beta_1", "alpha0[1,1]")


def lineitem_iteration() -> Column:
    """Seven iterations for each 15,000 orders, so latent states grow with the table."""
    return F.col("l_linenumber").cast("bigint") + 7 * F.floor(F.col("l_orderkey") / 15_000)


class Tables:
    """Lazy views over one folder of driver tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def effort(self) -> DataFrame:
        return effort_table(self.spark)

    @cached_property
    def covariates(self) -> DataFrame:
        return covariate_table(self.spark)

    @cached_property
    def species_caps(self) -> DataFrame:
        return species_caps(self.spark)

    @cached_property
    def captures(self) -> DataFrame:
        """One row per trap capture, without the first-capture mark. Every event is one; the days
        of the month take turns as the days of a session, a few captures fall on a further day,
        and a few carry the number of a trap that their site does not have."""
        user, event = F.col("user_id"), F.col("event_id")
        events = self.raw("events").withColumn(
            "site", F.substring(F.lit(LETTERS), (user % 14).cast("int") + 1, F.lit(1)))
        species = (F.when(user % 4 == 0, "CPIC").when(user % 4 == 1, "PRUB")
                   .when(user % 4 == 2, "CSER").otherwise("SODO"))
        sex = (F.when(user % 25 == 3, "U").when(user % 25 == 4, F.lit(None).cast("string"))
               .when(user % 3 == 0, "M").otherwise("F"))
        traps = F.coalesce("max_traps", F.lit(3))
        return events.join(F.broadcast(self.effort), "site", "left").select(
            event.alias("capture_id"), "site", "site_num", species.alias("species"),
            user.alias("ind"), sex.alias("sex"),
            F.when(event % 41 == 0, N_DAYS + 1).otherwise(
                (F.dayofmonth("ts") - 1) % N_DAYS + 1).alias("day"),
            F.when(event % 53 == 0, traps + 1).otherwise((event % traps).cast("int") + 1).alias(
                "trap"),
            F.when(event % 97 != 0, F.col("value")).alias("carapace"),
            (F.col("value") * 2).alias("mass"), "ts")

    @cached_property
    def widths(self) -> Widths:
        """Traps and days that the tables must hold, from the effort table and the whole log."""
        return widths(self.effort, self.captures)

    @cached_property
    def marked_captures(self) -> DataFrame:
        """Captures with recap = N on the first capture of an individual and R on the others.
        The first one is a minimum per individual and is matched on the capture key, so a
        heavily recaptured individual never becomes one sort or one join task."""
        first = self.captures.groupBy("ind").agg(
            F.min_by("capture_id", F.struct("ts", "capture_id")).alias("capture_id"))
        first = first.select("capture_id", F.lit("N").alias("_new"))
        return self.captures.join(first, "capture_id", "left").withColumn(
            "recap", F.coalesce("_new", F.lit("R"))).drop("_new")

    @cached_property
    def traps(self) -> DataFrame:
        step = F.col("s_suppkey") % 50
        return self.raw("supplier").select(
            F.col("s_suppkey").alias("trap_id"),
            ((F.col("s_nationkey") % 12).cast("int") + 1).alias("site_num"),
            (39.5 + step * 2e-4).alias("lat"), (-78.7 + step * 3e-4).alias("lon"))

    @cached_property
    def trap_places(self) -> DataFrame:
        """A place for every trap of the effort table: a base place, shifted by the mean offset of
        all suppliers that fall on the trap. Only one row per trap leaves the partial means."""
        trap = F.explode(F.sequence(F.lit(1), F.col("max_traps"))).alias("trap")
        grid = self.effort.select("site_num", trap)
        granted = F.broadcast(self.effort.select("site_num", "max_traps"))
        shifts = self.traps.join(granted, "site_num").groupBy(
            "site_num", ((F.col("trap_id") % F.col("max_traps")).cast("int") + 1).alias("trap")
        ).agg(F.avg(F.col("trap_id") % 50).alias("shift"))
        shift = F.coalesce("shift", F.lit(0.0))
        # one row per trap of the effort table on both sides
        return grid.join(F.broadcast(shifts), ["site_num", "trap"], "left").select(
            "site_num", "trap", (F.col("site_num") * 100 + F.col("trap")).alias("trap_id"),
            (39.5 + F.col("trap") * 2e-4 + shift * 1e-6).alias("lat"),
            (-78.7 + F.col("trap") * 3e-4 + shift * 1.5e-6).alias("lon"))

    @cached_property
    def draws(self) -> DataFrame:
        event = F.col("event_id")
        place = F.floor(event / 4) % len(PARAMETERS)
        parameter = F.lit(PARAMETERS[-1])
        for i, name in reversed(list(enumerate(PARAMETERS[:-1]))):
            parameter = F.when(place == i, name).otherwise(parameter)
        return self.raw("events").select(
            (event % 4).cast("int").alias("chain") + 1,
            (F.floor(event / 20) + 1).alias("iteration"), parameter.alias("parameter"), "value"
        ).toDF("chain", "iteration", "parameter", "value")

    @cached_property
    def prior_draws(self) -> DataFrame:
        """Draws with their upper parameters; some lie outside the support of their prior."""
        event, value = F.col("event_id"), F.col("value")
        names = F.array(*[F.lit(n) for n in (
            "sigma", "beta_1", "alpha0[1,1]", "alpha0[1,2]", "mu_0", "sd_0", "psi[1]", "N[1]")])
        place = F.floor(event / 4) % 8
        base = F.element_at(names, place.cast("int") + 1)
        return self.raw("events").select(
            ((event % 4) + 1).cast("int").alias("chain"),
            (F.floor(event / 32) + 1).alias("iteration"), base.alias("parameter"),
            F.when(place == 5, event % 13 / 2.0 - 0.5).when(place == 6, event % 11 / 10.0)
            .otherwise(value / 10 - 1).alias("value"))

    @cached_property
    def tied_draws(self) -> DataFrame:
        """A parameter of counts that are mostly 0, a constant one and a plain one."""
        event = F.col("event_id")
        place = F.floor(event / 4) % 3
        return self.raw("events").select(
            ((event % 4) + 1).cast("int").alias("chain"),
            (F.floor(event / 12) + 1).alias("iteration"),
            F.when(place == 0, "N[3]").when(place == 1, "beta_2").otherwise("sigma").alias(
                "parameter"),
            F.when(place == 0, F.when(event % 5 < 4, 0.0).otherwise((event % 7).cast("double")))
            .when(place == 1, 0.5).otherwise(F.col("value")).alias("value"))

    @cached_property
    def latent(self) -> DataFrame:
        """One row per draw, site and slot. The rows are dealt by draw and site once (a draw and
        site have one line of each of 3,750 orders at most), so what is worked out per draw and
        site, however finely, does not move again."""
        keyed = self.raw("lineitem").select(
            ((F.col("l_orderkey") % 4).cast("int") + 1).alias("chain"),
            lineitem_iteration().alias("iteration"),
            ((F.col("l_suppkey") % 12).cast("int") + 1).alias("site_num"),
            ((F.col("l_partkey") % SLOTS).cast("int") + 1).alias("id_site"),
            F.when(F.col("l_discount") >= 0.05, 1).otherwise(0).alias("z"), "l_quantity",
            (F.col("l_partkey") % 2).cast("int").alias("sex"))
        keys = ["chain", "iteration", "site_num"]
        return keyed.repartition(*keys).groupBy(*keys, "id_site").agg(
            F.max("z").alias("z"), (F.min("l_quantity") / 10).alias("s"),
            F.max("sex").alias("sex"))

    @cached_property
    def params(self) -> DataFrame:
        """Parameter draws by site and day for the draws present in the latent table."""
        kept = self.raw("lineitem").select(
            ((F.col("l_orderkey") % 4) + 1).cast("int").alias("chain"),
            lineitem_iteration().alias("iteration")).distinct()
        sites = F.array(*[F.lit(g) for g in range(1, 13)])
        days = F.sequence(F.lit(1), F.lit(self.widths.days))
        grid = kept.withColumn("site_num", F.explode(sites)).withColumn("day", F.explode(days))
        chain, it, site = F.col("chain"), F.col("iteration") % 7, F.col("site_num")
        return grid.select(
            "chain", "iteration", "site_num", "day",
            (-3.0 + (chain + it + site + F.col("day")) / 20.0).alias("alpha0"),
            F.lit(0.5).alias("alpha2"), F.lit(0.3).alias("alpha3"),
            (1.0 + it / 10.0).alias("sigma"), (1.2 + it / 8.0 + site / 50.0).alias("sigma_f"),
            (0.1 + chain / 20.0 + site / 60.0).alias("psi"))
