"""Site lookups, species caps and run settings that shape every run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Site letter, order along the canal, number of traps.
SITES = (
    ("A", 2, 8), ("C", 4, 10), ("D", 6, 8), ("E", 7, 14), ("F", 1, 7), ("G", 9, 7),
    ("J", 8, 10), ("K", 3, 10), ("L", 5, 10), ("M", 10, 12), ("N", 11, 10), ("O", 12, 10),
)
# Site order, forest share, mean depth (m), width (m).
SITE_COVARIATES = (
    (1, 0.18574514, 0.843333333, 17.03), (2, 0.299086758, 0.786666667, 20.92),
    (3, 0.660714286, 0.47, 14.72), (4, 0.595573441, 0.771666667, 14.26),
    (5, 0.724899598, 0.321666667, 10.97), (6, 0.699788584, 0.433333333, 13.03),
    (7, 0.402527076, 1.06, 23.19), (8, 0.34047619, 0.498333333, 16.79),
    (9, 0.503171247, 0.82, 16.59), (10, 0.536062378, 0.686666667, 20.57),
    (11, 0.532163743, 1.22, 46.33), (12, 0.58989899, 1.303333333, 25.33),
)
# Species and the largest augmented population per site.
SPECIES_CAPS = (("CPIC", 7000), ("PRUB", 1000), ("CSER", 500), ("SODO", 1000))
TESTING_CAP = 100

N_DAYS = 4
MAX_TRAPS = 14
EXCLUDED_SITES = ("H", "I")


def literal_table(spark: SparkSession, names: tuple[str, ...], rows) -> DataFrame:
    """A handful of constant rows as an inline table; its size is known to the planner."""
    body = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(names)})")


def _literal(value) -> str:
    if isinstance(value, str):
        return f"'{value}'"
    return f"{value!r}D" if isinstance(value, float) else str(value)


def effort_table(spark: SparkSession) -> DataFrame:
    return literal_table(spark, ("site", "site_num", "max_traps"), SITES)


def covariate_table(spark: SparkSession) -> DataFrame:
    return literal_table(spark, ("site_num", "forest", "depth", "width_m"), SITE_COVARIATES)


def species_caps(spark: SparkSession, testing: bool = False) -> DataFrame:
    rows = [(s, TESTING_CAP if testing else cap) for s, cap in SPECIES_CAPS]
    return literal_table(spark, ("species", "cap"), rows)


@dataclass(frozen=True)
class RunConfig:
    """What one run is about; keys of the store."""

    species: str
    run_date: str
    testing: bool = False

    @property
    def cap(self) -> int:
        return TESTING_CAP if self.testing else dict(SPECIES_CAPS)[self.species]

    def matches(self) -> Column:
        """Partition predicate of this run."""
        return ((F.col("species") == self.species) & (F.col("run_date") == self.run_date)
                & (F.col("testing") == self.testing))


@dataclass(frozen=True)
class ChainSettings:
    """Iterations, burn-in and thinning of a stored set of chains."""

    chains: int
    iterations: int
    burn: int
    every: int


# Chains, iterations, burn-in and thinning of a full and of a testing run. The first
# kind has a longer run for species other than the first.
SETTINGS = {
    "production": (ChainSettings(8, 15000, 3000, 3), ChainSettings(2, 700, 200, 1)),
    "production_long": (ChainSettings(8, 55000, 5000, 10), ChainSettings(2, 700, 200, 1)),
    "compiled": (ChainSettings(8, 8000, 2000, 6), ChainSettings(2, 200, 100, 1)),
    "variable": (ChainSettings(6, 25000, 5000, 3), ChainSettings(2, 101, 1, 1)),
}


def chain_settings(config: RunConfig, kind: str = "production") -> ChainSettings:
    """Settings of a run; ``kind`` is one of ``SETTINGS``."""
    if kind == "production" and config.species != "CPIC":
        kind = "production_long"
    return SETTINGS[kind][config.testing]
