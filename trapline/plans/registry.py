"""Registration of queries and their twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trapline.plans.inputs import Inputs
from trapline.plans.views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, views: str = "", sql: str | None = None, doubles: str = "",
          digits: int = 6, instead: dict[str, str] | None = None):
    """Register a query over ``Inputs``. ``doubles`` are rounded on both sides; ``instead`` names
    views of the SQL that others take the place of."""
    rounded = doubles.split()

    def register(build: Callable[[Inputs], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            df = build(Inputs(spark, folder))
            return df.withColumns({c: F.round(c, digits) for c in rounded}) if rounded else df

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            body = sql
            if rounded:
                fixed = ", ".join(f"round({c}, {digits}) + 0e0 AS {c}" for c in rounded)
                body = f"SELECT * REPLACE ({fixed}) FROM ({sql})"
            ORACLES[name] = with_views(views, body, instead)
        return build

    return register
