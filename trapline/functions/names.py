"""Indexed parameter names such as ``alpha0[3,1]`` or the made-safe ``N.3.``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INDEXED = r"^(.*?)[\[.](\d+(?:[,.]\d+)*)[\].]$"


def base_name(parameter: Column) -> Column:
    found = F.regexp_extract(parameter, INDEXED, 1)
    return F.when(found == "", parameter).otherwise(found)


def index_list(parameter: Column) -> Column:
    """The indices as ARRAY<INT>; null for a scalar parameter."""
    found = F.regexp_extract(parameter, INDEXED, 2)
    return F.when(found != "", F.split(found, "[,.]").cast("array<int>"))
