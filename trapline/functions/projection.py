"""Transverse-Mercator projection as native Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# GRS80 ellipsoid and the UTM grid.
SEMI_MAJOR = 6378137.0
FLATTENING = 1 / 298.257222101
SCALE = 0.9996
FALSE_EASTING = 500000.0

_N = FLATTENING / (2 - FLATTENING)
RADIUS = SEMI_MAJOR / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
SERIES = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
ECCENTRICITY = 2 * math.sqrt(_N) / (1 + _N)


def utm(lat: Column, lon: Column, zone: int = 17) -> tuple[Column, Column]:
    """(easting, northing) in metres on the northern half of a UTM zone, Krueger series of
    fourth order."""
    phi = F.radians(lat)
    lam = F.radians(lon) - math.radians(zone * 6 - 183)
    conformal = F.sinh(F.atanh(F.sin(phi)) - ECCENTRICITY * F.atanh(ECCENTRICITY * F.sin(phi)))
    xi = F.atan2(conformal, F.cos(lam))
    eta = F.atanh(F.sin(lam) / F.sqrt(1 + conformal * conformal))
    east, north = eta, xi
    for j, a in enumerate(SERIES, start=1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return FALSE_EASTING + SCALE * RADIUS * east, SCALE * RADIUS * north
