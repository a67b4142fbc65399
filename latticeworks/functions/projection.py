"""EPSG:4326 <-> EPSG:32630 as closed-form column expressions (Krueger series)."""

from __future__ import annotations

from math import asinh, atan2, atanh, cos, cosh, radians, sin, sinh, sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS 84 ellipsoid and UTM zone 30 north.
SEMI_MAJOR = 6_378_137.0
FLATTENING = 1 / 298.257223563
SCALE = 0.9996
FALSE_EASTING = 500_000.0
CENTRAL_MERIDIAN = -3.0

_N = FLATTENING / (2 - FLATTENING)
_RADIUS = SEMI_MAJOR / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ECC = 2 * sqrt(_N) / (1 + _N)
# Series in the third flattening n (Karney 2011, equations 35 and 36).
_ALPHA = [
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
]
_BETA = [
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
]


def to_utm(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Easting and northing in metres."""
    phi = F.radians(lat)
    lam = F.radians(lon - F.lit(CENTRAL_MERIDIAN))
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - F.lit(_ECC) * F.atanh(F.lit(_ECC) * s))
    xi = F.atan2(t, F.cos(lam))
    eta = F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(_ALPHA, start=1):
        east = east + F.lit(a) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + F.lit(a) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    k = F.lit(SCALE * _RADIUS)
    return F.lit(FALSE_EASTING) + k * east, k * north


def to_lonlat(x: Column, y: Column) -> tuple[Column, Column]:
    """Longitude and latitude in degrees."""
    k = SCALE * _RADIUS
    xi, eta = y / F.lit(k), (x - F.lit(FALSE_EASTING)) / F.lit(k)
    xi1, eta1 = xi, eta
    for j, b in enumerate(_BETA, start=1):
        xi1 = xi1 - F.lit(b) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta1 = eta1 - F.lit(b) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    lam = F.atan2(F.sinh(eta1), F.cos(xi1))
    # Conformal -> geodetic latitude: fixed-point steps converge below 1e-12 rad.
    psi = F.atanh(F.sin(chi))
    phi = chi
    for _ in range(5):
        phi = F.asin(F.tanh(psi + F.lit(_ECC) * F.atanh(F.lit(_ECC) * F.sin(phi))))
    return F.degrees(lam) + F.lit(CENTRAL_MERIDIAN), F.degrees(phi)


def utm_point(lon: float, lat: float) -> tuple[float, float]:
    """Easting and northing of one fixed point (for literal centre coordinates)."""
    s, lam = sin(radians(lat)), radians(lon - CENTRAL_MERIDIAN)
    t = sinh(atanh(s) - _ECC * atanh(_ECC * s))
    xi, eta = atan2(t, cos(lam)), asinh(sin(lam) / sqrt(t * t + cos(lam) ** 2))
    east = eta + sum(a * cos(2 * j * xi) * sinh(2 * j * eta) for j, a in enumerate(_ALPHA, 1))
    north = xi + sum(a * sin(2 * j * xi) * cosh(2 * j * eta) for j, a in enumerate(_ALPHA, 1))
    return FALSE_EASTING + SCALE * _RADIUS * east, SCALE * _RADIUS * north
