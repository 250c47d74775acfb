"""Geodesy as column expressions: degrees in, metres and degrees out."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mean radius for distances, equatorial radius for Web Mercator.
EARTH_M, MERCATOR_M = 6371008.8, 6378137.0


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle metres."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(h))


def bearing(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Initial azimuth in [0, 360)."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    turn = F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)))
    return F.pmod(turn + 360.0, F.lit(360.0))


def to_local(lon: Column, lat: Column, lon0: Column, lat0: Column) -> tuple[Column, Column]:
    """Metres east and north of an origin, equirectangular."""
    return F.radians(lon - lon0) * EARTH_M * F.cos(F.radians(lat0)), F.radians(lat - lat0) * EARTH_M


def from_local(x: Column, y: Column, lon0: Column, lat0: Column) -> tuple[Column, Column]:
    return lon0 + F.degrees(x / (EARTH_M * F.cos(F.radians(lat0)))), lat0 + F.degrees(y / EARTH_M)


def to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.radians(lon) * MERCATOR_M, F.log(F.tan(math.pi / 4 + F.radians(lat) / 2)) * MERCATOR_M


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / MERCATOR_M), F.degrees(2 * F.atan(F.exp(y / MERCATOR_M)) - math.pi / 2)


def tile(lon: Column, lat: Column, z: int) -> tuple[Column, Column]:
    """Fractional tile coordinates at zoom z."""
    n = float(1 << z)
    phi = F.radians(lat)
    return (lon + 180) / 360 * n, (1 - F.log(F.tan(phi) + 1 / F.cos(phi)) / math.pi) / 2 * n


def distance_text(m: Column) -> Column:
    return F.when(m >= 1000, F.format_string("%.1f km", m / 1000)).otherwise(F.format_string("%.0f m", F.bround(m)))


def time_text(seconds: Column) -> Column:
    """Whole minutes: "25 min", or "1 h 05" from an hour on."""
    minutes = F.bround(seconds / 60).cast("long")
    return F.when(minutes >= 60, F.format_string("%d h %02d", F.floor(minutes / 60), minutes % 60)).otherwise(F.format_string("%d min", minutes))


def speed(slope: Column, power: float = 110, mass: float = 90, crr: float = 0.007, cda: float = 0.55, vmax_kmh: float = 32, vmin_kmh: float = 3.5) -> Column:
    """Metres per second at which the rider's power meets rolling, slope and air: the cubic's one positive root, within the limits."""
    a, b, vmax, vmin = mass * 9.81 * (crr + slope), 0.6 * cda, vmax_kmh / 3.6, vmin_kmh / 3.6
    p, q = a / b, F.lit(-power / b)
    d = q * q / 4 + p * p * p / 27
    root = F.sqrt(F.greatest(d, F.lit(0.0)))
    one = F.cbrt(-q / 2 + root) + F.cbrt(-q / 2 - root)
    m = 2 * F.sqrt(F.greatest(-p / 3, F.lit(1e-12)))
    three = m * F.cos(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 3 * q / (F.least(p, F.lit(-1e-12)) * m)))) / 3)
    return F.greatest(F.lit(vmin), F.least(F.lit(vmax), F.when(d >= 0, one).otherwise(three)))
