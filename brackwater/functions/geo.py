"""Distances, bearings and angles as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2))
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def destination(lat: Column, lon: Column, bearing: Column, metres: Column) -> tuple[Column, Column]:
    """Latitude and longitude reached from a point on a bearing."""
    d, b, p = metres / EARTH_M, F.radians(bearing), F.radians(lat)
    q = F.asin(F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(b))
    east = F.atan2(F.sin(b) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * F.sin(q))
    return F.degrees(q), lon + F.degrees(east)


def normal_degrees(angle: Column) -> Column:
    return F.pmod(angle, F.lit(360.0))


def angle_delta(a: Column, b: Column) -> Column:
    """Signed smallest turn from ``a`` to ``b``, in (-180, 180]."""
    turn = F.pmod(b - a, F.lit(360.0))
    return F.when(turn > 180, turn - 360).otherwise(turn)


def metres_per_degree(lat: float) -> float:
    return EARTH_M * math.pi / 180 * math.cos(math.radians(lat))
