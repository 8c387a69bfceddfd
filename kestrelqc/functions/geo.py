"""Geometry on the sphere."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from kestrelqc.flags import InvalidArg

RADIUS_KM = 6371.0
RADIUS_MODES = ("squared_km", "km", "m")


def xyz(lat: Column, lon: Column) -> dict[str, Column]:
    """Cartesian coordinates in km."""
    la, lo = F.radians(lat.cast("double")), F.radians(lon.cast("double"))
    return {"x": F.cos(la) * F.cos(lo) * RADIUS_KM, "y": F.cos(la) * F.sin(lo) * RADIUS_KM, "z": F.sin(la) * RADIUS_KM}


def chord(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Straight distance in km between two points as from :func:`xyz`."""
    return F.sqrt(squared_chord(a, b))


def squared_chord(a: dict[str, Column], b: dict[str, Column]) -> Column:
    dx, dy, dz = (a[k] - b[k] for k in "xyz")
    return dx * dx + dy * dy + dz * dz


def great_circle(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance along the sphere in km, at most a quarter of a great circle.

    Equal coordinates are at distance 0. A latitude past 90 or a longitude past 360 degrees, either way, is an error.
    """
    p, q = xyz(lat1, lon1), xyz(lat2, lon2)
    cosine = sum((p[k] / RADIUS_KM) * (q[k] / RADIUS_KM) for k in "xyz")
    outside = (F.abs(lat1) > 90) | (F.abs(lat2) > 90) | (F.abs(lon1) > 360) | (F.abs(lon2) > 360)
    there = F.when((lat1 == lat2) & (lon1 == lon2), F.lit(0.0)).otherwise(F.acos(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine))) * RADIUS_KM)
    return F.when(outside, F.raise_error(str(InvalidArg("latlon", "outside valid range"))).cast("double")).otherwise(there)


def linear_km(radius: float, mode: str = "squared_km") -> float:
    """A search radius in km. By default the number given is the square of the radius in km."""
    if mode not in RADIUS_MODES:
        raise InvalidArg("radius_mode", f"must be one of {', '.join(RADIUS_MODES)}")
    return math.sqrt(max(0.0, radius)) if mode == "squared_km" else radius / 1000 if mode == "m" else radius


def squared_km(radius: Column, mode: str = "squared_km") -> Column:
    """The square of a search radius, in km."""
    linear_km(0.0, mode)
    r = radius.cast("double")
    return r if mode == "squared_km" else r * r if mode == "km" else r * r / 1e6
