"""Points and distances on the sphere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_METRES = 6372797.560856
UNITS = {"m": 1.0, "km": 1000.0, "ft": 0.3048, "mi": 1609.34}


def pair(col: Column) -> tuple[Column, Column]:
    """(lon, lat) of a 'lon,lat' text; null where it isn't one or is out of range."""
    parts = F.split(col, ",")
    lon, lat = F.trim(F.get(parts, 0)).try_cast("double"), F.trim(F.get(parts, 1)).try_cast("double")
    good = (F.size(parts) == 2) & lon.between(-180, 180) & lat.between(-85.05112878, 85.05112878)
    return F.when(good, lon), F.when(good, lat)


def distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Haversine distance in metres."""
    a, b = F.radians(lat1), F.radians(lat2)
    u, v = F.sin((b - a) / 2), F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    return F.lit(2.0 * EARTH_METRES) * F.asin(F.sqrt(u * u + F.cos(a) * F.cos(b) * v * v))


def within(col: Column, lon: float, lat: float, radius: float, unit: str) -> Column:
    x, y = pair(col)
    return F.coalesce(distance(F.lit(float(lon)), F.lit(float(lat)), x, y) <= radius * UNITS[unit.lower()], F.lit(False))
