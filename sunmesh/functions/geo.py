"""Great-circle geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0088


def haversine_km(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Great-circle distance in kilometres between two points given in degrees."""
    half_lat = F.radians(lat_b - lat_a) / 2.0
    half_lon = F.radians(lon_b - lon_a) / 2.0
    chord = F.pow(F.sin(half_lat), F.lit(2.0)) + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * F.pow(
        F.sin(half_lon), F.lit(2.0)
    )
    return F.lit(2.0 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(chord, F.lit(1.0))))
