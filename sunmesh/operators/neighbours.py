"""Pairs of stations within a distance, as an equi-join on grid cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunmesh.functions.geo import EARTH_RADIUS_KM, haversine_km


def _cells_around(band: Column, band_height: float, max_km: float) -> Column:
    """Number of longitude cells of a latitude band, wide enough for ``max_km`` from any adjacent band."""
    highest = F.greatest(F.abs(band - 1), F.abs(band + 2)) * band_height
    shrink = F.cos(F.radians(F.least(highest, F.lit(90.0))))
    reach = F.lit(math.sin(min(max_km / (2 * EARTH_RADIUS_KM), math.pi / 2)))
    width = F.when(shrink > reach, F.degrees(F.asin(reach / F.greatest(shrink, F.lit(1e-12)))) * 2.0).otherwise(360.0)
    return F.greatest(F.floor(F.lit(360.0) / (width * 1.000001)), F.lit(1)).cast("long")


def _lon_cell(lon: Column, cells: Column) -> Column:
    turn = F.pmod(lon + 180.0, F.lit(360.0)) / 360.0
    return F.least(F.floor(turn * cells), cells - 1)


def station_pairs(
    sites: DataFrame,
    max_km: float,
    neighbours: DataFrame | None = None,
    exclude_zero: bool = False,
    key: str = "station_id",
    lat: str = "lat",
    lon: str = "lon",
) -> DataFrame:
    """``(station_id, neighbour_id, dist)`` for all neighbours of each site at most ``max_km`` away.

    A site is not its own neighbour; ``exclude_zero`` leaves out co-located stations too.
    Each neighbour lives in one grid cell, each site asks the nine cells around it, so the join is an
    equi-join whose partners are already close; the exact distance is checked last.
    """
    neighbours = sites if neighbours is None else neighbours
    height = math.degrees(max_km / EARTH_RADIUS_KM) * 1.000001
    band = lambda column: F.floor(F.col(column) / height)

    right = neighbours.select(
        F.col(key).alias("neighbour_id"), F.col(lat).alias("__lat_b"), F.col(lon).alias("__lon_b")
    ).withColumn("__band", band("__lat_b"))
    right = right.withColumn("__cell", _lon_cell(F.col("__lon_b"), _cells_around(F.col("__band"), height, max_km)))

    left = sites.select(key, F.col(lat).alias("__lat_a"), F.col(lon).alias("__lon_a"))
    asked_bands = F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda step: band("__lat_a") + step)
    left = left.withColumn("__band", F.explode(asked_bands))
    cells = _cells_around(F.col("__band"), height, max_km)
    around = F.transform(
        F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda step: F.pmod(_lon_cell(F.col("__lon_a"), cells) + step, cells)
    )
    left = left.withColumn("__cell", F.explode(F.array_distinct(around)))

    dist = haversine_km(F.col("__lat_a"), F.col("__lon_a"), F.col("__lat_b"), F.col("__lon_b"))
    near = F.col("dist") <= max_km
    if exclude_zero:
        near = near & (F.col("dist") > 0)
    return (
        left.join(right, ["__band", "__cell"])
        .where(F.col(key) != F.col("neighbour_id"))
        .withColumn("dist", dist)
        .where(near)
        .select(key, "neighbour_id", "dist")
    )


def pair_errors(pairs: DataFrame, errors: DataFrame, key: str = "station_id", error: str = "error") -> DataFrame:
    """Attach the estimator error of each neighbour; neighbours without one are left out."""
    known = errors.select(F.col(key).alias("neighbour_id"), F.col(error).alias("error"))
    return pairs.join(known, "neighbour_id").select(key, "neighbour_id", "dist", "error")
