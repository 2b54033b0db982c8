"""Rain and radiation climatology from raw readings, by stored levels of time.

Each level is summed once from the next finer one and stored; means are taken
of means, as published, so a coarser level can't be had from the readings in one
step.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunmesh import schemas
from sunmesh.operators import cleaning as cl
from sunmesh.operators.climate import box_statistics, drop_minimum
from sunmesh.sources.tables import materialise


@dataclass(frozen=True)
class Climatology:
    day: DataFrame
    """``station_id, year, month, day, rain, radiation``: daily totals."""
    month: DataFrame
    """``station_id, year, month, days, rain, radiation``: total rain, mean daily radiation."""
    station_month: DataFrame
    """``station_id, month, years, rain, radiation``: means over the years."""
    report: DataFrame
    """``month, stations, rain`` (mean over stations) and the box of the stations' radiation, null where no station is left."""


def climate_readings(readings: DataFrame, limits: Mapping[str, float] | None = None) -> DataFrame:
    """Daylight readings in which all limited columns are present and within their limits."""
    limits = schemas.CLIMATE_LOWER_LIMITS if limits is None else limits
    return cl.drop_incomplete(cl.mask_ranges(cl.daylight(readings), limits), list(limits))


def climatology(
    readings: DataFrame,
    rain: str = "precipitacao_total",
    radiation: str = "radiacao_global",
    limits: Mapping[str, float] | None = None,
    key: str = "station_id",
    time_col: str = "ts",
) -> Climatology:
    """All levels of the climatology; the readings are read once.

    The station with the least radiation of a month is left out of that month's
    box, as published, and so are all that tie with it.
    """
    parts = {"year": F.year(time_col), "month": F.month(time_col), "day": F.day(time_col)}
    narrow = climate_readings(readings, limits).select(
        F.col(key).alias("station_id"), *[p.alias(n) for n, p in parts.items()], F.col(rain).alias("rain"), F.col(radiation).alias("radiation")
    )
    totals = [F.sum(c).alias(c) for c in ("rain", "radiation")]
    means = [F.avg(c).alias(c) for c in ("rain", "radiation")]
    day = materialise(narrow.groupBy("station_id", *parts).agg(*totals), "days")
    per_month = day.groupBy("station_id", "year", "month").agg(F.count(F.lit(1)).alias("days"), totals[0], means[1])
    month = materialise(per_month, "months")
    station_month = materialise(month.groupBy("station_id", "month").agg(F.count(F.lit(1)).alias("years"), *means), "station-months")
    by_month = station_month.groupBy("month").agg(F.count(F.lit(1)).alias("stations"), means[0])
    boxes = box_statistics(drop_minimum(station_month, "radiation", ["month"]), "radiation", ["month"])
    return Climatology(day, month, station_month, by_month.join(boxes, "month", "left"))
