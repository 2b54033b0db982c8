"""Inverse distance weighting: interpolation and gap imputation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunmesh import schemas
from sunmesh.operators.components import connected_components
from sunmesh.operators.sizing import small_side
from sunmesh.sources.tables import materialise

#: Rows of a component and slice of time that are filled together, and values held at once while doing so.
GROUP_ROWS, BLOCK_VALUES = 65_536, 1 << 22


def weighted_mean(value: Column, dist: Column, error: Column | None = None, power: float = 2.0) -> Column:
    """Aggregate: mean of ``value`` weighted by ``1 / dist**power`` and, if given, by ``1 / error``.

    Null values do not count. If some value lies at distance zero, the co-located values alone decide.
    """
    here = F.when(dist == 0, value)
    weight = F.when(value.isNotNull() & (dist > 0), F.pow(dist, F.lit(-float(power))))
    if error is not None:
        weight = weight / error
    return F.coalesce(F.avg(here), F.try_divide(F.sum(weight * value), F.sum(weight)))


def interpolate(
    points: DataFrame,
    by: Sequence[str],
    value: str = "value",
    dist: str = "dist",
    error: str | None = None,
    power: float = 2.0,
    min_points: int = 1,
    name: str = "interpolated",
) -> DataFrame:
    """One interpolated value per ``by`` group with at least ``min_points`` present values."""
    mean = weighted_mean(F.col(value), F.col(dist), F.col(error) if error else None, power)
    return (
        points.groupBy(*by)
        .agg(mean.alias(name), F.count(value).alias("n_points"))
        .where(F.col("n_points") >= min_points)
    )


def neighbour_values(requests: DataFrame, pairs: DataFrame, readings: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Readings of all neighbours at the very time of each request ``(station_id, ts)``; absent ones are skipped."""
    seen = readings.select(F.col("station_id").alias("neighbour_id"), "ts", *columns)
    return requests.join(small_side(pairs), "station_id").join(seen, ["neighbour_id", "ts"])


def impute_single_pass(
    readings: DataFrame,
    pairs: DataFrame,
    features: Sequence[str],
    min_stations: int = schemas.MIN_STATIONS,
    power: float = 2.0,
) -> DataFrame:
    """Fill null features from at least ``min_stations`` neighbours with a value at the same time.

    Only measured values are used as sources. All features share one join and one
    aggregation; only rows with a gap ask their neighbours.
    """
    features = list(features)
    gap = F.lit(False)
    for name in features:
        gap = gap | F.col(name).isNull()
    near = neighbour_values(readings.where(gap).select("station_id", "ts"), pairs, readings, features)
    offers = near.groupBy("station_id", "ts").agg(
        *[weighted_mean(F.col(c), F.col("dist"), power=power).alias(f"__v_{c}") for c in features],
        *[F.count(c).alias(f"__n_{c}") for c in features],
    )
    filled = {c: F.coalesce(F.col(c), F.when(F.col(f"__n_{c}") >= min_stations, F.col(f"__v_{c}"))) for c in features}
    return readings.join(offers, ["station_id", "ts"], "left").withColumns(filled).select(*readings.columns)


def _fill_cascade(features: list[str], min_stations: int, power: float):
    """Fill a component's rows station by station, all times of a slice at once."""

    def fill(rows: pd.DataFrame, lists: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop(columns=["__component", "__slice"])
        stations, column = np.unique(rows["station_id"].to_numpy(), return_inverse=True)
        times, row = np.unique(rows["ts"].to_numpy(), return_inverse=True)
        near = lists[lists["station_id"].isin(stations) & lists["neighbour_id"].isin(stations)]
        asked, offering = (np.searchsorted(stations, near[c].to_numpy()) for c in ("station_id", "neighbour_id"))
        dist = near["dist"].to_numpy(dtype=float)
        measured = rows[features].to_numpy(dtype=float)
        block = max(1, BLOCK_VALUES // (len(stations) * len(features)))
        for begin in range(0, len(times), block):
            own = np.flatnonzero((row >= begin) & (row < begin + block))
            values = np.full((min(block, len(times) - begin), len(stations), len(features)), np.nan)
            present = np.zeros(values.shape[:2], dtype=bool)
            values[row[own] - begin, column[own]] = measured[own]
            present[row[own] - begin, column[own]] = True
            for station in range(len(stations)):
                gaps = np.flatnonzero(present[:, station] & np.isnan(values[:, station]).any(axis=1))
                mine = asked == station
                if len(gaps) and mine.sum() >= min_stations:
                    values[gaps, station] = _fill_station(values[gaps, station], values[np.ix_(gaps, offering[mine])], dist[mine], min_stations, power)
            measured[own] = values[row[own] - begin, column[own]]
        rows[features] = measured
        return rows

    return fill


def _fill_station(own: np.ndarray, offered: np.ndarray, dist: np.ndarray, min_stations: int, power: float) -> np.ndarray:
    """``own`` (times x features) with gaps filled from ``offered`` (times x neighbours x features)."""
    known = ~np.isnan(offered)
    here = known & (dist == 0)[None, :, None]
    weights = np.where(here.any(axis=1, keepdims=True), here, known * (np.where(dist > 0, dist, 1.0) ** -power)[None, :, None])
    total = weights.sum(axis=1)
    mean = (weights * np.nan_to_num(offered)).sum(axis=1) / np.where(total > 0, total, 1.0)
    return np.where(np.isnan(own) & (known.sum(axis=1) >= min_stations), mean, own)


def impute_cascade(
    readings: DataFrame,
    stations: DataFrame,
    pairs: DataFrame,
    features: Sequence[str],
    min_stations: int = schemas.MIN_STATIONS,
    power: float = 2.0,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Like the single pass, but in station order: later stations also use values filled before.

    Values flow along pairs only, so components of the station graph are
    independent, and so are times. A group is one component in a slice of time
    of about ``group_rows`` rows; a component of more stations is one group per
    hour. Groups without a gap, stations without neighbours and rows without a
    time stay out of Python. Pairs with an end that is not in ``stations`` are
    ignored. ``(station_id, ts)`` must be unique.
    """
    features = list(features)
    listed = small_side(stations.select("station_id").distinct())
    known = pairs.join(listed, "station_id", "left_semi")
    known = materialise(known.join(listed.withColumnRenamed("station_id", "neighbour_id"), "neighbour_id", "left_semi"), "cascade-pairs")
    found = connected_components(known)
    hours = found.groupBy("component").agg(F.greatest(F.lit(1), F.floor(group_rows / F.count(F.lit(1)))).alias("__hours"))
    placed = small_side(found.join(hours, "component").withColumnRenamed("component", "__component"))
    gap = F.lit(False)
    for name in features:
        gap = gap | F.col(name).isNull()
    slice_ = F.floor(F.unix_timestamp("ts") / (F.col("__hours") * 3600))
    timed = materialise(readings.join(placed, "station_id", "left").withColumn("__slice", slice_).drop("__hours"), "cascade-readings")
    keys = ["__component", "__slice"]
    asking = small_side(timed.where(gap & F.col("__component").isNotNull() & F.col("__slice").isNotNull()).select(*keys).distinct())
    lists = known.select("station_id", "neighbour_id", "dist").join(placed.drop("__hours"), "station_id").join(asking, "__component")
    concerned = timed.join(asking, keys).select(*readings.columns, *keys)
    filled = concerned.groupBy(*keys).cogroup(lists.groupBy(*keys)).applyInPandas(_fill_cascade(features, min_stations, power), schema=readings.schema)
    return filled.unionByName(timed.join(asking, keys, "left_anti").select(*readings.columns))
