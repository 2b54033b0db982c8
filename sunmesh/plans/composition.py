"""Generalisation of station forecasts to any site."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunmesh import schemas
from sunmesh.operators.idw import weighted_mean
from sunmesh.operators.ordered import every_nth_split
from sunmesh.operators.scaling import apply_scaler, fit_scaler
from sunmesh.operators.sizing import small_side
from sunmesh.operators.slots import SLOTS, neighbour_slots, slot_columns
from sunmesh.sources.tables import materialise


def estimator_errors(best: DataFrame, key: str = "station_id") -> DataFrame:
    """Error of each station's winning model: mean of its present ``rmse`` and ``mae``."""
    both = F.filter(F.array("rmse", "mae"), lambda v: v.isNotNull())
    total = F.aggregate(both, F.lit(0.0), lambda acc, v: acc + v)
    return best.select(key, F.try_divide(total, F.size(both)).alias("error"))


def neighbour_predictions(predictions: DataFrame, pairs: DataFrame) -> DataFrame:
    """Long table of each site's neighbour forecasts: ``station_id, neighbour_id, ts, dist, error, pred``.

    Forecasts are dealt out by time before they are fanned out to the sites, so
    grouping by ``(station_id, ts)`` needs no shuffle of the copies.
    """
    source = predictions.select(F.col("station_id").alias("neighbour_id"), "ts", "pred").repartition("ts")
    return source.join(small_side(pairs), "neighbour_id").select(
        "station_id", "neighbour_id", "ts", "dist", "error", "pred"
    )


def compose(
    predictions: DataFrame,
    pairs: DataFrame,
    truth: DataFrame,
    min_stations: int = schemas.MIN_STATIONS,
    power: float = 2.0,
    extra: Sequence[Column] = (),
) -> DataFrame:
    """Forecast of every site from its neighbours' forecasts, next to the observed value.

    ``pairs`` carries the neighbour's distance and error. Hours with fewer than
    ``min_stations`` forecasts are left out. The aggregation combines neighbours
    before the shuffle; one plan covers all sites.
    """
    mean = weighted_mean(F.col("pred"), F.col("dist"), F.col("error"), power)
    composed = (
        neighbour_predictions(predictions, pairs)
        .groupBy("station_id", "ts")
        .agg(mean.alias("comp_pred"), F.count("pred").alias("n_points"), *extra)
        .where(F.col("n_points") >= min_stations)
    )
    return composed.join(truth.select("station_id", "ts", "real"), ["station_id", "ts"])


def second_level_rows(
    predictions: DataFrame,
    pairs: DataFrame,
    truth: DataFrame,
    sites: DataFrame,
    min_stations: int = schemas.MIN_STATIONS,
    slots: int = SLOTS,
    slot_order: str = "neighbour_id",
) -> DataFrame:
    """``station_id, ts, target, doy, hour, lat, lon`` and the neighbour slots of every composed hour."""
    columns = slot_columns(slots)
    near = neighbour_predictions(predictions, pairs)
    slotted = neighbour_slots(near, slots, slot_order).where(F.col("n_points") >= min_stations)
    located = slotted.join(small_side(sites.select("station_id", "lat", "lon")), "station_id")
    observed = truth.select("station_id", "ts", F.col("real").alias("target"))
    return located.join(observed, ["station_id", "ts"]).select(
        "station_id", "ts", "target", F.dayofyear("ts").alias("doy"), F.hour("ts").alias("hour"), "lat", "lon", *columns
    )


def second_level_set(rows: DataFrame, slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """Every fifth row of a site is for test; all inputs and the target are range-scaled over all rows.

    Returns the scaled rows and the parameter table needed to undo the scaling.
    """
    columns = ["target", "doy", "hour", "lat", "lon", *slot_columns(slots)]
    typed = materialise(rows.withColumns({c: F.col(c).cast("double") for c in ("doy", "hour")}), "second-level")
    params = fit_scaler(typed, columns, "mM", by=())
    split = every_nth_split(typed, ["station_id"], ["ts"], 5)
    return apply_scaler(split, params, columns, by=()), params
