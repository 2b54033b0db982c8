"""Evaluation of the empirical radiation formula at every site."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sunmesh.functions.radiation import hourly_radiation
from sunmesh.operators.cleaning import daylight
from sunmesh.operators.metrics import regression_metrics
from sunmesh.operators.sizing import small_side

# Rows of a complete day, clock shift in hours and reference meridian of the two published variants.
ROWS_PER_DAY = 11
VARIANTS = {
    "python": {"hour_offset": -6, "correction": 0.15},
    "julia": {"hour_offset": -3, "correction": 0.2},
}
MERIDIAN = -3.0


def daily_totals(df: DataFrame, value: str, rows_per_day: int = ROWS_PER_DAY, key: str = "station_id") -> DataFrame:
    """Sum per station and day, for days with exactly ``rows_per_day`` rows."""
    by_day = df.groupBy(key, F.to_date("ts").alias("day")).agg(F.sum(value).alias("daily_total"), F.count(F.lit(1)).alias("__n"))
    return by_day.where(F.col("__n") == rows_per_day).drop("__n")


def with_daily_totals(df: DataFrame, totals: DataFrame, key: str = "station_id") -> DataFrame:
    """Hourly rows of complete days, each with its daily total."""
    return df.withColumn("day", F.to_date("ts")).join(totals, [key, "day"])


def with_site(df: DataFrame, sites: DataFrame, key: str = "station_id") -> DataFrame:
    """Attach latitude and longitude; rows of unknown stations are left out."""
    return df.join(small_side(sites.select(key, "lat", "lon")), key)


def empirical_predictions(
    df: DataFrame,
    sites: DataFrame,
    value: str,
    rows_per_day: int = ROWS_PER_DAY,
    variant: str = "python",
    meridian: float = MERIDIAN,
    clip: bool = False,
) -> DataFrame:
    """``station_id, ts, emp_pred, real`` for every daylight hour of a complete day."""
    settings = VARIANTS[variant]
    # A day has few rows, so a window gives each hour its total with a single shuffle.
    day = Window.partitionBy("station_id", F.to_date("ts"))
    totals = {"daily_total": F.sum(value).over(day), "__n": F.count(F.lit(1)).over(day)}
    complete = df.dropna("any", subset=[value]).withColumns(totals).where(F.col("__n") == rows_per_day)
    hours = with_site(complete, sites)
    predicted = hourly_radiation(
        F.col("lat"),
        F.col("lon"),
        F.hour("ts") + settings["hour_offset"],
        F.lit(meridian),
        F.dayofyear("ts"),
        F.col("daily_total"),
        settings["correction"],
        clip,
    )
    return hours.select("station_id", "ts", predicted.alias("emp_pred"), F.col(value).alias("real"))


def empirical_scores(df: DataFrame, sites: DataFrame, value: str, rows_per_day: int = ROWS_PER_DAY, variant: str = "python") -> DataFrame:
    """Error metrics of the formula per site, with the definitions of the chosen variant."""
    predictions = empirical_predictions(daylight(df), sites, value, rows_per_day, variant)
    names = ("rmse", "mae", "mbe", "r2_swapped") if variant == "python" else ("rmse", "mae", "mbe_reversed", "r2_variance_ratio")
    scores = regression_metrics(predictions, ["station_id"], "emp_pred", "real", names)
    return scores.withColumnsRenamed({names[2]: "mbe", names[3]: "r2"})
