"""Regression error metrics as grouped aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: smallest denominator of the percentage error (double epsilon).
EPSILON = 2.220446049250313e-16


def _score_against(observed: Column, estimated: Column) -> Column:
    """1 - residual / total sum of squares; 1 or 0 for constant observations, null for fewer than two."""
    residual = F.sum(F.pow(estimated - observed, F.lit(2.0)))
    total = F.count(estimated - observed) * F.var_pop(observed)
    constant = F.when(residual == 0, 1.0).otherwise(0.0)
    score = F.when(total == 0, constant).otherwise(1.0 - F.try_divide(residual, total))
    return F.when(F.count(estimated - observed) >= 2, score)


def _variance_ratio(pred: Column, real: Column) -> Column:
    """``(sum (y - m)^2 - sum (p - m)^2) / sum (y - m)^2`` around the mean ``m`` of the observations."""
    n = F.count(pred - real)
    observed = n * F.var_pop(real)
    estimated = n * (F.var_pop(pred) + F.pow(F.avg(pred) - F.avg(real), F.lit(2.0)))
    return F.try_divide(observed - estimated, observed)


METRICS = {
    "rmse": lambda pred, real: F.sqrt(F.avg(F.pow(pred - real, F.lit(2.0)))),
    "mae": lambda pred, real: F.avg(F.abs(pred - real)),
    "mape": lambda pred, real: F.avg(F.abs(pred - real) / F.greatest(F.abs(real), F.lit(EPSILON))),
    "mbe": lambda pred, real: F.avg(pred - real),
    "mbe_reversed": lambda pred, real: F.avg(real - pred),
    "r2": lambda pred, real: _score_against(real, pred),
    "r2_swapped": lambda pred, real: _score_against(pred, real),
    "r2_variance_ratio": _variance_ratio,
}
STANDARD = ("rmse", "mae", "mape", "mbe", "r2")


def metric_columns(pred: str, real: str, names: Sequence[str] = STANDARD) -> list[Column]:
    both = F.col(pred).isNotNull() & F.col(real).isNotNull()
    p, y = F.when(both, F.col(pred)), F.when(both, F.col(real))
    return [METRICS[n](p, y).alias(n) for n in names]


def regression_metrics(
    predictions: DataFrame,
    by: Sequence[str],
    pred: str = "pred",
    real: str = "real",
    names: Sequence[str] = STANDARD,
    extra: Sequence[Column] = (),
) -> DataFrame:
    """One row of metrics per group; rows without prediction or truth do not count.

    Every metric is a sum, mean or variance, so groups of any size combine on the map side.
    """
    return predictions.groupBy(*by).agg(*metric_columns(pred, real, names), *extra)


def composition_metrics(
    compared: DataFrame, neighbours: DataFrame, key: str = "station_id", pred: str = "comp_pred", real: str = "real"
) -> DataFrame:
    """Metrics per site with the number of stations that took part and of compared hours."""
    scores = regression_metrics(
        compared, [key], pred, real, ("rmse", "mae", "mbe", "r2"), [F.count(F.lit(1)).alias("n_samples")]
    )
    used = neighbours.select(key, "neighbour_id").distinct().groupBy(key).agg(F.count(F.lit(1)).alias("n_stations"))
    return scores.join(used, key)


def summarise_methods(scores: DataFrame, by: str = "method", names: Sequence[str] = ("rmse", "mae", "mbe", "r2")) -> DataFrame:
    """Mean and sample standard deviation of each metric over the stations, per method."""
    columns = [f(n).alias(f"{n}_{suffix}") for n in names for f, suffix in ((F.avg, "mean"), (F.stddev_samp, "std"))]
    return scores.groupBy(by).agg(*columns)


def report_with_mean(scores: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    """All rows plus one footer row (null key) with the mean of every metric."""
    return scores.rollup(key).agg(*[F.avg(n).alias(n) for n in names])


def rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Round half to even."""
    return df.withColumns({c: F.bround(F.col(c), d) for c, d in digits.items()})
