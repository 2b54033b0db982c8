"""Grouped scaling with parameter tables instead of fitted objects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunmesh.operators.quantiles import exact_quantiles, unpivot_values
from sunmesh.operators.sizing import small_side

METHODS = ("std", "mM", "rbst")


def fit_scaler(df: DataFrame, columns: Sequence[str], method: str = "rbst", by: Sequence[str] = ("station_id",)) -> DataFrame:
    """Parameter table ``(by.., feature, center, scale)``.

    ``std`` centres on the mean with the population deviation, ``mM`` maps the
    range to 0..1, ``rbst`` centres on the exact median with the quartile range.
    A scale of zero becomes one.
    """
    by = list(by)
    if method not in METHODS:
        raise KeyError(f"scaling method {method!r} is not one of {METHODS}")
    if method == "rbst":
        long = unpivot_values(df, by, columns)
        quartiles = exact_quantiles(long, [*by, "feature"], "value", [0.25, 0.5, 0.75])
        q = [F.get("quantiles", F.lit(i)) for i in range(3)]
        fitted = quartiles.select(*by, "feature", q[1].alias("center"), (q[2] - q[0]).alias("scale"))
    else:
        parts = [(F.avg, F.stddev_pop) if method == "std" else (F.min, lambda c: F.max(c) - F.min(c))] * len(columns)
        wide = df.groupBy(*by).agg(
            *[F.struct(c(F.col(n)).alias("center"), s(F.col(n)).alias("scale")).alias(n) for n, (c, s) in zip(columns, parts)]
        )
        pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("p")) for c in columns])
        fitted = wide.select(*by, F.explode(pairs).alias("e")).select(*by, "e.feature", "e.p.center", "e.p.scale")
        fitted = fitted.where(F.col("center").isNotNull())
    return fitted.withColumn("scale", F.when(F.col("scale") == 0, 1.0).otherwise(F.col("scale")))


def _wide(params: DataFrame, columns: Sequence[str], by: list[str]) -> DataFrame:
    pair = F.struct("center", "scale")
    return params.groupBy(*by).agg(*[F.max(F.when(F.col("feature") == c, pair)).alias(f"__{c}") for c in columns])


def _with_params(df: DataFrame, params: DataFrame, columns: Sequence[str], by: list[str]) -> DataFrame:
    if by:
        return df.join(small_side(_wide(params, columns, by)), by, "left")
    # A single set has one row per named column: its numbers go into the expressions themselves.
    fitted = {r.feature: r for r in params.where(F.col("feature").isin(*columns)).collect()}
    pair = lambda r: F.struct(F.lit(r.center).alias("center"), F.lit(r.scale).alias("scale"))
    missing = F.struct(F.lit(None).cast("double").alias("center"), F.lit(None).cast("double").alias("scale"))
    return df.withColumns({f"__{c}": pair(fitted[c]) if c in fitted else missing for c in columns})


def apply_scaler(df: DataFrame, params: DataFrame, columns: Sequence[str], by: Sequence[str] = ("station_id",)) -> DataFrame:
    """``(x - center) / scale`` for each named column; an empty ``by`` uses one parameter set for all rows."""
    joined = _with_params(df, params, columns, list(by))
    return joined.withColumns({c: (F.col(c) - F.col(f"__{c}.center")) / F.col(f"__{c}.scale") for c in columns}).select(*df.columns)


def invert_scaler(
    df: DataFrame, params: DataFrame, columns: dict[str, str], by: Sequence[str] = ("station_id",)
) -> DataFrame:
    """Undo the scaling; ``columns`` maps each scaled column to the feature whose parameters it used."""
    features = sorted(set(columns.values()))
    joined = _with_params(df, params, features, list(by))
    return joined.withColumns(
        {c: F.col(c) * F.col(f"__{f}.scale") + F.col(f"__{f}.center") for c, f in columns.items()}
    ).select(*df.columns)
