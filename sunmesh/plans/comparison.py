"""Tables that put several methods side by side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compare_methods(
    scores: DataFrame, methods: Sequence[str], names: Sequence[str] = ("rmse", "mae", "mbe", "r2"), key: str = "station_id"
) -> DataFrame:
    """One row per station scored by every method, with ``<metric>_<method>`` columns.

    ``scores`` is long: one row per station and ``method``. One aggregation stands
    for the chain of inner joins.
    """
    chosen = scores.where(F.col("method").isin(*methods))
    values = [
        F.max(F.when(F.col("method") == m, F.col(n))).alias(f"{n}_{m}") for n in names for m in methods
    ]
    seen = [F.max((F.col("method") == m).cast("int")) for m in methods]
    return chosen.groupBy(key).agg(sum(seen[1:], seen[0]).alias("__methods"), *values).where(
        F.col("__methods") == len(methods)
    ).drop("__methods")


def metric_differences(table: DataFrame, first: str, second: str, names: Sequence[str], key: str = "station_id") -> DataFrame:
    """``diff_<metric>`` = metric of the first method minus that of the second."""
    return table.select(key, *[(F.col(f"{n}_{first}") - F.col(f"{n}_{second}")).alias(f"diff_{n}") for n in names])


def join_complete(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows complete on both sides; the explicit null filters keep it an inner join."""
    return left.dropna("any").join(right.dropna("any"), key)


def samples_by_station(df: DataFrame, key: str = "station_id") -> DataFrame:
    return df.groupBy(key).agg(
        F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "test").alias("test")
    )


def sample_totals(samples: DataFrame) -> DataFrame:
    return samples.agg(
        *[
            f(n).alias(f"{n}_{label}")
            for n in ("train", "test")
            for f, label in ((F.sum, "total"), (F.avg, "mean"), (F.min, "min"), (F.max, "max"))
        ]
    )
