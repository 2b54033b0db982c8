"""Fixed neighbour slots for the second-level model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLOTS = 4


def rank_neighbours(pairs: DataFrame, by: str = "error", key: str = "station_id") -> DataFrame:
    """Number the neighbours of each site by estimator error (or distance)."""
    order = Window.partitionBy(key).orderBy(by, "neighbour_id")
    return pairs.withColumn("neighbour_rank", F.row_number().over(order))


def slot_columns(n: int = SLOTS) -> list[str]:
    return [f"stat{i}_{part}" for i in range(1, n + 1) for part in ("dist", "error", "pred")]


def neighbour_slots(
    near: DataFrame,
    n: int = SLOTS,
    slot_order: str = "neighbour_id",
    zero_is_missing: bool = True,
    pad: float | None = 0.0,
    by: Sequence[str] = ("station_id", "ts"),
) -> DataFrame:
    """First ``n`` valid neighbour predictions of each site and time, spread over columns and padded.

    ``near`` is long: one row per site, time and neighbour with ``dist, error, pred``.
    ``n_points`` counts the predictions present. Sites without any valid one at a
    time keep their row. A group holds one site's neighbours at one time, so it is
    bounded by the number of stations in range.
    """
    valid = F.col("pred").isNotNull()
    if zero_is_missing:
        valid = valid & (F.col("pred") != 0)
    order = Window.partitionBy(*by).orderBy((~valid).cast("int"), slot_order, "neighbour_id")
    slotted = near.withColumn("__valid", valid).withColumn("__slot", F.row_number().over(order))
    columns = []
    for i in range(1, n + 1):
        for part in ("dist", "error", "pred"):
            value = F.max(F.when(F.col("__valid") & (F.col("__slot") == i), F.col(part)))
            columns.append((value if pad is None else F.coalesce(value, F.lit(pad))).alias(f"stat{i}_{part}"))
    return slotted.groupBy(*by).agg(F.count("pred").alias("n_points"), *columns)


def first_valid(values, n: int = SLOTS, pad: float = 0.0):
    """First ``n`` present, nonzero entries of an array column, padded to length ``n``."""
    valid = F.filter(values, lambda v: v.isNotNull() & (v != 0))
    return F.slice(F.concat(valid, F.array_repeat(F.lit(float(pad)), n)), 1, n)
