"""Selection of winners among model results.

Winners come from the minimum of a struct, which combines on the map side, so a
station with very many results is no bottleneck.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Secondary order for each selection criterion.
CRITERIA = {
    "rmse": ["rmse", "mae", "mbe", "r2"],
    "mae": ["mae", "rmse", "mbe", "r2"],
    "mbe": ["mbe", "rmse", "mae", "r2"],
}


def _nulls_last(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(float("nan")))


def _order(criterion: str, corrected: bool) -> list[Column]:
    if criterion not in CRITERIA:
        raise ValueError(f"criterion {criterion!r} is not one of {sorted(CRITERIA)}")
    if not corrected:
        return [_nulls_last(n) for n in CRITERIA[criterion]]
    better = {"mbe": lambda c: F.abs(c), "r2": lambda c: -c}
    return [better.get(n, lambda c: c)(_nulls_last(n)) for n in CRITERIA[criterion]]


def first_by(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group in the given ascending order; the rest of the row breaks ties."""
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    others = [c for c in df.columns if c not in by]
    tie_break = F.struct(*[F.col(c) for c in others])
    best = df.groupBy(*by).agg(F.min(F.struct(rank.alias("rank"), tie_break.alias("row"))).alias("__best"))
    return best.select(*by, *[F.col(f"__best.row.{c}").alias(c) for c in others]).select(*df.columns)


def best_by_algorithm(
    results: DataFrame, by: Sequence[str] = ("station_id", "model"), criterion: str = "rmse", corrected: bool = False
) -> DataFrame:
    """Best run per station and algorithm.

    The default order takes bias and score ascending; ``corrected`` prefers a small
    absolute bias and a high score. The timestamp breaks remaining ties.
    """
    return first_by(results, list(by), [*_order(criterion, corrected), F.col("timestamp")])


def best_by_station(
    results: DataFrame, by: Sequence[str] = ("station_id",), criterion: str = "rmse", corrected: bool = False
) -> DataFrame:
    """Best model per station by ``rmse``, ``mae`` or ``mbe``."""
    return first_by(results, list(by), [*_order(criterion, corrected), F.col("timestamp"), F.col("model")])


def _better(both: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """Of the structs ``i`` and ``o`` the original one, unless the imputed one is strictly better or the only one."""
    take_imputed = F.col("o").isNull() | F.coalesce(F.col("i.rmse") < F.col("o.rmse"), F.lit(False))
    chosen = both.withColumn("is_interp", take_imputed).withColumn(
        "chosen", F.when(F.col("is_interp"), F.col("i")).otherwise(F.col("o"))
    )
    return chosen.select(key, *[F.col(f"chosen.{c}").alias(c) for c in columns], "is_interp")


def blend(imputed: DataFrame, original: DataFrame, columns: Sequence[str], key: str = "station_id") -> DataFrame:
    """Better of two winners per station; the imputed one must be strictly better or the only one."""
    pick = lambda df, name: df.select(key, F.struct(*columns).alias(name))
    return _better(pick(imputed, "i").join(pick(original, "o"), key, "full"), columns, key)


def blend_runs(
    results: DataFrame,
    columns: Sequence[str],
    key: str = "station_id",
    criterion: str = "rmse",
    corrected: bool = False,
    datasets: tuple[str, str] = ("imputed", "original"),
) -> DataFrame:
    """``blend`` of the best runs of two data sets, from all runs in one grouping.

    ``columns`` must have ``rmse``; other data sets are ignored, and stations without a run of these two are left out.
    """
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate([*_order(criterion, corrected), F.col("timestamp"), F.col("model")])])
    run = F.struct(rank.alias("rank"), F.struct(*columns).alias("row"))
    winners = [F.min(F.when(F.col("dataset") == name, run)).alias(side) for side, name in zip("io", datasets)]
    best = results.where(F.col("dataset").isin(*datasets)).groupBy(key).agg(*winners)
    return _better(best.select(key, *[F.col(f"{side}.row").alias(side) for side in "io"]), columns, key)


def with_ends(df: DataFrame, order: Sequence[Column], reverse: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows (``best``) and the last ``n`` rows (``worst``) of an order, as two top-n scans."""
    head = df.orderBy(*order).limit(n).withColumn("side", F.lit("best"))
    tail = df.orderBy(*reverse).limit(n).withColumn("side", F.lit("worst"))
    return head.unionByName(tail)


def next_station(stations: DataFrame, registry: DataFrame, wanted: Mapping[str, Sequence[str]], key: str = "station_id") -> DataFrame:
    """First station in id order without a model, for each combination of ``wanted`` values; null if all have one.

    ``wanted`` lists, for instance, the ``dataset`` and ``algorithm`` values to be trained.
    """
    planned, by = stations.select(key).distinct(), list(wanted)
    for name, values in wanted.items():
        planned = planned.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    trained = registry.select(*by, key).distinct().withColumn("__trained", F.lit(True))
    open_ = F.when(F.col("__trained").isNull(), F.col(key))
    return planned.join(trained, [*by, key], "left").groupBy(*by).agg(F.min(open_).alias(key))


def other_stations(stations: DataFrame, exclude: Sequence, key: str = "station_id") -> DataFrame:
    """All stations but the excluded ones."""
    return stations.where(~F.col(key).isin(list(exclude)))


def planned_stations(stations: DataFrame, warm_start=None, only=None, key: str = "station_id") -> DataFrame:
    """Stations to train: all, those from ``warm_start`` on, or ``only`` one."""
    if only is not None:
        return stations.where(F.col(key) == only)
    return stations if warm_start is None else stations.where(F.col(key) >= warm_start)
