"""Exact grouped quantiles for groups of any size, and the outlier rule built on them.

``percentile`` keeps every distinct value of a group in one task's memory. Here
a mergeable sketch only proposes a narrow value bracket around each wanted rank;
exact counts then say which bracket holds the rank, and only its rows are
ordered. A bracket with too many rows to be ordered in one task is cut again in
the same way. A bad proposal costs time, never exactness.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sunmesh.operators.sizing import small_side
from sunmesh.sources.tables import materialise

SKETCH_ACCURACY = 5_000
#: A bracket of more rows, not all of one value, is cut again before its rows are ordered.
ORDERED_ROWS = 1_000_000
#: Edges that such a bracket is cut by, at equal shares of its rows.
RECUT_EDGES = 255


def _rank_probes(probabilities: Sequence[float], accuracy: int) -> list[float]:
    margin = 2.0 / accuracy
    return sorted({min(max(p + side * margin, 0.0), 1.0) for p in probabilities for side in (-1, 1)})


def _number(conditions: Sequence[Column]) -> Column:
    """How many of the conditions hold."""
    ones = [F.when(c, 1).otherwise(0) for c in conditions]
    return sum(ones[1:], ones[0])


def _bracket_sizes(binned: DataFrame, part: list[str]) -> DataFrame:
    """Rows per bracket, with the number of the part's rows up to its end and in all; ``__mixed`` if values differ."""
    per_part = Window.partitionBy(*part)
    return (
        binned.groupBy(*part, "__bin")
        .agg(F.count(F.lit(1)).alias("__n"), (F.min("__v") < F.max("__v")).alias("__mixed"))
        .withColumn("__total", F.sum("__n").over(per_part))
        .withColumn("__upto", F.sum("__n").over(per_part.orderBy("__bin")))
    )


def _in_bracket(rank: Column) -> Column:
    return (rank < F.col("__upto")) & (rank >= F.col("__upto") - F.col("__n"))


def _wanted_brackets(ranks: DataFrame, keys: list[str]) -> DataFrame:
    """One row per bracket that holds a wanted rank; at most two ranks per asked quantile, so the lists are short."""
    wanted = F.collect_set(F.struct("__local", "__slot", "__fraction")).alias("__wanted")
    size = [F.max(c).alias(c) for c in ("__n", "__mixed")]
    return small_side(ranks.groupBy(*keys, "__bin").agg(wanted, *size))


def _ordered_values(binned: DataFrame, hits: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, __v, __w)``: the value at each wanted rank of the brackets in ``hits``.

    Equal values are counted before the shuffle, so a constant column stays one row.
    """
    per_bin = Window.partitionBy(*keys, "__bin").orderBy("__v")
    inside = (
        binned.join(hits.select(*keys, "__bin"), [*keys, "__bin"], "left_semi")
        .groupBy(*keys, "__bin", "__v")
        .agg(F.count(F.lit(1)).alias("__m"))
        .withColumn("__reached", F.sum("__m").over(per_bin))
    )
    reached = lambda w: (w["__local"] < F.col("__reached")) & (w["__local"] >= F.col("__reached") - F.col("__m"))
    return inside.join(hits, [*keys, "__bin"]).select(*keys, "__v", F.explode(F.filter("__wanted", reached)).alias("__w"))


def _cut_again(binned: DataFrame, large: DataFrame, keys: list[str], accuracy: int) -> tuple[DataFrame, DataFrame]:
    """Rows of the ``large`` brackets in smaller ones, and those of these that hold the wanted ranks.

    Their rows, a small part of the input, are stored once. Values equal to an
    edge have a bracket of their own and an edge is a value of the bracket, so
    each bracket left to cut is smaller than the one before.
    """
    part = [*keys, "__part"]
    inside = binned.join(large.select(*keys, "__bin"), [*keys, "__bin"], "left_semi")
    stored = materialise(inside.withColumnRenamed("__bin", "__part"), "brackets")
    shares = F.array(*[F.lit((i + 1) / (RECUT_EDGES + 1)) for i in range(RECUT_EDGES)])
    edges = small_side(stored.groupBy(*part).agg(F.array_distinct(F.percentile_approx("__v", shares, accuracy)).alias("__edges")))
    below = F.size(F.filter("__edges", lambda e: e < F.col("__v"))) + F.size(F.filter("__edges", lambda e: e <= F.col("__v")))
    cut = stored.join(edges, part).select(*part, "__v", below.alias("__bin"))
    name = F.concat_ws(".", "__part", F.col("__bin").cast("string")).alias("__bin")

    targets = large.select(*keys, F.col("__bin").alias("__part"), F.explode("__wanted").alias("__w"))
    rank = F.col("__w.__local")
    ranks = (
        _bracket_sizes(cut, part)
        .join(small_side(targets), part)
        .where(_in_bracket(rank))
        .select(
            *keys, name, "__n", "__mixed", "__w.__slot", "__w.__fraction", (rank - F.col("__upto") + F.col("__n")).alias("__local")
        )
    )
    return cut.select(*keys, "__v", name), _wanted_brackets(ranks, keys)


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: Sequence[float],
    name: str = "quantiles",
    accuracy: int = SKETCH_ACCURACY,
    ordered_rows: int = ORDERED_ROWS,
) -> DataFrame:
    """One row per key with ``name``: array of linearly interpolated quantiles, in the order asked for.

    Nulls are ignored; keys without a value are left out. Key columns must not be null.
    Without keys the whole table is one group. No task orders more than
    ``ordered_rows`` rows that are not all equal.
    The input is read three times (sketch, counts, brackets), each time without
    shuffling its values, so pass a stored table if it is costly to derive.
    """
    keys = list(keys)
    values = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"))
    probes = _rank_probes(probabilities, accuracy)
    sketch = F.percentile_approx("__v", F.array(*[F.lit(p) for p in probes]), accuracy).alias("__edges")
    if keys:
        edged = values.join(small_side(values.groupBy(*keys).agg(sketch)), keys)
    else:
        # One short row: as literals it needs no join.
        edged = values.withColumn("__edges", F.lit(values.agg(sketch).first()[0] or []).cast("array<double>"))

    # Bracket number = how many edges lie below the value; it rises with the value.
    below = _number([F.col("__v") > F.get("__edges", F.lit(i)) for i in range(len(probes))])
    binned = edged.select(*keys, "__v", below.alias("__bin"))

    # For each wanted quantile the two neighbouring 0-based ranks.
    wanted = F.array(
        *[F.struct(F.lit(i).alias("slot"), F.lit(float(p)).alias("p")) for i, p in enumerate(probabilities)]
    )
    ranks = (
        _bracket_sizes(binned, keys)
        .withColumn("__w", F.explode(wanted))
        .withColumn("__position", F.col("__w.p") * (F.col("__total") - 1))
        .withColumn("__rank", F.explode(F.array(F.floor("__position"), F.ceil("__position"))))
        .where(_in_bracket(F.col("__rank")))
        .select(
            *keys,
            F.col("__bin").cast("string").alias("__bin"),
            "__n",
            "__mixed",
            F.col("__w.slot").alias("__slot"),
            (F.col("__position") - F.floor("__position")).alias("__fraction"),
            (F.col("__rank") - F.col("__upto") + F.col("__n")).alias("__local"),
        )
    )
    binned = binned.withColumn("__bin", F.col("__bin").cast("string"))
    hits = _wanted_brackets(ranks, keys)
    too_large = F.col("__mixed") & (F.col("__n") > ordered_rows)
    found = _ordered_values(binned, hits.where(~too_large), keys)
    while not (large := hits.where(too_large)).isEmpty():
        binned, hits = _cut_again(binned, large, keys, accuracy)
        found = found.unionByName(_ordered_values(binned, hits.where(~too_large), keys))

    slots = [F.col("__w.__slot") == i for i in range(len(probabilities))]
    aggregated = found.groupBy(*keys).agg(
        *[F.min(F.when(s, F.col("__v"))).alias(f"__lo{i}") for i, s in enumerate(slots)],
        *[F.max(F.when(s, F.col("__v"))).alias(f"__hi{i}") for i, s in enumerate(slots)],
        *[F.max(F.when(s, F.col("__w.__fraction"))).alias(f"__f{i}") for i, s in enumerate(slots)],
        F.count(F.lit(1)).alias("__found"),
    )
    quantile = [
        F.col(f"__lo{i}") + (F.col(f"__hi{i}") - F.col(f"__lo{i}")) * F.col(f"__f{i}") for i in range(len(probabilities))
    ]
    return aggregated.where("__found > 0").select(*keys, F.array(*quantile).alias(name))


def unpivot_values(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows ``(keys, feature, value)`` for several measured columns."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(*keys, F.explode(pairs).alias("__p")).select(*keys, "__p.feature", "__p.value")


def quartiles_by_hour(
    df: DataFrame, columns: Sequence[str], key: str = "station_id", time_col: str = "ts"
) -> DataFrame:
    """First and third quartile per station, clock hour and feature."""
    long = unpivot_values(df.withColumn("hour", F.hour(time_col)), [key, "hour"], columns)
    return exact_quantiles(long, [key, "hour", "feature"], "value", [0.25, 0.75]).select(
        key, "hour", "feature", F.get("quantiles", F.lit(0)).alias("q1"), F.get("quantiles", F.lit(1)).alias("q3")
    )


def mask_outliers(
    df: DataFrame,
    columns: Sequence[str],
    margin: float,
    key: str = "station_id",
    time_col: str = "ts",
    whisker: float = 1.5,
) -> DataFrame:
    """Null out values on or outside the quartile whiskers of their station and clock hour.

    ``margin`` widens the upper side only. All columns are judged by the hour of their row.
    """
    quartiles = quartiles_by_hour(df, columns, key, time_col)
    spread = (F.col("q3") - F.col("q1")) * whisker
    limits = (
        quartiles.withColumn("limits", F.struct((F.col("q1") - spread).alias("low"), (F.col("q3") + spread + margin).alias("high")))
        .groupBy(key, "hour")
        .agg(*[F.max(F.when(F.col("feature") == c, F.col("limits"))).alias(f"__{c}") for c in columns])
        .withColumnRenamed("hour", "__hour")
    )

    def masked(name: str):
        outside = (F.col(name) <= F.col(f"__{name}.low")) | (F.col(name) >= F.col(f"__{name}.high"))
        return F.when(F.coalesce(outside, F.lit(False)), F.lit(None)).otherwise(F.col(name))

    joined = df.withColumn("__hour", F.hour(time_col)).join(small_side(limits), [key, "__hour"], "left")
    return joined.withColumns({c: masked(c) for c in columns}).select(*df.columns)
