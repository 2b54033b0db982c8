"""Row-order operators that never hold a whole key in one task.

A plain window over ``station_id`` puts every row of a station into one task,
which fails once a single station owns a large share of the data. Here each key
is cut into time slices. The windows run inside ``(key, slice)``, and the few
values that cross a slice border (counts, first or last rows) come from a
summary with one row per slice, joined back on the same ``(key, slice)`` that
the window is already partitioned by.

The argument ``slices`` is the slice width in hours. Where a key has one row per
hour, as a station has, such slices are small whatever the number of rows. If
times repeat, so that even one hour of one key may be huge, pass ``RANGE``: the
rows are then range-partitioned by the full order, tie-breaks included, and
stored, and a slice is the part of a key inside one partition.

Rows that several of these operators pass over can be stored once in buckets by
key and slice (``store_slices``). With ``STORED`` the operators then use those
slices, and only summaries are shuffled, never the rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sunmesh.sources.tables import materialise, store_bucketed

SLICE_HOURS = 720
RANGE = "range"
STORED = "stored"
SLICE = "__slice"
_FIRST_SLICE = -(2**31)


def time_slice(ts: Column, hours: int = SLICE_HOURS) -> Column:
    """Slice number of a timestamp; rises with time, nulls come first as in an ascending sort."""
    elapsed = F.unix_date(F.to_date(ts)) * 24 + F.hour(ts)
    return F.coalesce(F.floor(elapsed / hours).cast("int"), F.lit(_FIRST_SLICE))


def _sliced(df: DataFrame, keys: Sequence[str], order: Sequence[str], slices: int | str | None) -> DataFrame:
    """Add the slice number; default width is a month of one key, or an hour of everything if there is no key."""
    if slices == STORED:
        return df
    if slices == RANGE:
        # The partition number is stored with the rows, so that every later reader sees the same one.
        ranged = df.repartitionByRange(*keys, *order).withColumn(SLICE, F.spark_partition_id())
        return materialise(ranged, "ranged")
    return df.withColumn(SLICE, time_slice(F.col(order[0]), slices or (SLICE_HOURS if keys else 1)))


def store_slices(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], hours: int | None = None, buckets: int | None = None
) -> DataFrame:
    """``df`` with its slice number, stored in buckets by key and slice for operators called with ``STORED``.

    They keep the slice number, so that one operator's rows can go into the next
    without an exchange; drop ``SLICE`` at the end.
    """
    return store_bucketed(_sliced(df, keys, order, hours), "slices", [*keys, SLICE], order, buckets)


def with_row_numbers(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str = "row_number",
    total: str | None = None,
    slices: int | str | None = None,
) -> DataFrame:
    """1-based position of each row inside its key; ``order[0]`` is the time column.

    ``total`` names an optional column with the number of rows of the key.
    """
    keys = list(keys)
    sliced = _sliced(df, keys, order, slices)
    per_key = Window.partitionBy(*keys).orderBy(SLICE)
    offsets = (
        sliced.groupBy(*keys, SLICE)
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__before", F.coalesce(F.sum("__n").over(per_key.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("__total", F.sum("__n").over(Window.partitionBy(*keys)))
        .drop("__n")
    )
    inside = F.row_number().over(Window.partitionBy(*keys, SLICE).orderBy(*order))
    numbered = (
        sliced.withColumn("__inside", inside)
        .join(offsets, [*keys, SLICE])
        .withColumn(name, F.col("__before") + F.col("__inside"))
    )
    if total:
        numbered = numbered.withColumn(total, F.col("__total"))
    return numbered.select(*df.columns, name, *([total] if total else []))


def _border_rows(ranked: DataFrame, keys: list[str], rank: str, payload: Column, count: int) -> DataFrame:
    """The ``count`` rows of lowest rank of each slice, as one array per slice in rank order."""
    pair = F.struct(F.col(rank).alias("rank"), payload.alias("row"))
    return (
        ranked.where(F.col(rank) <= count)
        .groupBy(*keys, SLICE)
        .agg(F.transform(F.sort_array(F.collect_list(pair)), lambda p: p["row"]).alias("__border"))
    )


def with_lead(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: Mapping[str, str],
    rows: int = 1,
    slices: int | str | None = None,
) -> DataFrame:
    """Values found ``rows`` rows later in the key; ``columns`` maps new names to source columns."""
    keys = list(keys)
    payload = F.struct(*[F.col(source).alias(new) for new, source in columns.items()])
    in_slice = Window.partitionBy(*keys, SLICE)
    ranked = _sliced(df, keys, order, slices).withColumn("__rank", F.row_number().over(in_slice.orderBy(*order)))
    heads = _border_rows(ranked, keys, "__rank", payload, rows)
    per_key = Window.partitionBy(*keys).orderBy(SLICE)
    no_rows = F.filter(F.col("__border"), lambda _: F.lit(False))
    following = F.concat(*[F.coalesce(F.lead("__border", i).over(per_key), no_rows) for i in range(1, rows + 1)])
    carry = heads.select(*keys, SLICE, F.slice(following, 1, rows).alias("__carry"))
    left_in_slice = F.col("__size") - F.col("__rank")
    shifted = (
        ranked.withColumn("__lead", F.lead(payload, rows).over(in_slice.orderBy(*order)))
        .withColumn("__size", F.count(F.lit(1)).over(in_slice))
        .join(carry, [*keys, SLICE], "left")
        .withColumn(
            "__found",
            F.when(left_in_slice >= rows, F.col("__lead")).otherwise(
                F.get("__carry", (F.lit(rows - 1) - left_in_slice).cast("int"))
            ),
        )
    )
    return shifted.select(*df.columns, *[F.col(f"__found.{new}").alias(new) for new in columns])


def forward_fill(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: Sequence[str],
    limit: int = 2,
    slices: int | str | None = None,
) -> DataFrame:
    """Fill nulls by the nearest earlier value that is at most ``limit`` rows away."""
    keys, columns = list(keys), list(columns)
    in_slice = Window.partitionBy(*keys, SLICE)
    sliced = _sliced(df, keys, order, slices)
    backwards = sliced.withColumn("__back", F.row_number().over(in_slice.orderBy(*[F.col(c).desc() for c in order])))
    tails = _border_rows(backwards, keys, "__back", F.struct(*columns), limit)
    per_key = Window.partitionBy(*keys).orderBy(SLICE)
    no_rows = F.filter(F.col("__border"), lambda _: F.lit(False))
    earlier = F.concat(*[F.coalesce(F.lag("__border", i).over(per_key), no_rows) for i in range(1, limit + 1)])
    carry = tails.select(*keys, SLICE, F.slice(earlier, 1, limit).alias("__carry"))
    recent = in_slice.orderBy(*order).rowsBetween(-limit, 0)
    reach = F.greatest(F.lit(limit + 1) - F.col("__rank"), F.lit(0))

    def filled(name: str) -> Column:
        reachable = F.transform(F.slice("__carry", F.lit(1), reach), lambda row: row[name])
        return F.coalesce(F.col(f"__recent.{name}"), F.get(F.filter(reachable, lambda v: v.isNotNull()), F.lit(0)))

    # The in-slice fills go through one struct, so that the source columns keep their names until the end.
    return (
        sliced.withColumn("__rank", F.row_number().over(in_slice.orderBy(*order)))
        .withColumns({f"__r_{c}": F.last(c, ignorenulls=True).over(recent) for c in columns})
        .withColumn("__recent", F.struct(*[F.col(f"__r_{c}").alias(c) for c in columns]))
        .join(carry, [*keys, SLICE], "left")
        .withColumns({c: filled(c) for c in columns})
        .select(*df.columns)
    )


def next_hour_target(
    df: DataFrame,
    value: str,
    target: str,
    rows: int = 1,
    strict_time: bool = False,
    key: str = "station_id",
    time_col: str = "ts",
    slices: int | str | None = None,
) -> DataFrame:
    """Target = ``value`` found ``rows`` rows later in the station.

    Apply it after the daylight filter: the last daylight row then gets the first
    one of the next day. ``strict_time`` keeps only targets exactly ``rows`` hours ahead.
    """
    led = with_lead(df, [key], [time_col], {target: value, "__next_ts": time_col}, rows, slices)
    if strict_time:
        due = F.col(time_col) + F.make_interval(hours=F.lit(rows))
        led = led.withColumn(target, F.when(F.col("__next_ts") == due, F.col(target)))
    return led.drop("__next_ts")


def every_nth_split(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int = 5, slices: int | str | None = None
) -> DataFrame:
    """``split`` = ``test`` for the first and then every n-th row of a key, ``train`` for the others."""
    numbered = with_row_numbers(df, keys, order, "__number", slices=slices)
    split = F.when((F.col("__number") - 1) % n == 0, F.lit("test")).otherwise(F.lit("train"))
    return numbered.withColumn("split", split).drop("__number")


def contiguous_folds(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], k: int = 5, name: str = "fold", slices: int | str | None = None
) -> DataFrame:
    """Unshuffled fold number 0..k-1 per key; the first ``rows % k`` folds get one row more."""
    numbered = with_row_numbers(df, keys, order, "__number", "__total", slices)
    index, total = F.col("__number") - 1, F.col("__total")
    size = F.floor(total / k)
    longer = total % k
    in_longer = longer * (size + 1)
    fold = F.when(index < in_longer, F.floor(index / (size + 1))).otherwise(
        longer + F.floor((index - in_longer) / F.greatest(size, F.lit(1)))
    )
    return numbered.withColumn(name, fold.cast("int")).drop("__number", "__total")
