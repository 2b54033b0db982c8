"""Row and value cleaning of station readings."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunmesh import schemas
from sunmesh.functions.text import normalise_column_name, observation_time
from sunmesh.operators.sizing import small_side


def canonical_coordinates(df: DataFrame, key: str = "station_id", columns: Sequence[str] = tuple(schemas.COORDINATES)) -> DataFrame:
    """Most frequent complete coordinate triple per station; ties go to the smallest triple."""
    votes = df.dropna("any", subset=list(columns)).groupBy(key, *columns).agg(F.count(F.lit(1)).alias("votes"))
    rank = F.struct((-F.col("votes")).alias("against"), *[F.col(c) for c in columns])
    return votes.groupBy(key).agg(F.min(rank).alias("best")).select(key, *[F.col(f"best.{c}").alias(c) for c in columns])


def with_canonical_coordinates(df: DataFrame, key: str = "station_id", columns: Sequence[str] = tuple(schemas.COORDINATES)) -> DataFrame:
    """Overwrite the coordinates of every row by the station's canonical ones."""
    return overwrite_coordinates(df, canonical_coordinates(df, key, columns), key, columns)


def overwrite_coordinates(
    df: DataFrame, canonical: DataFrame, key: str = "station_id", columns: Sequence[str] = tuple(schemas.COORDINATES)
) -> DataFrame:
    return df.drop(*columns).join(small_side(canonical), key, "left").select(*df.columns)


def parse_time(df: DataFrame, date_col: str = "data", hour_col: str = "hour") -> DataFrame:
    """Replace the date and hour texts by ``ts`` and derive ``doy``, ``year`` and ``hour``."""
    stamped = df.withColumn("ts", observation_time(F.col(date_col), F.col(hour_col))).drop(date_col, hour_col)
    return with_time_parts(stamped)


def with_time_parts(df: DataFrame) -> DataFrame:
    return df.withColumns({"doy": F.dayofyear("ts"), "year": F.year("ts"), "hour": F.hour("ts")})


def cast_measurements(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Cast to double; texts that are no number and NaN become null."""
    return df.withColumns({c: F.nullif(F.col(c).try_cast("double"), F.lit(float("nan"))) for c in columns})


def drop_duplicate_times(df: DataFrame, keys: Sequence[str] = ("station_id", "ts")) -> DataFrame:
    """One row per station and time: the smallest by all other columns, so the choice is repeatable.

    Duplicates are rare, so only the keys are shuffled to find them; all other
    rows pass through unshuffled. Rows with a null key are kept as they are.
    """
    keys = list(keys)
    repeated = small_side(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select(*keys))
    others = [c for c in df.columns if c not in keys]
    kept = df.join(repeated, keys, "left_semi").groupBy(*keys).agg(F.min(F.struct(*others)).alias("kept"))
    resolved = kept.select(*keys, *[F.col(f"kept.{c}").alias(c) for c in others])
    return df.join(repeated, keys, "left_anti").select(*df.columns).unionByName(resolved.select(*df.columns))


def daylight(df: DataFrame, hours: tuple[int, int] = schemas.DAYLIGHT_HOURS, time_col: str = "ts") -> DataFrame:
    return df.where(F.hour(time_col).between(*hours))


def mask_ranges(
    df: DataFrame,
    lower: Mapping[str, float] | None = None,
    upper_exclusive: Mapping[str, float] | None = None,
) -> DataFrame:
    """Null out values below their lower limit, or at or above their upper one."""
    lower, upper_exclusive = lower or {}, upper_exclusive or {}
    masked = {}
    for name in {**lower, **upper_exclusive}:
        valid = F.lit(True)
        if name in lower:
            valid = valid & (F.col(name) >= lower[name])
        if name in upper_exclusive:
            valid = valid & (F.col(name) < upper_exclusive[name])
        masked[name] = F.when(valid, F.col(name))
    return df.withColumns(masked)


def mask_sentinel(df: DataFrame, columns: Iterable[str], sentinel: float = schemas.SENTINEL) -> DataFrame:
    return df.withColumns({c: F.nullif(F.col(c), F.lit(sentinel)) for c in columns})


def drop_incomplete(df: DataFrame, columns: Sequence[str] | None = None, min_present: int | None = None) -> DataFrame:
    """Drop rows with any missing value, or with fewer than ``min_present`` present ones."""
    subset = list(columns) if columns else None
    return df.dropna(how="any", thresh=min_present, subset=subset)


def normalise_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[normalise_column_name(c) for c in df.columns])


def features_and_target(df: DataFrame, target: str, seed: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Split into features and target; with a ``seed`` both come in the same random row order."""
    if seed is not None:
        df = df.orderBy(F.rand(seed))
    return df.drop(target), df.select(target)


def keyed_features_and_target(
    df: DataFrame, target: str, keys: Sequence[str], seed: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Features and target, both with the key columns, so that rows are paired by key however the frames are stored.

    With a ``seed`` both come in the same random order, that of a hash of seed
    and key; it depends on the rows alone, not on their partitions.
    """
    if seed is not None:
        df = df.orderBy(F.xxhash64(F.lit(seed), *keys), *keys)
    return df.drop(target), df.select(*keys, target)


def assign_split(df: DataFrame, test_years: tuple[int, int] = schemas.TEST_YEARS, time_col: str = "ts") -> DataFrame:
    """``train`` before the test years, ``test`` in them, null after."""
    year = F.year(time_col)
    split = F.when(year < test_years[0], F.lit("train")).when(year <= test_years[1], F.lit("test"))
    return df.withColumn("split", split)


def station_status(df: DataFrame, min_rows: int = schemas.MIN_SAMPLES, key: str = "station_id") -> DataFrame:
    """``train`` or ``skip`` per station by number of rows; stations without both splits are not listed."""
    counted = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("split") == "train").alias("n_train"),
        F.count_if(F.col("split") == "test").alias("n_test"),
    )
    status = F.when(F.col("n_rows") >= min_rows, F.lit("train")).otherwise(F.lit("skip"))
    return counted.where((F.col("n_train") > 0) & (F.col("n_test") > 0)).withColumn("status", status)


def keep_trainable(df: DataFrame, status: DataFrame, key: str = "station_id") -> DataFrame:
    eligible = status.where(F.col("status") == "train").select(key)
    return df.join(small_side(eligible), key, "left_semi")
