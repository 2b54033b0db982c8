"""Raw yearly station files: ``;``-separated, decimal comma, Latin-1, key/value header on top."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sunmesh import schemas
from sunmesh.functions.text import decimal_comma, file_name_field, observation_time, strip_accents, title_case
from sunmesh.operators.sizing import small_side

# Patterns of a data row's date and of a file name inside a path.
DATE_PATTERN = r"^\s*\d{4}[-/]\d{2}[-/]\d{2}\s*$"
CSV_PATTERN = r"(?i)\.csv"
FILE_PATTERN = r"^(?:.*[/=])?([^/=_]+_[^/=_]+_[^/=_]+_[^/=_]+_[^/=]+)(?:/.*)?$"

_RAW_SCHEMA = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(schemas.RAW_COLUMNS))])


def file_name_in(path: Column) -> Column:
    """Last path segment that looks like a station file name; a directory if Spark wrote the file's parts below it."""
    return F.url_decode(F.regexp_extract(path, FILE_PATTERN, 1))


def selected(
    file_name: Column,
    region_tag: str = schemas.REGION_TAG,
    extra: Sequence[str] = tuple(schemas.EXTRA_STATIONS),
    ignored: Sequence[str] = tuple(schemas.IGNORED_STATIONS),
) -> Column:
    """Keep a file of the home region or of an extra station, unless its station is ignored."""
    station = file_name_field(file_name, 3)
    return ~station.isin(*ignored) & (F.contains(file_name, F.lit(region_tag)) | station.isin(*extra))


def scan(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """All lines of all files below ``paths`` as text cells, with the file name.

    A filter on ``file_name`` is evaluated on the file listing, before any byte is read.
    """
    return (
        spark.read.schema(_RAW_SCHEMA)
        .options(sep=";", encoding="ISO-8859-1", recursiveFileLookup="true", mode="PERMISSIVE")
        .csv(paths if isinstance(paths, str) else list(paths))
        .withColumn("file_name", file_name_in(F.col("_metadata.file_path")))
        .where(F.col("file_name").rlike(CSV_PATTERN))
    )


def lines_as_cells(lines: DataFrame) -> DataFrame:
    """The same cells from ``(file_name, value)`` text lines."""
    cells = F.split("value", ";")
    return lines.select(*[F.get(cells, F.lit(i)).alias(c) for i, c in enumerate(_RAW_SCHEMA.names)], "file_name")


def land(spark: SparkSession, paths: str | Sequence[str], target: str) -> DataFrame:
    """Read every file once and store its cells as parquet, header and data rows apart.

    Header values and measurements are then both read from columns, so the text
    is parsed only once however large the archive is.
    """
    kind = F.when(F.col("c0").rlike(DATE_PATTERN), F.lit("data")).otherwise(F.lit("header"))
    scan(spark, paths).withColumn("kind", kind).write.mode("errorifexists").partitionBy("kind").parquet(target)
    return spark.read.parquet(target)


def headers(cells: DataFrame) -> DataFrame:
    """``(file_name, latitude, longitude, altitude)`` from the key/value lines of each file."""
    keyed = cells.where(F.col("c0").endswith(":")).select(
        "file_name",
        strip_accents(F.upper(F.rtrim(F.col("c0"), F.lit(":")))).alias("key"),
        decimal_comma(F.col("c1")).alias("number"),
    )
    wanted = {"latitude": "LATITUDE", "longitude": "LONGITUDE", "altitude": "ALTITUDE"}
    return (
        keyed.where(F.col("key").isin(*wanted.values()))
        .groupBy("file_name")
        .agg(*[F.max(F.when(F.col("key") == text, F.col("number"))).alias(name) for name, text in wanted.items()])
    )


def header_pairs(cells: DataFrame) -> DataFrame:
    """All header entries as ``(file_name, key, value)``, keys in plain upper case, decimal points."""
    return cells.where(F.col("c0").endswith(":")).select(
        "file_name",
        strip_accents(F.upper(F.rtrim(F.col("c0"), F.lit(":")))).alias("key"),
        F.replace(F.coalesce("c1", F.lit("")), F.lit(","), F.lit(".")).alias("value"),
    )


def observations(cells: DataFrame) -> DataFrame:
    """Typed data rows with station id and header coordinates."""
    rows = cells.where(F.col("c0").rlike(DATE_PATTERN))
    typed = rows.select(
        "file_name",
        file_name_field(F.col("file_name"), 3).alias("station_id"),
        observation_time(F.col("c0"), F.col("c1")).alias("ts"),
        *[decimal_comma(F.col(f"c{i}")).alias(c) for i, c in enumerate(schemas.RAW_COLUMNS) if i >= 2],
    )
    return typed.join(small_side(headers(cells)), "file_name", "left").select(*schemas.READING_SCHEMA.names)


def read_station_files(spark: SparkSession, paths: str | Sequence[str], select_files: bool = True) -> DataFrame:
    """One typed table of all (selected) station files. For large archives ``land`` them first."""
    cells = scan(spark, paths)
    return observations(cells.where(selected(F.col("file_name"))) if select_files else cells)


def concatenate(tables: Iterable[DataFrame]) -> DataFrame:
    """Union by name; columns absent from a table become null."""
    first, *rest = list(tables)
    for table in rest:
        first = first.unionByName(table, allowMissingColumns=True)
    return first


def cities(file_names: DataFrame) -> DataFrame:
    """City per station from its first file name in sort order."""
    named = file_names.select("file_name", file_name_field(F.col("file_name"), 3).alias("station_id"))
    return named.groupBy("station_id").agg(title_case(file_name_field(F.min("file_name"), 4)).alias("city_name"))


def station_summary(readings: DataFrame, city_names: DataFrame) -> DataFrame:
    """Smallest coordinates, first date (``d/m/y``), number of rows and city per station."""
    summary = readings.groupBy("station_id").agg(
        *[F.min(c).alias(c) for c in schemas.COORDINATES],
        F.date_format(F.min("ts"), "dd/MM/yyyy").alias("first_register"),
        F.count("ts").alias("n_samples"),
    )
    return summary.join(city_names, "station_id", "left")
