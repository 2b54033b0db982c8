"""Reading and writing of intermediate tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sunmesh.session import scratch_path

# Published table of samples per station.
SAMPLES_SCHEMA = T.StructType(
    [T.StructField("station", T.StringType()), T.StructField("train", T.LongType()), T.StructField("test", T.LongType())]
)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), cluster_by: Sequence[str] = ()) -> str:
    """Write parquet; ``partition_by`` is for few distinct values, ``cluster_by`` range-sorts inside files.

    Range partitioning splits a frequent key over several tasks and files, and
    gives the row-group statistics that later station or time filters prune by.
    """
    if cluster_by:
        df = df.repartitionByRange(*partition_by, *cluster_by).sortWithinPartitions(*partition_by, *cluster_by)
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)
    return path


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_positions(spark: SparkSession, path: str, name: str = "position") -> DataFrame:
    """Rows of a stored parquet table with their place in it, from 1 on: files by name, rows as they stand in a file.

    Only one row per file is ordered; the rows themselves are not shuffled.
    """
    placed = spark.read.parquet(path).withColumns({"__file": F.col("_metadata.file_name"), "__row": F.col("_metadata.row_index")})
    counts = placed.groupBy("__file").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__file", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    numbered = placed.join(F.broadcast(offsets), "__file").withColumn(name, F.col("__before") + F.col("__row") + 1)
    return numbered.drop("__file", "__row", "__before")


def materialise(df: DataFrame, name: str, cluster_by: Sequence[str] = ()) -> DataFrame:
    """Store an intermediate result in the shared folder and read it back.

    Steps that pass over their input several times then read a pruned column
    scan instead of repeating all earlier steps, and a lost executor costs only
    the step under way.
    """
    spark = df.sparkSession
    return spark.read.parquet(write_table(df, scratch_path(spark, name), cluster_by=cluster_by))


def store_bucketed(df: DataFrame, name: str, keys: Sequence[str], sort_by: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """Store a table in the shared folder in buckets by ``keys``, one file each, and read it back.

    Joins, windows and groupings on exactly these keys need no exchange of its
    rows, however often they run; a join needs the same number of ``buckets`` on
    both sides. It is by default the session's number of shuffle partitions;
    choose it so that a bucket fits into a task. The keys must spread the rows
    (a station and its time slice, not the station alone), since equal keys are
    in one bucket. The name is taken out of the catalog again at once: the rows
    are found through the DataFrame and go with the other stored steps.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    table = f"{name.replace('-', '_')}_{path.rsplit('-', 1)[1]}"
    number = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = df.repartition(number, *keys).write.bucketBy(number, *keys)
    if sort_by:
        writer = writer.sortBy(*sort_by)
    writer.option("path", path).saveAsTable(table)
    stored = spark.table(table)
    spark.sql(f"drop table {table}")
    return stored


def export_csv(df: DataFrame, path: str) -> str:
    df.write.mode("errorifexists").option("header", True).csv(path)
    return path


def import_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header line; the schema is declared, never inferred."""
    return spark.read.schema(schema).option("header", True).csv(path)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    return import_csv(spark, path, SAMPLES_SCHEMA)


def write_matrices(features: DataFrame, path: str, split: str = "split") -> str:
    """Scaled train and test matrices as named columns, one directory per split."""
    return write_table(features, path, [split])


def time_columns(df: DataFrame, time_col: str = "ts") -> DataFrame:
    """Replace the timestamp by two-digit text parts ``year, month, day, hour`` for export."""
    iso = F.date_format(time_col, "yyyy-MM-dd HH")
    cuts = {"year": (1, 4), "month": (6, 2), "day": (9, 2), "hour": (12, 2)}
    return df.withColumns({n: F.substring(iso, a, b) for n, (a, b) in cuts.items()}).drop(time_col)
