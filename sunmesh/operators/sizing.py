"""Broadcast decisions taken on measured sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunmesh.session import scratch_path
from sunmesh.sources.tables import read_table, write_table

#: A broadcast has at most so many rows, and so many bytes as stored; in memory these may be a few times as many.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 16 << 20


def stored_bytes(df: DataFrame, path: str) -> int:
    """Bytes of all files below ``path``, on whatever file system it is."""
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(target).getLength()


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Store ``df``, measure it, and hint a broadcast if its rows (from the file footers) and bytes keep within the bounds.

    Meant for tables of a few narrow columns per station or group. Storing them
    means that the aggregation behind them runs once, and that the join starts
    with a known size: without it the planner would shuffle the large side by a
    possibly very frequent key. Beyond the bounds the optimizer chooses, and
    adaptive execution splits the frequent keys of a shuffled join.
    """
    path = write_table(df, scratch_path(df.sparkSession, "small-side"))
    stored = read_table(df.sparkSession, path)
    if stored_bytes(df, path) > max_bytes or stored.count() > max_rows:
        return stored
    return F.broadcast(stored)
