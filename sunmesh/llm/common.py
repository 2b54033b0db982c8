"""What several operators share: batch bounds, texts as words, exact prefix sums in a global order."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sunmesh.sources.tables import materialise

#: Bytes of one Arrow batch between the JVM and Python: very long texts travel in small batches.
BATCH_BYTES = 16 << 20
#: ``[^\x20\x09-\x0D]+`` as a regular expression for the JVM.
WORD = r"[^\x20\x09-\x0D]+"


#: What a Python worker keeps from one task to the next, by name, and how to give it back.
_KEPT: dict[str, Callable[[], None]] = {}
_current = [""]


def keeps(name: str, forget: Callable[[], None]) -> None:
    """Declare that a module keeps something in its worker."""
    _KEPT[name] = forget


def only(name: str) -> None:
    """Give back all that a worker keeps but ``name``: it lives on from stage to stage, and one stage's memory is enough."""
    if _current[0] == name:
        return
    _current[0] = name
    for other, forget in _KEPT.items():
        if other != name:
            forget()
    gc.collect()
    # Arrow and the C library hold on to what has been freed.
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError, TypeError):
        ctypes.CDLL(None).malloc_trim(0)


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes; by rows alone, a batch of long texts could fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def running_totals(df: DataFrame, order: Sequence[Column], values: Sequence[str]) -> DataFrame:
    """Add ``<value>_before`` for each value: its exact sum over all rows that come earlier in a global order.

    The rows are range-partitioned by ``order``; sums inside a partition are a
    window, and one row per partition carries what lies before it. ``order``
    should tell rows apart, so that no key fills a partition of its own.
    """
    keys = [f"_key{i}" for i in range(len(order))]
    ranged = df.withColumns(dict(zip(keys, order))).repartitionByRange(*keys)
    stored = materialise(ranged.withColumn("_part", F.spark_partition_id()), "ranged")
    totals = stored.groupBy("_part").agg(*(F.sum(v).alias(f"_sum_{v}") for v in values))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", *(F.coalesce(F.sum(f"_sum_{v}").over(earlier), F.lit(0)).alias(f"_off_{v}") for v in values))
    inside = Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    within = stored.withColumns({f"{v}_before": F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values})
    # One row per partition: its number is bounded by the scheduler, not by the data.
    joined = within.join(F.broadcast(offsets), "_part")
    added = joined.withColumns({f"{v}_before": F.col(f"{v}_before") + F.col(f"_off_{v}") for v in values})
    return added.drop("_part", *keys, *(f"_off_{v}" for v in values))
