"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sunmesh.llm.common import WORD, running_totals
from sunmesh.operators.sizing import small_side
from sunmesh.sources.tables import materialise

#: How often a document may be taken.
PASSES = 3


def targets(sources: DataFrame, weights: Sequence[int] = (1, 2, 3), passes: int = PASSES) -> DataFrame:
    """Per source (``source, source_size``) its ``target``; ``rank`` counts the sources by code point, null last.

    Sources share the sum of all sizes by weight; none may exceed ``passes``
    times its size. The excess goes to the others by weight until all fit: with
    the sources ordered by the level at which they are full, the level that
    spends the sum is found in one pass. One row per source is in memory.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sources.withColumn("rank", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumns({"weight": weight.cast("bigint"), "cap": F.col("source_size") * passes})
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    all_ = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.sum("source_size").over(all_) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    levelled = ranked.withColumn("level", left.cast("double") / F.sum("weight").over(after))
    holds = F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.struct("cap", "level"))
    first = F.first(holds, ignorenulls=True).over(by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return levelled.withColumn("level", first["level"]).select(
        "source", "rank", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target")
    )


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), passes: int = PASSES, seed: str = "mix", row: str | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, size, source_size, target, copies, taken``, how often the mix takes it.

    A document's size is its number of words. A source's documents stand in an
    order drawn from their ids (md5, so reruns agree) and are passed up to
    ``passes`` times. Each gets its virtual finish time, the source's words up
    to and with it divided by the source's target; the rows of all sources are
    range-sorted by that time and taken while their sum keeps within the sum of
    all sizes. A source comes within a document of its target. Null texts have
    size 0; texts of size 0 are taken once or never and add nothing; null is a
    source of its own; rows that repeat an id stand side by side. No documents
    give no rows. ``row`` names a column that tells rows apart; it comes back
    too. Other columns are not read.
    """
    order = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("bigint")
    narrow = docs.select("doc_id", "source", size.alias("size"), order.alias("_order"), F.xxhash64("text").alias("_tie"), (F.col(row) if row else F.monotonically_increasing_id()).alias("_row"))
    rows = materialise(narrow, "sizes")
    counted = materialise(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    aims = materialise(targets(counted.select("source", "source_size"), weights, passes), "targets")
    # One global order by source and draw: the sums before a row, without those of the sources before its own. No source is one task.
    drawn = [F.col("source").isNull(), F.col("source"), F.col("_order"), F.col("_tie"), F.col("_row")]
    queue = running_totals(rows, drawn, ["size"])
    sources_before = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    aimed = aims.select(F.col("source").alias("_source"), "rank", "source_size", "target", F.coalesce(F.sum("source_size").over(sources_before), F.lit(0)).alias("_offset"))
    # One row per source, measured before it is broadcast.
    queued = queue.join(small_side(aimed), F.col("source").eqNullSafe(F.col("_source")))
    queued = queued.withColumn("_done", F.col("size_before") + F.col("size") - F.col("_offset")).drop("size_before", "_source")
    # Repeated ids with one text share a finish time only by chance; the row number tells them apart.
    turns = queued.withColumn("_turn", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
    # A source without words has target 0; its documents add nothing and stand first.
    finish = F.try_divide((F.col("_done") + F.col("_turn") * F.col("source_size")).cast("double"), F.col("target"))
    turns = turns.select("_row", "doc_id", "size", "source_size", "target", "rank", "_turn", "_tie", F.coalesce(finish, F.lit(0.0)).alias("_finish"))
    budget = counted.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("s")).first()["s"]
    timed = running_totals(turns, [F.col("_finish"), F.col("rank"), F.col("_turn"), F.col("doc_id"), F.col("_tie"), F.col("_row")], ["size"])
    taken = timed.withColumn("_in", (F.col("size_before") + F.col("size") <= budget) & ((F.col("size") > 0) | (F.col("_turn") == 0)))
    per_row = taken.groupBy("_row").agg(
        *(F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target")),
        F.sum(F.col("_in").cast("bigint")).alias("copies"),
    )
    result = per_row.withColumn("taken", F.col("copies") * F.col("size"))
    return result.withColumnRenamed("_row", row) if row else result.drop("_row")
