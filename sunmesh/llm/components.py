"""Connected components of an edge table, by DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunmesh.sources.tables import materialise

#: Edges for each task: rounds shrink, and so do their tasks.
TASK_EDGES = 200_000


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges`` (``a, b``, bigint); the component is its smallest node.

    Each round points every node at its smallest neighbour, follows the
    pointers twice, and contracts the edges to what the nodes point at; edges
    inside a contracted node vanish. Rounds are stored, so a lost executor
    costs one round. A node with very many edges is aggregated on the map side
    first, and the joins' other side has one row per node, so adaptive
    execution can split it. Null ends and loops are ignored, repeated edges
    count once; no edges give no rows.
    """
    loose = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = materialise(loose, "edges")
    known = None
    while edges_left := left.count():
        tasks = edges_left // TASK_EDGES + 4
        both = left.union(left.select("b", "a"))
        pointed = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to"))
        pointers = materialise(pointed.withColumn("to", F.least("node", "to")).coalesce(tasks), "pointers")
        for _ in range(2):
            onward = pointers.select(F.col("node").alias("to"), F.col("to").alias("_next"))
            pointers = pointers.join(onward, "to", "left").select("node", F.coalesce("_next", "to").alias("to"))
        pointers = materialise(pointers.coalesce(tasks), "pointers")
        if known is None:
            known = pointers.withColumnRenamed("to", "component")
        else:
            moved = known.join(pointers.withColumnRenamed("node", "component"), "component", "left")
            known = moved.select("node", F.coalesce("to", "component").alias("component"))
        known = materialise(known, "components")
        ends = left.join(pointers.select(F.col("node").alias("a"), F.col("to").alias("_a")), "a")
        ends = ends.join(pointers.select(F.col("node").alias("b"), F.col("to").alias("_b")), "b").filter("_a <> _b")
        left = materialise(ends.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct().coalesce(tasks), "edges")
    if known is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return known
