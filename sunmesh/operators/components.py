"""Connected components of a graph of stations, by joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunmesh.sources.tables import materialise


def connected_components(edges: DataFrame, a: str = "station_id", b: str = "neighbour_id") -> DataFrame:
    """``(a, component)`` for every node with an edge; a component is named by its smallest node.

    Every round points each node at its smallest neighbour, or at itself if it
    is smaller, follows the pointers twice and keeps the edges between what the
    nodes point at. A component loses at least half of its nodes in a round, so
    a line of a million stations takes twenty at most. Rounds are stored; their tables shrink. Nulls and
    loops are left out, the direction and number of edges don't count.
    """
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    links = materialise(ends.union(ends.select("b", "a")).distinct(), "links")
    rounds = []
    while not links.isEmpty():
        smallest = materialise(links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to")).withColumn("to", F.least("node", "to")), "pointers")
        pointers = smallest
        for _ in range(2):
            onward = pointers.select(F.col("node").alias("to"), F.col("to").alias("onward"))
            pointers = pointers.join(onward, "to").select("node", F.col("onward").alias("to"))
        rounds.append(pointers)
        moved = links.join(pointers.select(F.col("node").alias("a"), F.col("to").alias("to_a")), "a")
        moved = moved.join(pointers.select(F.col("node").alias("b"), F.col("to").alias("to_b")), "b").where("to_a <> to_b")
        links = materialise(moved.select(F.col("to_a").alias("a"), F.col("to_b").alias("b")).distinct(), "links")
    if not rounds:
        return links.select(F.col("a").alias(a), F.col("b").alias("component"))
    found = rounds[0]
    for pointers in rounds[1:]:
        found = found.join(pointers.select(F.col("node").alias("to"), F.col("to").alias("further")), "to", "left").select("node", F.coalesce("further", "to").alias("to"))
    return found.select(F.col("node").alias(a), F.col("to").alias("component"))
