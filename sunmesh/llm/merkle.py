"""A Merkle manifest of a table: one tree per group, one over the groups, and a proof for every row.

Every ``FAN`` consecutive nodes of a level become their digest until one is
left; the groups' last nodes form a tree of the same kind. Rows get their exact
place in their group, and ``FAN ** LEVELS`` (4,096) consecutive places are a superblock.
The levels above superblocks are small and built first. Then each superblock's
leaves meet the outer nodes that their proofs need in one cogrouped task, which
reduces the leaves, joins the proofs and folds each leaf up to the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sunmesh.llm.common import bounded_batches, running_totals
from sunmesh.operators.sizing import small_side
from sunmesh.sources.tables import materialise

#: Consecutive nodes that become one.
FAN = 16
#: Levels that a superblock reduces, 16 ** 3 = 4,096 leaves.
LEVELS = 3
#: Characters of a digest.
HEX = 64


def field(value: Column) -> Column:
    """A value as a leaf holds it: byte count, colon and text, or ``-`` if null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*(field(v) for v in values)), 256)


def _parents(nodes: DataFrame) -> DataFrame:
    """The level above ``tree, place, node, width``: each run with its ``members``; a tree of one node stays (``grown`` is false)."""
    runs = nodes.groupBy("tree", "width", F.floor(F.col("place") / FAN).alias("place")).agg(F.array_sort(F.collect_list(F.struct("place", "node"))).alias("_run"))
    runs = runs.select("tree", "place", F.col("_run.node").alias("members"), "width")
    node = F.when(F.col("width") > 1, F.sha2(F.array_join("members", ""), 256)).otherwise(F.col("members")[0])
    return runs.select("tree", "place", node.alias("node"), "members", (F.col("width") > 1).alias("grown"), F.ceil(F.col("width") / FAN).alias("width"))


def _grow(nodes: DataFrame, name: str) -> tuple[DataFrame, list[DataFrame]]:
    """The last nodes (``tree, node``) of all trees, and the stored levels below them."""
    levels, level = [], materialise(nodes, name)
    while not level.filter("width > 1").isEmpty():
        level = materialise(_parents(level), name)
        levels.append(level)
    return level.select("tree", "node"), levels


def _descend(paths: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """Carry ``siblings, spots, sizes`` of each tree's last node down to the nodes of the lowest level, by ``tree, place``.

    ``siblings`` are the other members of all runs on the way up, ``spots`` the
    node's index in each run, ``sizes`` the runs' lengths.
    """
    for level in reversed(levels):
        runs = level.select("tree", "place", "members", "grown").join(paths, ["tree", "place"])
        each = runs.select("*", F.posexplode("members").alias("_at", "_node")).withColumn("place", F.col("place") * FAN + F.col("_at"))
        others = F.concat(F.slice("members", F.lit(1), F.col("_at")), F.slice("members", F.col("_at") + 2, F.lit(FAN)))
        longer = {"siblings": others, "spots": F.array("_at"), "sizes": F.array(F.size("members"))}
        paths = each.withColumns({c: F.when(F.col("grown"), F.concat(new, F.col(c))).otherwise(F.col(c)) for c, new in longer.items()})
        paths = paths.drop("members", "grown", "_at", "_node")
    return paths


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _prove_block(leaves: list[str], folded_from: list[str], width: int, block_levels: int, outer: list[tuple[str, str]]) -> list[tuple[str, str, list[str]]]:
    """Proof digest, folded root and siblings of each leaf of one superblock; ``outer`` has what stands left and right above it."""
    runs, nodes = [], leaves
    while width > 1 and len(runs) < block_levels:
        runs.append(["".join(nodes[i : i + FAN]) for i in range(0, len(nodes), FAN)])
        nodes, width = [_sha(r) for r in runs[-1]], -(-width // FAN)
    above = "".join(left + right for left, right in outer)
    proved = []
    for place, node in enumerate(folded_from):
        sides = []
        for level in runs:
            place, at = divmod(place, FAN)
            sides.append((level[place][: HEX * at], level[place][HEX * (at + 1) :]))
        siblings = "".join(left + right for left, right in sides) + above
        for left, right in (*sides, *outer):
            node = _sha(left + node + right)
        proved.append((_sha(siblings), node, siblings))
    return proved


def _prover(key: str, block_levels: int, with_siblings: bool):
    def prove(leaves: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        leaves = leaves.sort_values(["tree", "pos"], kind="stable").reset_index(drop=True)
        known = {}
        for row in outer.itertuples(index=False):
            rest, ends = "".join(row.siblings), []
            for at, size in zip(row.spots, row.sizes):
                ends.append((rest[: HEX * at], rest[HEX * at : HEX * (size - 1)]))
                rest = rest[HEX * (size - 1) :]
            known[row.tree, row.block] = (row.subroot, row.root, ends)
        tree, block = leaves["tree"].to_numpy(), leaves["block"].to_numpy()
        starts = np.flatnonzero(np.r_[True, (tree[1:] != tree[:-1]) | (block[1:] != block[:-1])]) if len(leaves) else []
        rows = []
        for begin, end in zip(starts, [*starts[1:], len(leaves)]):
            part = leaves.iloc[begin:end]
            subroot, root, ends = known[tree[begin], block[begin]]
            original = part["leaf"].tolist()
            tried = part["changed"].where(part["changed"].notna(), part["leaf"]).tolist()
            for proof, folded, siblings in _prove_block(original, tried, int(part["n"].iloc[0]), block_levels, ends):
                rows.append((subroot, root, proof, folded, [siblings[i : i + HEX] for i in range(0, len(siblings), HEX)] if with_siblings else None))
        found = pd.DataFrame(rows, columns=["subroot", "root", "proof_sha256", "folded_root", "siblings"])
        found.insert(0, key, leaves["key"])
        found.insert(1, "leaf", leaves["leaf"])
        return found if with_siblings else found.drop(columns="siblings")

    return prove


def manifest(
    rows: DataFrame,
    columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    key: str = "doc_id",
    group: str = "source",
    tampered: Mapping[str, Column] | None = None,
    block_levels: int = LEVELS,
    with_siblings: bool = False,
) -> DataFrame:
    """``key, leaf, subroot, root, proof_sha256, folded_root, verified`` for every row.

    A row's leaf is the digest of ``columns``. Leaves of a ``group`` ascend by
    ``key`` (null first, equal keys by leaf); the groups ascend, null first, by
    their bytes. ``tampered`` gives columns' values as somebody else holds them:
    the root is folded from those and the original siblings, and ``verified``
    says whether it is the true one. ``with_siblings`` adds the proof itself,
    the siblings from the leaf to the root, left to right.

    Nulls, empty and very long texts are values like others. Repeated rows are
    leaves of their own. No rows give no manifest. Columns that aren't named
    don't count, whatever they are called.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    leaf = leaf_digest([F.col(c) for c in columns])
    other = leaf_digest([(tampered or {}).get(c, F.col(c)) for c in columns])
    hashed = rows.select(F.col(group).alias("group"), F.col(key).alias("key"), leaf.alias("leaf"), F.nullif(other, leaf).alias("changed"))
    leaves = materialise(hashed.withColumns({"row": F.monotonically_increasing_id(), "one": F.lit(1)}), "leaves")

    counts = leaves.groupBy("group").agg(F.count(F.lit(1)).alias("n")).withColumn("one", F.lit(1))
    trees = running_totals(counts, [F.col("group")], ["n", "one"])
    trees = small_side(trees.select(F.col("group").alias("_group"), F.col("one_before").alias("tree"), "n", F.col("n_before").alias("first")))
    ranged = running_totals(leaves, [F.col("group"), F.col("key"), F.col("leaf"), F.col("row")], ["one"])
    superblock = FAN**block_levels
    placed = ranged.join(trees, F.col("group").eqNullSafe(F.col("_group"))).withColumn("pos", F.col("one_before") - F.col("first"))
    placed = placed.withColumn("block", F.floor(F.col("pos") / superblock))
    # Small groups share a task: superblocks that begin in the same stretch of the global order, fewer than two superblocks of rows.
    bundle = F.floor((F.col("first") + F.col("block") * superblock) / superblock)
    placed = materialise(placed.select("tree", "n", "pos", "block", bundle.alias("bundle"), "key", "leaf", "changed"), "placed")

    tops = placed.select("tree", F.col("pos").alias("place"), F.col("leaf").alias("node"), F.col("n").alias("width"))
    for _ in range(block_levels):
        tops = _parents(tops).select("tree", "place", "node", "width")
    subroots, levels = _grow(tops, "outer")
    width = subroots.count()
    roots, upper = _grow(subroots.select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("place"), "node", F.lit(width).cast("bigint").alias("width")), "groups")
    none = {"siblings": F.array().cast("array<string>"), "spots": F.array().cast("array<int>"), "sizes": F.array().cast("array<int>")}
    top = roots.select("tree", F.lit(0).cast("bigint").alias("place"), F.col("node").alias("root")).withColumns(none)
    over = _descend(top, upper).drop("tree").withColumnRenamed("place", "tree")
    over = over.join(subroots.withColumnRenamed("node", "subroot"), "tree").withColumn("place", F.lit(0).cast("bigint"))
    outer = _descend(over, levels).withColumnRenamed("place", "block").join(trees.select("tree", "first"), "tree").withColumn("bundle", bundle)

    digests = [T.StructField(c, T.StringType()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")]
    schema = T.StructType([T.StructField(key, rows.schema[key].dataType), *digests])
    if with_siblings:
        schema = schema.add("siblings", T.ArrayType(T.StringType()))
    needed = outer.select("bundle", "tree", "block", "subroot", "root", "siblings", "spots", "sizes")
    proved = placed.groupBy("bundle").cogroup(needed.groupBy("bundle")).applyInPandas(_prover(key, block_levels, with_siblings), schema)
    return proved.withColumn("verified", F.col("folded_root") == F.col("root"))
