"""A trie of conversations' shared beginnings, from sorted sequences and their longest common prefixes.

A turn is its digest. Sequences are cut where they stop being shared (from a
turn that no other conversation has at its place, the rest is a chain of its
own), grouped, and sorted over the whole table into blocks. Inside a block a
sparse table answers range minima over the common prefixes (LCPs) of
neighbours: each candidate prefix searches its left and its right end by
halving steps, independently of all others. What reaches a block's border is
looked up in one short summary per block. Intervals give members; the nodes in
preorder, with running totals, give what belongs to subtrees.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunmesh.llm.common import bounded_batches, running_totals
from sunmesh.sources.tables import materialise

#: Bytes of a turn's digest.
WIDTH = 16
#: Distinct sequences of a block, on average.
BLOCK_KEYS = 20_000
#: Ids of one piece of a list of ends: those that agree in all but so many low bits.
PIECE_BITS = 16

NODES = (
    "l bigint, depth bigint, end bigint, n_convs bigint, conv_id bigint, parent_l bigint, parent_conv_id bigint, last_bytes bigint, n_tails bigint, key binary"
)
SUMMARY = "block int, low bigint, total bigint, least bigint, right_at array<bigint>, right_low array<bigint>, right_total array<bigint>, right_least array<bigint>, left_at array<bigint>, left_low array<bigint>, left_least array<bigint>"


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, p, digest, n_bytes``: each conversation's turns, counted from 0 by ``turn`` (null first, ties by digest).

    Null roles and texts become empty; rows without ``conv_id`` belong to no
    conversation and are left out. Places come from one global order, so a
    conversation may have any number of turns.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * WIDTH)
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", digest.alias("digest"), F.octet_length(text).cast("bigint").alias("n_bytes")
    )
    stored = materialise(turns.withColumns({"row": F.monotonically_increasing_id(), "one": F.lit(1)}), "turns")
    placed = running_totals(stored, [F.col(c) for c in ("conv_id", "turn", "digest", "row")], ["one"])
    placed = materialise(placed.select("conv_id", "digest", "n_bytes", F.col("one_before").alias("g")), "placed-turns")
    first = placed.groupBy("conv_id").agg(F.min("g").alias("first"))
    return placed.join(first, "conv_id").select("conv_id", (F.col("g") - F.col("first")).alias("p"), "digest", "n_bytes")


def branched(turns: DataFrame, taken: Column, base: Column) -> tuple[DataFrame, DataFrame]:
    """Conversations as branches: the first ``taken`` turns of conversation ``base``, then the own turns after the first ``taken``.

    ``taken`` and ``base`` are columns over ``conv_id``. Gives the turns
    (``conv_id, p, digest, n_bytes``) and all conversations with their number
    of turns (``conv_id, len``), those without turns too. Few conversations
    should share a base: each of them copies its first turns.
    """
    turns = materialise(turns, "own-turns")
    counts = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    convs = counts.select("conv_id", "n", taken.cast("bigint").alias("h"), base.alias("base"))
    of_base = counts.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    kept = F.least("h", F.coalesce("n_base", F.lit(0)))
    convs = convs.join(of_base, "base", "left").withColumns({"kept": kept, "len": kept + F.greatest(F.col("n") - F.col("h"), F.lit(0))})
    convs = materialise(convs, "branches")
    own = turns.join(convs.select("conv_id", "h", "kept"), "conv_id").filter("p >= h")
    own = own.select("conv_id", (F.col("p") - F.col("h") + F.col("kept")).alias("p"), "digest", "n_bytes")
    longest = convs.agg(F.max("kept")).first()[0] or 0
    heads = turns.filter(F.col("p") < longest).withColumnRenamed("conv_id", "base")
    heads = heads.join(convs.select("conv_id", "base", "kept"), "base").filter("p < kept")
    return own.union(heads.select("conv_id", "p", "digest", "n_bytes")), convs.select("conv_id", "len")


def _sparse(values: np.ndarray) -> list[np.ndarray]:
    """Minima of all stretches of 1, 2, 4, ... values, by where they begin."""
    table = [values]
    while 2 << (len(table) - 1) <= len(values):
        half = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))
    return table


def _first_below(table: list[np.ndarray], start: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The first place from ``start`` on with a value below ``depth``; the length if there is none."""
    n, at = len(table[0]), start.copy()
    for k in reversed(range(len(table))):
        fits = at + (1 << k) <= n
        at = np.where(fits & (table[k][np.where(fits, at, 0)] >= depth), at + (1 << k), at)
    return at


def _last_below(table: list[np.ndarray], start: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The last place up to ``start`` with a value below ``depth``; -1 if there is none."""
    at = start.copy()
    for k in reversed(range(len(table))):
        begin = at - (1 << k) + 1
        at = np.where((begin >= 0) & (table[k][np.maximum(begin, 0)] >= depth), begin - 1, at)
    return at


def _least(table: list[np.ndarray], begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Minima of ``[begin, end)``, each not empty."""
    power = np.frexp((end - begin).astype(float))[1] - 1
    found = np.empty(len(begin), dtype=table[0].dtype)
    for k in np.unique(power):
        mine = power == k
        found[mine] = np.minimum(table[k][begin[mine]], table[k][end[mine] - (1 << k)])
    return found


def _common(a: bytes, b: bytes) -> int:
    """Turns that two sequences have in common from the start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // WIDTH
    differs = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
    return int(differs.argmax()) // WIDTH


def _sorted_block(block: pd.DataFrame, before: bytes | None) -> tuple[pd.DataFrame, np.ndarray]:
    """The block's sequences in order, and the LCP of each with the one before it (-1 for the very first)."""
    block = block.sort_values("key", kind="stable").reset_index(drop=True)
    keys = block["key"].map(bytes).tolist()
    lcps = [-1 if before is None else _common(before, keys[0]), *(_common(a, b) for a, b in zip(keys, keys[1:]))]
    return block, np.array(lcps, dtype=np.int64)


def _steps(lcps: np.ndarray) -> np.ndarray:
    """Places at which the running minimum falls; not more than the first LCP and two."""
    running = np.minimum.accumulate(lcps)
    return np.flatnonzero(np.r_[True, running[1:] < running[:-1]])


def _summarise(before: dict[int, bytes | None]):
    def summarise(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        block, lcps = _sorted_block(block, before[key[0]])
        total, least = np.r_[0, block["n_convs"].cumsum()], np.minimum.accumulate(block["conv_id"].to_numpy())
        right, left = _steps(lcps), len(lcps) - 1 - _steps(lcps[::-1])
        from_end = np.minimum.accumulate(block["conv_id"].to_numpy()[::-1])[::-1]
        most = np.iinfo(np.int64).max
        return pd.DataFrame([(
            key[0], lcps.min(), total[-1], least[-1],
            right, lcps[right], total[right], np.where(right > 0, least[right - 1], most),
            left, lcps[left], from_end[left],
        )], columns=[c.split()[0] for c in SUMMARY.split(", ")])

    return summarise


class Borders:
    """What lies left and right of a block: where an interval that is open at its border ends, and its members there."""

    def __init__(self, blocks: list[dict]):
        self.blocks, self.at = blocks, {b["block"]: i for i, b in enumerate(blocks)}
        self.low = np.array([b["low"] for b in blocks])

    def right(self, block: int, depth: int) -> tuple[int, int, int]:
        """End (the place behind), members and smallest member of the blocks behind ``block``."""
        after = self.at[block] + 1
        below = np.flatnonzero(self.low[after:] < depth)
        stop = after + int(below[0]) if len(below) else len(self.blocks)
        total = sum(b["total"] for b in self.blocks[after:stop])
        least = min((b["least"] for b in self.blocks[after:stop]), default=np.iinfo(np.int64).max)
        if stop == len(self.blocks):
            return self.blocks[-1]["start"] + self.blocks[-1]["n"], total, least
        last = self.blocks[stop]
        step = next(i for i, low in enumerate(last["right_low"]) if low < depth)
        return last["start"] + last["right_at"][step], total + last["right_total"][step], min(least, last["right_least"][step])

    def left(self, block: int, depth: int) -> tuple[int, int]:
        """Begin and smallest member of the blocks before ``block``."""
        before = self.at[block]
        stop = int(np.flatnonzero(self.low[:before] < depth)[-1])
        first = self.blocks[stop]
        step = next(i for i, low in enumerate(first["left_low"]) if low < depth)
        least = min((b["least"] for b in self.blocks[stop + 1 : before]), default=np.iinfo(np.int64).max)
        return first["start"] + first["left_at"][step], min(least, first["left_least"][step])


def _intervals(at: np.ndarray, depth: np.ndarray, lcps: list[np.ndarray], least: list[np.ndarray], totals: np.ndarray, block: int, start: int, borders: Borders):
    """Begin, end, members and smallest member of the prefixes of ``depth`` turns of the sequences ``at``."""
    n = len(lcps[0])
    left, right = _last_below(lcps, at, depth), _first_below(lcps, at + 1, depth)
    inside = np.maximum(left, 0)
    found = [inside + start, right + start, totals[right] - totals[inside], _least(least, inside, right)]
    begins, ends = {}, {}
    for i in np.flatnonzero(left < 0):
        d = int(depth[i])
        begins[d] = begins.get(d) or borders.left(block, d)
        found[0][i], found[3][i] = begins[d][0], min(found[3][i], begins[d][1])
    for i in np.flatnonzero(right == n):
        d = int(depth[i])
        ends[d] = ends.get(d) or borders.right(block, d)
        found[1][i], found[2][i], found[3][i] = ends[d][0], found[2][i] + ends[d][1], min(found[3][i], ends[d][2])
    return found


def _find_nodes(before: dict[int, bytes | None], borders: Borders):
    def find(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        block, lcp = _sorted_block(block, before[key[0]])
        start = borders.blocks[borders.at[key[0]]]["start"]
        length = block["key"].map(len).to_numpy() // WIDTH
        lcps, least, totals = _sparse(lcp), _sparse(block["conv_id"].to_numpy()), np.r_[0, block["n_convs"].cumsum()]
        # Candidates: what a sequence has beyond the one before it, and the prefix it shares, which is their parent.
        shared = np.maximum(lcp, 0)
        count = length - shared + 1
        at = np.repeat(np.arange(len(block)), count)
        depth = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count) + shared[at]
        begin, end, members, smallest = _intervals(at, depth, lcps, least, totals, key[0], start, borders)
        sizes = np.concatenate([np.r_[0, s][f:] for s, f in zip(block["sizes"], shared)])
        last = depth == length[at]
        nodes = pd.DataFrame({
            "l": begin, "depth": depth, "end": end, "n_convs": members, "conv_id": smallest,
            "parent_l": np.r_[0, begin[:-1]], "parent_conv_id": pd.Series(np.r_[0, smallest[:-1]], dtype="Int64"), "last_bytes": sizes,
            "n_tails": np.where(last, block["n_tails"].to_numpy()[at], 0),
            "key": np.where(last, block["key"].to_numpy()[at], None),
        })
        nodes.loc[depth == 0, "parent_conv_id"] = pd.NA
        return nodes[depth > lcp[at]]

    return find


def _nodes(groups: DataFrame, block_keys: int) -> DataFrame:
    """All nodes of the trie of ``groups`` (``key, sizes, n_convs, conv_id, n_tails``), with their intervals in the sorted keys."""
    spark = groups.sparkSession
    n_blocks = groups.count() // block_keys + spark.sparkContext.defaultParallelism
    blocks = materialise(groups.repartitionByRange(n_blocks, "key").withColumn("block", F.spark_partition_id()), "blocks")
    # One row per block comes to the driver: its size, its last key, and its steps, not more than that key is long.
    sizes = sorted(blocks.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.max("key").alias("last")).collect())
    before = dict(zip((r["block"] for r in sizes), [None, *(bytes(r["last"]) for r in sizes)]))
    starts = dict(zip((r["block"] for r in sizes), np.cumsum([0, *(r["n"] for r in sizes)]).tolist()))
    found = blocks.groupBy("block").applyInPandas(_summarise(before), SUMMARY).collect()
    held = {r["block"]: r["n"] for r in sizes}
    summary = [r.asDict() | {"start": starts[r["block"]], "n": held[r["block"]]} for r in sorted(found, key=lambda r: r["block"])]
    return blocks.groupBy("block").applyInPandas(_find_nodes(before, Borders(summary)), NODES)


def _hash_lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One digest for each run of rows with the same key; a list may be longer than a batch, and than memory."""
    key, state = None, None
    for batch in batches:
        done = []
        for k, ids in zip(batch["key"].map(bytes), batch["ids"]):
            if state is not None and k == key:
                state.update(b"," + ids.encode())
                continue
            if state is not None:
                done.append((key, state.hexdigest()))
            key, state = k, hashlib.sha256(ids.encode())
        yield pd.DataFrame(done, columns=["key", "ends_sha256"])
    if state is not None:
        yield pd.DataFrame([(key, state.hexdigest())], columns=["key", "ends_sha256"])


def _ends(seqs: DataFrame, piece_bits: int) -> DataFrame:
    """``key, ends_sha256`` of the conversations that end with their key: lists by id, in pieces that are hashed one after another."""
    ended = seqs.filter("len = shared").groupBy("key", F.shiftright("conv_id", piece_bits).alias("piece"))
    pieces = ended.agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    return pieces.repartition("key").sortWithinPartitions("key", "piece").select("key", "ids").mapInPandas(_hash_lists, "key binary, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame, block_keys: int = BLOCK_KEYS, piece_bits: int = PIECE_BITS) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    ``turns`` has ``conv_id, p, digest, n_bytes`` (``p`` from 0 on), ``convs``
    each conversation once with its number of turns ``len``. A node is a
    distinct beginning; the root has depth 0 and every conversation. A
    conversation without turns ends at the root. No conversations give no
    nodes. Digests of 128 bits stand for turns.

    A turn that is alone at its place cuts its conversation: what follows is a
    chain without further members, so only shared beginnings become sequences,
    and a conversation of very many turns is never one value. A list of ends is
    hashed by one task, since SHA-256 has one order, but in pieces.
    """
    bounded_batches(turns.sparkSession)
    turns = materialise(turns.select("conv_id", "p", "digest", "n_bytes"), "trie-turns")
    alone = turns.groupBy("p", "digest").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id")).filter("n = 1")
    cuts = alone.groupBy("conv_id").agg(F.min("p").alias("cut"))
    convs = materialise(convs.join(cuts, "conv_id", "left").select("conv_id", "len", F.coalesce("cut", "len").alias("shared")), "cuts")
    parted = turns.join(convs, "conv_id")
    listed = parted.filter("p < shared").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("p", "digest", "n_bytes"))).alias("_t"))
    listed = listed.select("conv_id", F.unhex(F.array_join("_t.digest", "")).alias("key"), F.col("_t.n_bytes").alias("sizes"))
    keyed = convs.join(listed, "conv_id", "left")
    seqs = keyed.select("conv_id", "len", "shared", F.coalesce("key", F.unhex(F.lit(""))).alias("key"), F.coalesce("sizes", F.array().cast("array<bigint>")).alias("sizes"))
    seqs = materialise(seqs, "sequences")
    tails = F.count_if(F.col("len") > F.col("shared")).alias("n_tails")
    groups = materialise(seqs.groupBy("key").agg(F.first("sizes").alias("sizes"), F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), tails), "keys")

    nodes = materialise(_nodes(groups, block_keys), "nodes")
    children = nodes.filter("depth > 0").groupBy(F.col("parent_l").alias("l"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("below"))
    nodes = nodes.join(children, ["l", "depth"], "left").withColumn("n_children", F.coalesce("below", F.lit(0)) + F.col("n_tails"))
    own = {"leaves": F.col("n_tails") + (F.col("n_children") == 0).cast("bigint"), "saved": (F.col("n_convs") - 1) * F.col("last_bytes")}
    before = running_totals(nodes.withColumns(own).drop("below", "parent_l"), [F.col("l"), F.col("depth")], ["leaves", "saved"])
    before = materialise(before, "preorder")
    # In preorder a subtree reaches up to the last node of the last sequence of its interval.
    upto = before.groupBy((F.col("l") + 1).alias("end")).agg(*(F.max(F.col(f"{c}_before") + F.col(c)).alias(f"{c}_upto") for c in own))
    shared = before.join(upto, "end").join(_ends(seqs, piece_bits), "key", "left")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    shared = shared.withColumns({
        "n_leaves": F.col("leaves_upto") - F.col("leaves_before"), "saved_tokens": F.col("saved_upto") - F.col("saved_before"),
        "ends_sha256": F.coalesce("ends_sha256", nothing),
    }).select(columns)

    last = F.col("depth") == F.col("len")
    alone = {
        "n_convs": F.lit(1).cast("bigint"), "n_children": F.when(last, 0).otherwise(1).cast("bigint"), "n_leaves": F.lit(1).cast("bigint"),
        "saved_tokens": F.lit(0).cast("bigint"), "ends_sha256": F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(nothing),
    }
    tops = before.filter(F.col("key").isNotNull()).select("key", F.col("conv_id").alias("parent_conv_id"))
    first = seqs.filter("len > shared").join(tops, "key").withColumn("depth", F.col("shared") + 1)
    rest = parted.filter("p > shared").withColumns({"parent_conv_id": F.col("conv_id"), "depth": F.col("p") + 1})
    return shared.union(first.withColumns(alone).select(columns)).union(rest.withColumns(alone).select(columns))
