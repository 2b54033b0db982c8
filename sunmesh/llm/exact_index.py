"""Exact duplicates by an extendible-hash index on shared files. DataFrame functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sunmesh.operators.sizing import small_side
from sunmesh.sources.tables import materialise

#: Distinct hashes that a bucket holds before it is split.
BUCKET_KEYS = 4096
#: Bits that a bucket may need beyond those of an even split.
SPARE_BITS = 8


def normalised(text: Column) -> Column:
    """The text without any character of ``[\\x20\\x09-\\x0D]``; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\x0c\r", "")


def _slot(depth: int) -> Column:
    """The hash's first ``depth`` bits; none are a column like others, too, so that joins on it stay joins on a key."""
    return F.shiftrightunsigned(F.shiftrightunsigned("hash", 1), 63 - depth)


def directory(entries: DataFrame, bucket_keys: int = BUCKET_KEYS, spare_bits: int = SPARE_BITS) -> tuple[DataFrame, int]:
    """``slot, depth, bucket`` for every slot in use, and the directory's depth.

    The directory doubles until no bucket holds more than ``bucket_keys``
    distinct hashes; a bucket keeps the fewest bits that suffice, so several
    slots may share one. Copies have one hash and can't overfill a bucket.
    The directory may be ``spare_bits`` deeper than an even split of the hashes
    needs; a bucket that is overfull even then stays so, which costs time, not rows.
    """
    keys = materialise(entries.select("hash").distinct(), "hashes")
    total = keys.count()
    depth = max(0, math.ceil(math.log2(max(1, total / bucket_keys))))
    deepest = depth + spare_bits
    counted = materialise(keys.groupBy(_slot(deepest).alias("cell")).agg(F.count("*").alias("keys")), "cells")
    while depth < deepest:
        halved = counted.groupBy(F.shiftright("cell", deepest - depth).alias("slot")).agg(F.sum("keys").alias("keys"))
        if halved.filter(F.col("keys") > bucket_keys).isEmpty():
            break
        depth += 1
    # Every prefix of a slot is a possible bucket; the shortest one that isn't overfull is its bucket.
    prefixes = counted.select("keys", F.shiftright("cell", deepest - depth).alias("slot"))
    prefixes = prefixes.groupBy("slot").agg(F.sum("keys").alias("keys"))
    possible = prefixes.select("slot", "keys", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("depth"))
    possible = possible.withColumn("bucket", F.expr(f"shiftright(slot, {depth} - depth)"))
    full = possible.groupBy("depth", "bucket").agg(F.sum("keys").alias("keys"))
    fit = full.filter((F.col("keys") <= bucket_keys) | (F.col("depth") == depth)).select("depth", "bucket")
    chosen = possible.drop("keys").join(fit, ["depth", "bucket"]).groupBy("slot").agg(F.min(F.struct("depth", "bucket")).alias("b"))
    return chosen.select("slot", "b.depth", "b.bucket"), depth


@dataclass(frozen=True)
class ExactIndex:
    """The directory (``slot, depth, bucket``), its depth, and the stored buckets' entries."""

    slots: DataFrame
    depth: int
    #: ``depth, bucket, hash, chain, text_sha256, group_size, keep_id, keep_row``, sorted by bucket.
    buckets: DataFrame


def hashed_rows(docs: DataFrame) -> DataFrame:
    """Store what the index needs of each row: ``row, doc_id, points, hash, text_sha256``."""
    clean = normalised(F.col("text"))
    rows = docs.select(
        "doc_id",
        F.length(F.coalesce("text", F.lit(""))).alias("points"),
        F.xxhash64(clean).alias("hash"),
        F.sha2(F.encode(clean, "UTF-8"), 256).alias("text_sha256"),
    )
    return materialise(rows.withColumn("row", F.monotonically_increasing_id()), "entries")


def build_index(docs: DataFrame, entries: DataFrame, bucket_keys: int = BUCKET_KEYS) -> ExactIndex:
    """Store the index of ``docs``, whose rows are ``entries``: one entry per distinct normalised text, with the row that stays.

    Texts reach the owner of their key as groups that every task has already
    merged, so copies don't travel; equal hashes are told apart by the texts'
    bytes. The directory gives each entry its bucket; within a bucket, entries
    of one hash are chained (``chain`` counts from 0). The files are
    range-partitioned by bucket and hash, so that a bucket lies in one place.
    """
    texts = docs.select(normalised(F.col("text")).alias("bytes")).withColumn("hash", F.xxhash64("bytes"))
    # Grouping compares the whole texts, not only their hashes.
    merged = texts.groupBy("hash", "bytes").agg(F.count("*").alias("group_size"))
    chained = materialise(merged.select("hash", F.sha2(F.encode("bytes", "UTF-8"), 256).alias("text_sha256"), "group_size"), "chains")
    best = F.min(F.struct((-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("row").alias("r")))
    stays = entries.groupBy("hash", "text_sha256").agg(best.alias("best"))
    slots, depth = directory(chained, bucket_keys)
    slots = materialise(slots, "directory")
    placed = chained.join(stays, ["hash", "text_sha256"]).withColumn("slot", _slot(depth)).join(small_side(slots), "slot")
    # Several texts with one hash are a chain; its order is that of their digests.
    within = Window.partitionBy("depth", "bucket", "hash").orderBy("text_sha256")
    opened = placed.withColumn("chain", F.row_number().over(within) - 1)
    opened = opened.select("depth", "bucket", "hash", "chain", "text_sha256", "group_size", F.col("best.d").alias("keep_id"), F.col("best.r").alias("keep_row"))
    return ExactIndex(slots, depth, materialise(opened, "exact-index", cluster_by=("depth", "bucket", "hash")))


def look_up(entries: DataFrame, index: ExactIndex) -> DataFrame:
    """``entries`` with the index entry of their text: the directory names the bucket, the bucket's chain is searched for the text."""
    addressed = entries.withColumn("slot", _slot(index.depth)).join(small_side(index.slots), "slot").drop("slot")
    # The right side has one row per text; a text with very many copies is split by adaptive execution.
    return addressed.join(index.buckets, ["depth", "bucket", "hash", "text_sha256"])


def exact_groups(docs: DataFrame, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """One row per document (``doc_id, text``): the document that stays for its text, and whether it is this one.

    Texts are equal if identical after deleting ASCII white space. Of equal
    texts the one with the most code points in the original stays, then the
    smallest ``doc_id``; of rows that repeat a ``doc_id`` and a text's length
    exactly one is kept. A null ``doc_id`` stays only if no other can. Empty and
    null texts are equal to one another. No documents give no rows.
    """
    entries = hashed_rows(docs)
    found = look_up(entries, build_index(docs, entries, bucket_keys))
    return found.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")
