"""Token ids in binary shards, each compressed by its own Re-Pair grammar.

A shard holds about a million ids of consecutive documents. Pairs of symbols
that occur often are replaced by a new symbol, round after round; a round takes
all frequent pairs at once, most frequent first. Pairs never cross documents, so
each document, and by the stored expansion lengths any range inside it, is
decoded on its own.

Layout: a Parquet folder with one row per shard, so Spark commits, re-runs and
finds shards; the columns are little-endian binary arrays:

``part, shard``       place in the global order (range partition, then number)
``part_start``        ids of the part before this shard
``doc_ids``           document ids in order (null allowed)
``token_ends``        int64: ids up to and with each document
``symbol_ends``       int64: symbols up to and with each document
``terminals``         uint32: id of symbol 0, 1, ...
``rules``             uint32 pairs: left and right of the next symbols
``lengths``           uint32: number of ids that each symbol expands to
``symbols``           the documents' symbols, uint16 or uint32 by ``wide``
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sunmesh.llm.common import bounded_batches
from sunmesh.llm.encoding import REMEMBERED, STEP, VOCABULARY, encoder

SHARD_IDS = 1 << 20
#: Rules of one round, and the uses that a pair needs; rounds go on until no pair has them.
RULES, USES = 4096, 6
#: Pairs are sorted as 64-bit numbers from so many symbols on: the rules of a round may need more than 16 bits.
WIDE_FROM = (1 << 16) - RULES

SHARD_SCHEMA = (
    "part int, shard int, part_start bigint, n_docs int, n_tokens bigint, first_doc bigint, last_doc bigint, doc_ids array<bigint>,"
    " token_ends binary, symbol_ends binary, terminals binary, rules binary, lengths binary, wide boolean, symbols binary"
)


def repair(ids: np.ndarray, ends: np.ndarray) -> dict:
    """Compress ``ids``; ``ends`` are the documents' last positions plus one, in order.

    Symbols are 16 bits wide until there are more of them, then 32 (``wide``).
    """
    used = np.zeros(int(ids.max()) + 1 if len(ids) else 0, bool)
    used[ids] = True
    terminals = np.flatnonzero(used).astype(np.uint32)
    names = np.cumsum(used) - 1
    s = names[ids].astype(np.uint32)
    last = np.zeros(len(s), bool)
    last[ends[ends > 0] - 1] = True
    total, rules, shift = len(terminals), [], None
    lengths = np.ones(total, np.uint32)
    while len(s) > 1:
        wide = total > WIDE_FROM
        if shift is None or wide != (kind is np.uint64):
            shift, kind = (np.uint64(32), np.uint64) if wide else (np.uint32(16), np.uint32)
            new_from, waiting = 0, np.zeros(1 << 16, bool)
        # Only pairs with a symbol of the last round can have become frequent; those that waited are told by their slots.
        near = ~last[:-1]
        if new_from:
            new = s >= new_from
            new = new[:-1] | new[1:]
            if waiting.any():
                new |= waiting[_slots((s[:-1].astype(kind) << shift) | s[1:].astype(kind))]
            near &= new
        place = np.flatnonzero(near)
        key = (s[place].astype(kind) << shift) | s[place + 1].astype(kind)
        ordered = np.sort(key)
        if not len(ordered):
            break
        begin = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        count = np.diff(np.concatenate([begin, [len(ordered)]]))
        often = np.flatnonzero(count >= USES)
        if not len(often):
            break
        pick = often[np.lexsort((ordered[begin[often]], -count[often]))][:RULES]
        pairs = ordered[begin[pick]]
        # One pair per slot: the rarer of two that meet waits for the next round.
        slot = _slots(pairs)
        owner = np.full(1 << 16, -1, np.int64)
        owner[slot[::-1]] = np.arange(len(pairs))[::-1]
        won = np.flatnonzero(owner[slot] == np.arange(len(pairs)))
        pairs = pairs[won]
        owner = np.full(1 << 16, -1, np.int32)
        owner[slot[won]] = np.arange(len(won))
        waiting = np.zeros(1 << 16, bool)
        waiting[_slots(ordered[begin[np.setdiff1d(often, pick[won], assume_unique=True)]])] = True
        rule = owner[_slots(key)]
        hit = np.flatnonzero(rule >= 0)
        hit = hit[pairs[rule[hit]] == key[hit]]
        at, rule = place[hit], rule[hit]
        # Of matches that overlap, every other one counts, from the left.
        run = np.concatenate([[True], np.diff(at) != 1]) if len(at) else np.zeros(0, bool)
        index = np.arange(len(at))
        every = (index - np.maximum.accumulate(np.where(run, index, 0))) % 2 == 0
        at, rule = at[every], rule[every]
        s[at] = (total + rule).astype(np.uint32)
        last[at] = last[at + 1]
        keep = np.ones(len(s), bool)
        keep[at + 1] = False
        s, last = s[keep], last[keep]
        mask = kind((1 << int(shift)) - 1)
        rules.append(np.stack([(pairs >> shift).astype(np.uint32), (pairs & mask).astype(np.uint32)], 1))
        lengths = np.concatenate([lengths, lengths[rules[-1]].sum(axis=1, dtype=np.uint32)])
        new_from, total = total, total + len(pairs)
    rules = np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)
    wide = total > 1 << 16
    filled = np.flatnonzero(last) + 1
    symbol_ends = np.zeros(len(ends), np.int64)
    # Documents without ids end where the one before them ends.
    symbol_ends[np.diff(np.concatenate([[0], ends])) > 0] = filled
    symbol_ends = np.maximum.accumulate(symbol_ends) if len(symbol_ends) else symbol_ends
    return {"terminals": terminals, "rules": rules, "lengths": lengths, "symbols": s if wide else s.astype(np.uint16), "symbol_ends": symbol_ends, "wide": wide}


def _slots(pairs: np.ndarray) -> np.ndarray:
    if pairs.dtype == np.uint32:
        return (pairs * np.uint32(2654435769)) >> np.uint32(16)
    return (pairs * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)


def expansions(n_terminals: int, rules: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every symbol: how many terminals it stands for; these, one after the other; and where its own begin."""
    s = np.arange(n_terminals + len(rules), dtype=np.int64)
    owner = s.copy()
    while True:
        inner = s >= n_terminals
        if not inner.any():
            break
        times = 1 + inner.astype(np.int64)
        place = np.cumsum(times) - times
        grown = np.repeat(s, times)
        pair = rules[s[inner] - n_terminals]
        grown[place[inner]], grown[place[inner] + 1] = pair[:, 0], pair[:, 1]
        s, owner = grown, np.repeat(owner, times)
    lengths = np.bincount(owner, minlength=n_terminals + len(rules)).astype(np.uint32)
    return lengths, s, np.cumsum(lengths, dtype=np.int64) - lengths


class Shard:
    """A stored shard. Ranges are decoded without what lies around them."""

    def __init__(self, row: dict):
        self.terminals = np.frombuffer(row["terminals"], "<u4")
        self.rules = np.frombuffer(row["rules"], "<u4").reshape(-1, 2)
        self.lengths = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
        self.symbols = np.frombuffer(row["symbols"], "<u4" if row["wide"] else "<u2")
        self.token_ends = np.frombuffer(row["token_ends"], "<i8")
        self.symbol_ends = np.frombuffer(row["symbol_ends"], "<i8")
        self.doc_ids = row["doc_ids"]

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        if not hasattr(self, "flat"):
            _, self.flat, self.offset = expansions(len(self.terminals), self.rules)
        lengths = self.lengths[symbols]
        before = np.cumsum(lengths) - lengths
        where = np.repeat(self.offset[symbols] - before, lengths) + np.arange(int(lengths.sum()))
        return self.terminals[self.flat[where]]

    def ids(self) -> np.ndarray:
        """All ids of the shard."""
        return self._expand(self.symbols)

    def document(self, number: int, begin: int = 0, end: int | None = None) -> np.ndarray:
        """Ids ``begin`` to ``end`` of one document: only the symbols that cover them are expanded."""
        own = self.symbols[self.symbol_ends[number - 1] if number else 0 : self.symbol_ends[number]]
        reach = np.cumsum(self.lengths[own])
        size = int(reach[-1]) if len(own) else 0
        begin, end = min(begin, size), size if end is None else min(end, size)
        if begin >= end:
            return np.zeros(0, np.uint32)
        first, after = np.searchsorted(reach, begin, "right"), np.searchsorted(reach, end, "left") + 1
        skipped = int(reach[first - 1]) if first else 0
        return self._expand(own[first:after])[begin - skipped : end - skipped]


def _encode_shards(vocabulary: str, end_id: int, shard_ids: int, remembered: int = REMEMBERED):
    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encode = encoder(vocabulary, remembered).encode
        docs, pieces, counts, held, shard, start = [], [], [], 0, 0, 0

        def flush():
            nonlocal docs, pieces, counts, held, shard, start
            ids, ends = np.concatenate(pieces), np.cumsum(np.concatenate(counts))
            found = repair(ids, ends)
            known = [d for d in docs if d is not None]
            row = {
                "part": part, "shard": shard, "part_start": start, "n_docs": len(docs), "n_tokens": len(ids),
                "first_doc": min(known, default=None), "last_doc": max(known, default=None), "doc_ids": docs,
                "token_ends": ends.astype("<i8").tobytes(), "wide": found["wide"],
                **{k: found[k].astype(t).tobytes() for k, t in (("symbol_ends", "<i8"), ("terminals", "<u4"), ("rules", "<u4"), ("lengths", "<u4"), ("symbols", "<u4" if found["wide"] else "<u2"))},
            }
            start, shard = start + len(ids), shard + 1
            docs, pieces, counts, held = [], [], [], 0
            return pa.RecordBatch.from_pylist([row], schema=_ARROW)

        for batch in batches:
            texts, names = batch.column("text"), batch.column("doc_id").to_pylist()
            for i in range(0, len(texts), STEP):
                ids, n = encode(texts.slice(i, STEP))
                ends = np.cumsum(n)
                pieces.append(np.insert(ids, ends, end_id))
                counts.append(n + 1)
                docs += names[i : i + STEP]
                held += len(pieces[-1])
                if held >= shard_ids:
                    yield flush()
        if docs:
            yield flush()

    return run


_ARROW = pa.schema(
    [("part", pa.int32()), ("shard", pa.int32()), ("part_start", pa.int64()), ("n_docs", pa.int32()), ("n_tokens", pa.int64()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("doc_ids", pa.list_(pa.int64()))]
    + [(k, pa.binary()) for k in ("token_ends", "symbol_ends", "terminals", "rules", "lengths")] + [("wide", pa.bool_()), ("symbols", pa.binary())]
)


def write_grammar(
    docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int = 2, shard_ids: int = SHARD_IDS, remembered: int = REMEMBERED
) -> str:
    """Encode ``docs`` (``doc_id``, ``text``) and write grammar shards to ``path`` in ascending ``doc_id``.

    One range shuffle puts documents in order; equal ids are told apart by a
    hash of their text and a number, so a repeated row doesn't fill one partition. Null ids
    come first; null and empty texts are the end id alone; no documents give a
    folder without shards. Other columns are ignored. A worker knows about ``remembered`` words at
    most before it starts again: fewer take less memory and more time, and give the same ids.
    """
    bounded_batches(docs.sparkSession)
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumns({"_tie": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    ordered = keyed.repartitionByRange("doc_id", "_tie", "_row").sortWithinPartitions("doc_id", "_tie", "_row")
    shards = ordered.select("doc_id", "text").mapInArrow(_encode_shards(vocabulary, end_id, shard_ids, remembered), SHARD_SCHEMA)
    shards.write.mode("errorifexists").parquet(path)
    return path


def _digests(batches):
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            shard = Shard(row)
            ids = shard.ids().astype("<u4")
            begins = np.concatenate([[0], shard.token_ends])
            data = memoryview(ids.view(np.uint8))
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(begins, begins[1:])]
            out.append((row["doc_ids"], begins[:-1] + row["offset"], np.diff(begins), crc))
        for names, starts, sizes, crc in out:
            columns = [pa.array(names, pa.int64()), pa.array(starts), pa.array(sizes), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])


def _located(spark: SparkSession, path: str) -> DataFrame:
    """The shards with ``offset``, the number of ids in all earlier shards."""
    shards = spark.read.parquet(path)
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("ids"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = totals.select("part", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("before"))
    # One row per task that wrote shards.
    return shards.join(F.broadcast(parts), "part").withColumn("offset", F.col("part_start") + F.col("before")).drop("before")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per stored document: ``doc_id``, ``start``, ``n_tokens`` and the crc32 of its ids, decoded from the files."""
    bounded_batches(spark)
    wanted = ["doc_ids", "token_ends", "symbol_ends", "terminals", "rules", "lengths", "wide", "symbols", "offset"]
    return _located(spark, path).select(*wanted).mapInArrow(_digests, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def _decode(batches):
    for batch in batches:
        for row in batch.to_pylist():
            shard = Shard(row)
            ids, ends = shard.ids(), shard.token_ends
            columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(np.split(ids.astype(np.int32), ends[:-1]), pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids"])


def _decode_range(doc_id: int, begin: int, end: int | None):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row)
                found = [shard.document(i, begin, end).astype(np.int32) for i, d in enumerate(row["doc_ids"]) if d == doc_id]
                yield pa.RecordBatch.from_arrays([pa.array([doc_id] * len(found), pa.int64()), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def read_ids(spark: SparkSession, path: str, doc_id: int | None = None, begin: int = 0, end: int | None = None) -> DataFrame:
    """Stored documents as ``doc_id`` and ``ids``.

    With ``doc_id`` only its shards are read, and of them only the symbols that
    cover its ids ``begin`` to ``end`` are expanded; each row that repeats the
    id gives one row.
    """
    bounded_batches(spark)
    shards = spark.read.parquet(path)
    if doc_id is None:
        return shards.mapInArrow(_decode, "doc_id bigint, ids array<int>")
    shards = shards.filter((F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id))
    return shards.mapInArrow(_decode_range(doc_id, begin, end), "doc_id bigint, ids array<int>")
