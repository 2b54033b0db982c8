"""Cross-entropy difference of two matched n-gram models over the whole vocabulary.

Documents are encoded once, where they are read, and stored in blocks of bounded
size, bucketed by block, so that no later pass moves them. A block
says once which n-grams it holds, as sorted, packed lists by slices of their
contexts. A slice adds up all blocks' lists and answers each with the counts of
its n-grams and contexts, packed again, and a block prices its documents from
its own answers. Messages are distinct n-grams of blocks, not occurrences, and
no table of n-grams is broadcast; what a model gathers grows with the corpus.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunmesh.llm.common import bounded_batches, only
from sunmesh.llm.encoding import STEP, VOCABULARY, encoder
from sunmesh.llm.shingles import mix64
from sunmesh.session import scratch_path
from sunmesh.sources.tables import materialise

#: Length of the longest n-grams.
ORDER = 2
#: Weight of an n-gram's own estimate against that of the shorter context, and what each symbol has before counting.
WEIGHT, PRIOR = 0.8, 1.0
#: Symbols of a block; a longer document is a block of its own.
BLOCK_SYMBOLS = 1 << 20
#: Buckets of the stored blocks at most; a task reads one bucket, block by block.
MOST_BUCKETS = 100_000
#: Symbols of the corpus for each slice: what a slice adds up at once is at most so many n-grams.
SLICE_SYMBOLS = 1 << 22

_DOCS = "row bigint, doc_id bigint, block bigint, ids binary, width int"
_LISTS = "block bigint, k int, slice bigint, cells binary, n_all binary, n_target binary"
_ANSWERS = "block bigint, k int, cells binary, n_all binary, n_target binary, context_all binary, context_target binary"


def _encode(vocabulary: str, block_symbols: int):
    """Encode a task's documents, and number its blocks in the order in which they come."""

    def run(batches):
        from pyspark import TaskContext

        known = encoder(vocabulary)
        kind = np.dtype("<u2" if known.size < 1 << 16 else "<u4")
        block, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for i in range(0, batch.num_rows, STEP):
                own = batch.slice(i, STEP)
                ids, n = known.encode(own.column("text"))
                data, ends = ids.astype(kind).tobytes(), np.cumsum(n) * kind.itemsize
                blobs = [data[a:b] for a, b in zip(np.concatenate([[0], ends[:-1]]), ends)]
                blocks = []
                for symbols in (n + 1).tolist():
                    if held and held + symbols > block_symbols:
                        block, held = block + 1, 0
                    held += symbols
                    blocks.append(block)
                columns = [own.column("row"), own.column("doc_id"), pa.array(blocks, pa.int64()), pa.array(blobs, pa.binary()), pa.array([kind.itemsize] * len(blobs), pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "block", "ids", "width"])

    return run


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, block_symbols: int = BLOCK_SYMBOLS) -> DataFrame:
    """Store ``row, doc_id, block, ids, width`` bucketed by block; ``row`` tells rows apart.

    Each task writes its own blocks' files, without a shuffle, and passes by
    block read them without one.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    path = scratch_path(spark, "encoded")
    name = f"encoded_{path.rsplit('-', 1)[1]}"
    encoded = texts.mapInArrow(_encode(vocabulary, block_symbols), _DOCS)
    buckets = max(1, min(MOST_BUCKETS, texts.rdd.getNumPartitions()))
    encoded.write.bucketBy(buckets, "block").option("path", path).saveAsTable(name)
    return spark.table(name)


def packed(numbers: np.ndarray) -> bytes:
    """Numbers from 0 on, small ones in few bytes: their bytes by significance, compressed."""
    planes = numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T
    return len(numbers).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(planes).tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], 8 * n, "zstd"), np.uint8) if n else np.zeros(0, np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view("<u8").ravel().astype(np.int64)


def _packed_cells(cells: np.ndarray) -> bytes:
    return packed(np.diff(cells, prepend=0))


def _unpacked_cells(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data))


def symbols_of(blobs: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """All documents' symbols, ids from 1 on with a 0 at each document's end, and how many each has."""
    n = np.array([len(b) for b in blobs], np.int64) // width
    ids = np.frombuffer(b"".join(blobs), f"<u{width}")
    found = np.zeros(len(ids) + len(n), np.int64)
    found[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids.astype(np.int64) + 1
    return found, n + 1


def grams(symbols: np.ndarray, counts: np.ndarray, order: int, bits: int) -> np.ndarray:
    """The ``order``-gram that ends at each symbol, as one number, the last symbol lowest; before a document stand zeros."""
    starts = np.cumsum(counts) - counts
    found, before = symbols.copy(), symbols
    for k in range(1, order):
        before = np.concatenate([[0], before[:-1]])
        before[starts] = 0
        found |= before << bits * k
    return found


def _shorter(cells: np.ndarray, k: int, bits: int) -> np.ndarray:
    """The last ``k`` symbols of n-grams."""
    return cells & ((1 << bits * k) - 1)


def _added(cells: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct cells in order, and the sums of their counts."""
    seen, at = np.unique(cells, return_inverse=True)
    return seen, *(np.bincount(at, c, len(seen)).astype(np.int64) for c in counts)


def _slices(cells: np.ndarray, bits: int, slices: int) -> np.ndarray:
    """Slices hold whole contexts."""
    return (mix64((cells >> bits).astype(np.uint64)) % np.uint64(slices)).astype(np.int64)


def _list(order: int, bits: int, slices: int):
    """What a block holds: its distinct k-grams with their counts, by slice; single symbols in one list."""

    def lists(docs: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
        only("lists")
        names = [c.split()[0] for c in _LISTS.split(", ")]
        if not len(docs):
            return pd.DataFrame(columns=names)
        block = int(docs["block"].iloc[0])
        symbols, counts = symbols_of(docs["ids"].tolist(), int(docs["width"].iloc[0]))
        target = np.repeat(docs["row"].isin(marks["row"]).to_numpy(), counts)
        # One sort tells cells and, by their lowest bit, the target's; shorter n-grams follow from the distinct longest ones.
        seen, n_all = np.unique(grams(symbols, counts, order, bits) << 1 | target, return_counts=True)
        seen, n_all, n_target = _added(seen >> 1, n_all, n_all * (seen & 1))
        rows = []
        for k in range(order, 0, -1):
            if k < order:
                seen, n_all, n_target = _added(_shorter(seen, k, bits), n_all, n_target)
            own = _slices(seen, bits, slices) if k > 1 else np.zeros(len(seen), np.int64)
            by = np.argsort(own, kind="stable")
            cuts = np.flatnonzero(np.diff(own[by], prepend=-1))
            rows += [(block, k, int(own[by[a]]), _packed_cells(seen[by[a:b]]), packed(n_all[by[a:b]]), packed(n_target[by[a:b]])) for a, b in zip(cuts, [*cuts[1:], len(by)])]
        return pd.DataFrame(rows, columns=names)

    return lists


def _answer(bits: int):
    """Add up one slice's lists, and answer each with the sums of its n-grams and of their contexts."""

    def answer(lists: pd.DataFrame) -> pd.DataFrame:
        own = [_unpacked_cells(c) for c in lists["cells"]]
        seen, at = np.unique(np.concatenate(own), return_inverse=True)
        sums = [np.bincount(at, np.concatenate([unpacked(c) for c in lists[name]]), len(seen)).astype(np.int64) for name in ("n_all", "n_target")]
        begin = np.flatnonzero(np.diff(seen >> bits, prepend=-1))
        sizes = np.diff(begin, append=len(seen))
        sums += [np.repeat(np.add.reduceat(s, begin), sizes) for s in sums[:2]]
        places = np.split(at, np.cumsum([len(c) for c in own])[:-1])
        columns = [[packed(s[p]) for p in places] for s in sums]
        return pd.DataFrame(dict(zip([c.split()[0] for c in _ANSWERS.split(", ")], [lists["block"], lists["k"], lists["cells"], *columns])))

    return answer


def _singles(batches):
    for lists in batches:
        for r in lists.itertuples(index=False):
            yield pd.DataFrame({"symbol": _unpacked_cells(r.cells), "n_all": unpacked(r.n_all), "n_target": unpacked(r.n_target)})


def unigrams(lists: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols and their counts in all documents and in the target's: a row per symbol of the vocabulary, a bounded number."""
    singles = lists.filter("k = 1").select("cells", "n_all", "n_target").mapInPandas(_singles, "symbol bigint, n_all bigint, n_target bigint")
    table = singles.groupBy("symbol").agg(F.sum("n_all").alias("n_all"), F.sum("n_target").alias("n_target")).toArrow().sort_by("symbol")
    return tuple(table.column(c).to_numpy() for c in ("symbol", "n_all", "n_target"))


def _price(order: int, bits: int, sent):
    """Sums of both models' losses for the documents of a block."""

    def price(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        names = ["doc_id", "n", "target", "background"]
        if not len(docs):
            return pd.DataFrame(columns=names)
        symbols, counts = symbols_of(docs["ids"].tolist(), int(docs["width"].iloc[0]))
        # A loss depends on the longest n-gram alone, so each distinct one is priced once.
        found, where = np.unique(grams(symbols, counts, order, bits), return_inverse=True)
        known, *base = sent.value
        at = np.searchsorted(known, _shorter(found, 1, bits))
        chance = [b[at] for b in base]
        for k in range(2, order + 1):
            mine = answers[answers["k"] == k]
            cells = np.concatenate([_unpacked_cells(c) for c in mine["cells"]])
            by = np.argsort(cells)
            at = by[np.searchsorted(cells, _shorter(found, k, bits), sorter=by)]
            for m, name in enumerate(("target", "all")):
                n, context = (np.concatenate([unpacked(c) for c in mine[f"{part}_{name}"]])[at] for part in ("n", "context"))
                own = np.divide(n, context, out=np.zeros(len(n)), where=context > 0)
                chance[m] = np.where(context > 0, WEIGHT * own + (1 - WEIGHT) * chance[m], chance[m])
        starts = np.cumsum(counts) - counts
        target, background = (np.add.reduceat(-np.log2(c)[where], starts) for c in chance)
        return pd.DataFrame(dict(zip(names, [docs["doc_id"], counts, target, background])))

    return price


def score_documents(docs: DataFrame, target_ids: DataFrame, vocabulary: str = VOCABULARY, order: int = ORDER, block_symbols: int = BLOCK_SYMBOLS, slice_symbols: int = SLICE_SYMBOLS) -> DataFrame:
    """Per document: ``n_tokens, target_loss, background_loss`` (bits per token) and ``score``, their difference.

    The target model counts the documents that ``target_ids`` names, the
    background model all documents; every document and every id counts. An
    estimate of ``order`` symbols is interpolated with that of one symbol less
    where its context was seen, down to single symbols, whose counts are scaled to
    the target's mass so that both models smooth alike. Without target
    documents both models are the background's. The lower the score, the closer
    a document is to the target. A loss is the mean over the ids
    (``n_tokens``) and the end; null and empty texts have that of ending at
    once. Null and repeated ids are rows like others (a null one is never
    target). No documents give no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    encoded = encode(docs, vocabulary, block_symbols)
    good = target_ids.select(F.col("doc_id").cast("bigint").alias("doc_id")).filter("doc_id is not null").distinct()
    # Only numbers move: a mark for each target document goes to its block. An id of very many rows is split by adaptive execution.
    marks = materialise(encoded.select("block", "row", "doc_id").join(good, "doc_id").select("block", "row"), "marks")
    bits = int(encoder(vocabulary).size).bit_length()
    if order * bits > 62:
        raise ValueError(f"n-grams of {order} symbols of {bits} bits don't fit a number")
    total = encoded.agg(F.coalesce(F.sum(F.octet_length("ids") / F.col("width") + 1), F.lit(0))).first()[0]
    slices = int(total // slice_symbols) + 1
    listed = encoded.groupBy("block").cogroup(marks.groupBy("block"))
    lists = materialise(listed.applyInPandas(_list(order, bits, slices), _LISTS), "lists")
    symbols, n_all, n_target = unigrams(lists)
    if not n_target.sum():
        n_target = n_all
    mass = float(n_target.sum())
    base = [(n * (mass / max(1, n.sum())) + PRIOR) / (mass + PRIOR * len(symbols)) for n in (n_target, n_all)]
    sent = spark.sparkContext.broadcast((symbols, *base))
    answers = lists.filter("k > 1").groupBy("k", "slice").applyInPandas(_answer(bits), _ANSWERS)
    # Without a target the counts of all documents stand for it.
    if n_target is n_all:
        answers = answers.withColumns({"n_target": F.col("n_all"), "context_target": F.col("context_all")})
    summed = encoded.select("block", "doc_id", "ids", "width").groupBy("block").cogroup(answers.groupBy("block"))
    summed = summed.applyInPandas(_price(order, bits, sent), "doc_id bigint, n bigint, target double, background double")
    means = summed.select("doc_id", (F.col("n") - 1).alias("n_tokens"), (F.col("target") / F.col("n")).alias("target_loss"), (F.col("background") / F.col("n")).alias("background_loss"))
    return means.withColumn("score", F.col("target_loss") - F.col("background_loss"))
