"""Approximate nearest neighbours by learned partitions.

On a bounded sample, the graph of nearest neighbours is cut into parts of equal
size with few edges between them, and a small network learns in which parts a
vector's neighbours are. It deals every vector to its likeliest part and sends
a query to the likeliest ones, as many as a second sample needs for the wanted
recall. The vectors of those parts are ranked by their exact distances.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sunmesh.llm.common import bounded_batches
from sunmesh.sources.tables import materialise

#: Vectors that parts and network are learnt from, and as many again that the number of parts to search is measured on.
SAMPLE_ROWS = 16_384
#: Bytes of either sample; with very long vectors it has fewer rows.
SAMPLE_BYTES = 32 << 20
#: Edges of a vector in the graph, and neighbours that recall is measured by.
GRAPH_EDGES = 10
#: Sample rows of a part.
PART_ROWS = 128
#: Recall wanted on the second sample.
RECALL = 0.96
#: Queries that the second sample is measured with.
MEASURED = 1024
#: Bytes of vectors that are searched at once; parts beyond it, or of more than twice the average, are searched in buckets.
BUCKET_BYTES = 32 << 20
#: Queries that meet a bucket at once.
QUERY_ROWS = 8_192

FOUND = "query_row bigint, query_id bigint, row bigint, vec_id bigint, score double"


def nearest(points: np.ndarray, among: np.ndarray, k: int, own: np.ndarray | None = None, rank: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each point, the places and distances of its ``k`` nearest in ``among``, nearest first.

    A product of matrices proposes, with room for its rounding; distances are
    then taken from the differences. Ties go by ``rank``, else by place;
    ``own`` is the place of the point itself, which doesn't count, or -1.
    """
    step = max(1, (4 << 20) // max(1, len(among)))
    with np.errstate(all="ignore"):
        lengths = (among**2).sum(axis=1)
    for begin in range(0, len(points), step):
        block = points[begin : begin + step]
        with np.errstate(all="ignore"):
            size = (block**2).sum(axis=1)
            rough = size[:, None] + lengths - 2 * (block @ among.T)
            room = 1e-12 * (size + lengths.max(initial=0.0)) * (8 + block.shape[1])
        rough[np.isnan(rough)] = -np.inf
        if own is not None:
            mine = own[begin : begin + step]
            rough[np.flatnonzero(mine >= 0), mine[mine >= 0]] = np.inf
        kth = np.partition(rough, k - 1, axis=1)[:, k - 1] if k < len(among) else np.full(len(block), np.inf)
        for i, point in enumerate(block):
            at = np.flatnonzero(rough[i] <= kth[i] + room[i]) if np.isfinite(kth[i]) else np.arange(len(among))
            if own is not None:
                at = at[at != own[begin + i]]
            with np.errstate(all="ignore"):
                dist = np.sqrt(((among[at] - point) ** 2).sum(axis=1))
            first = np.lexsort((at if rank is None else rank[at], dist))[:k]
            yield at[first], dist[first]


def balanced_parts(graph: np.ndarray, parts: int, rounds: int = 12, smoothing: int = 60, slack: float = 0.1) -> np.ndarray:
    """Part of each node of ``graph`` (a row of neighbours per node): ``parts`` (a power of two) of about the same size.

    Every part is halved at the median of a vector that is smoothed along its
    edges; then nodes move to the part of most of their neighbours while no
    part grows by more than ``slack``.
    """
    n = len(graph)
    a = np.repeat(np.arange(n), graph.shape[1])
    a, b = np.r_[a, graph.ravel()], np.r_[graph.ravel(), a]
    label, draw = np.zeros(n, dtype=np.int64), np.random.default_rng(7)
    count = 1
    while count < parts:
        inside = label[a] == label[b]
        s, t = a[inside], b[inside]
        degree = np.bincount(t, minlength=n) + 1.0
        size = np.maximum(1, np.bincount(label, minlength=count))
        x = draw.normal(size=n)
        for _ in range(smoothing):
            x = (np.bincount(t, x[s], n) + x) / degree
            x -= (np.bincount(label, x, count) / size)[label]
            x /= np.sqrt(np.bincount(label, x * x, count) / size + 1e-30)[label]
        order = np.lexsort((x, label))
        place = np.empty(n, dtype=np.int64)
        place[order] = np.arange(n) - np.repeat(np.cumsum(size) - size, np.bincount(label, minlength=count))
        label = 2 * label + (place >= (size // 2)[label])
        count *= 2
    most = int(np.ceil((1 + slack) * n / parts))
    size = np.bincount(label, minlength=parts)
    for _ in range(rounds):
        around = np.bincount(a * parts + label[b], minlength=n * parts).reshape(n, parts)
        wanted = around.argmax(axis=1)
        gain = around[np.arange(n), wanted] - around[np.arange(n), label]
        moved = 0
        for i in np.argsort(-gain, kind="stable")[: int((gain > 0).sum())]:
            if size[wanted[i]] < most:
                size[label[i]] -= 1
                size[wanted[i]] += 1
                label[i] = wanted[i]
                moved += 1
        if not moved:
            break
    return label


class Router:
    """A network with one hidden layer: the probability of each part for a vector's neighbours."""

    def __init__(self, points: np.ndarray, shares: np.ndarray, hidden: int = 128, epochs: int = 25, batch: int = 256, rate: float = 2e-3, decay: float = 1e-4):
        draw = np.random.default_rng(11)
        self.centre = points.mean(axis=0)
        self.scale = max(float((points - self.centre).std()), 1e-300)
        x, y = self._scaled(points), shares.astype(np.float32)
        sizes = [x.shape[1], hidden, y.shape[1]]
        self.weights = [draw.normal(size=s).astype(np.float32) * (2 / s[0]) ** 0.5 for s in zip(sizes, sizes[1:])]
        self.biases = [np.zeros(s, np.float32) for s in sizes[1:]]
        params = [*self.weights, *self.biases]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        steps, total = 0, epochs * -(-len(x) // batch)
        for _ in range(epochs):
            order = draw.permutation(len(x))
            for begin in range(0, len(x), batch):
                at = order[begin : begin + batch]
                inner = np.maximum(x[at] @ self.weights[0] + self.biases[0], 0)
                out = (_softmax(inner @ self.weights[1] + self.biases[1]) - y[at]) / len(at)
                back = (out @ self.weights[1].T) * (inner > 0)
                steps += 1
                gradients = [x[at].T @ back + decay * self.weights[0], inner.T @ out + decay * self.weights[1], back.sum(axis=0), out.sum(axis=0)]
                for p, g, m, v in zip(params, gradients, first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= rate * (1 - steps / (total + 1)) * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.999**steps)) + 1e-8)

    def _scaled(self, points: np.ndarray) -> np.ndarray:
        return np.clip((points - self.centre) / self.scale, -1e6, 1e6).astype(np.float32)

    def __call__(self, points: np.ndarray) -> np.ndarray:
        inner = np.maximum(self._scaled(points) @ self.weights[0] + self.biases[0], 0)
        return _softmax(inner @ self.weights[1] + self.biases[1])


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def _mass_before(shares: np.ndarray) -> np.ndarray:
    """For each point and part, the probability of all parts that are likelier (equally likely ones: by number)."""
    order = np.argsort(-shares, axis=1, kind="stable")
    ordered = np.take_along_axis(shares, order, 1)
    before = np.empty_like(shares)
    np.put_along_axis(before, order, np.cumsum(ordered, axis=1) - ordered, 1)
    return before


@dataclass(frozen=True)
class Index:
    """Stored vectors (``row, vec_id, x, part``) with the network and what it was measured to need."""

    rows: DataFrame
    n: int
    dim: int
    router: Router | None
    mass: float
    sizes: tuple[int, ...]


def _stacked(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=float) if len(column) else np.empty((0, 0))


def _graph(points: np.ndarray):
    def graph(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = batch["at"].to_numpy()
            found = [(i, near.tolist()) for i, (near, _) in zip(at, nearest(points[at], points, GRAPH_EDGES, at))]
            yield pd.DataFrame(found, columns=["at", "near"])

    return graph


def _neighbours(spark, points: np.ndarray, asked: int) -> np.ndarray:
    """The nearest neighbours of the first ``asked`` points among all of a sample; tasks share the points."""
    at = spark.range(asked).repartition(min(asked // 64 + 1, spark.sparkContext.defaultParallelism * 4)).withColumnRenamed("id", "at")
    rows = at.mapInPandas(_graph(points), "at bigint, near array<bigint>").collect()
    return np.array([r["near"] for r in sorted(rows)])


def _learn(spark, learnt: np.ndarray, measured: np.ndarray, part_rows: int, recall: float) -> tuple[Router | None, float]:
    """The network, and the probability up to which parts must be searched for ``recall``."""
    parts = 1 << max(0, (len(learnt) // part_rows).bit_length() - 1)
    if parts == 1 or len(measured) <= GRAPH_EDGES:
        return None, 1.0
    graph = _neighbours(spark, learnt, len(learnt))
    label = balanced_parts(graph, parts)
    shares = np.zeros((len(learnt), parts))
    for column in (np.arange(len(learnt)), *graph.T):
        np.add.at(shares, (np.arange(len(learnt)), label[column]), 1 / (1 + graph.shape[1]))
    router = Router(learnt, shares)
    asked = min(MEASURED, len(measured))
    near = _neighbours(spark, measured, asked)
    probable = router(measured)
    needed = np.take_along_axis(_mass_before(probable[:asked]), probable.argmax(axis=1)[near], 1)
    return router, float(np.quantile(needed, recall, method="higher"))


def build_index(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", sample_rows: int = SAMPLE_ROWS, part_rows: int = PART_ROWS, recall: float = RECALL) -> Index:
    """Index every usable row of ``vectors``; repeated rows and ids are rows like others.

    Vectors that are null, empty, zero, or hold null or non-finite components
    take no part, nor those of another length than the most frequent (of
    equally frequent ones, the smallest). Two samples of about ``sample_rows``
    rows, drawn by hash, come to the driver; they and the network are all that
    does. An empty table gives an empty index.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    x = F.col("x")
    finite = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))) & F.exists(x, lambda v: v != 0)
    rows = vectors.select(F.col(key).cast("bigint").alias("vec_id"), F.col(vector).alias("x")).filter(x.isNotNull() & finite)
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    lengths = rows.groupBy(F.size("x").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    common = lengths.orderBy(F.desc("n"), "dim").first()
    if common is None:
        return Index(rows.withColumn("part", F.lit(0)), 0, 0, None, 1.0, (0,))
    n, dim = common["n"], common["dim"]
    rows = rows.filter(F.size("x") == dim)
    each = min(sample_rows, SAMPLE_BYTES // (8 * dim))
    million = 1_000_000
    drawn = rows.withColumn("_u", F.pmod(F.xxhash64("vec_id", "row"), F.lit(million))).filter(F.col("_u") < int(min(1.0, 2 * each / n) * million))
    sample = drawn.select("vec_id", "row", "x", (F.pmod(F.xxhash64("row", F.lit("half")), F.lit(2)) == 0).alias("learn")).toPandas().sort_values(["vec_id", "row"])
    learn = sample["learn"].to_numpy(dtype=bool)
    router, mass = _learn(spark, _stacked(sample["x"][learn]), _stacked(sample["x"][~learn]), part_rows, recall)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(part=router(_stacked(batch["x"])).argmax(axis=1).astype("int32") if len(batch) else pd.Series(dtype="int32"))

    typed = f"vec_id bigint, x {rows.schema['x'].dataType.simpleString()}, row bigint, part int"
    dealt = rows.withColumn("part", F.lit(0)) if router is None else rows.select("vec_id", "x", "row").mapInPandas(deal, typed)
    dealt = materialise(dealt, "dealt")
    counts = dict(dealt.groupBy("part").count().collect())
    parts = 1 if router is None else len(router.biases[1])
    return Index(dealt, n, dim, router, mass, tuple(counts.get(p, 0) for p in range(parts)))


def _route(router: Router, mass: float, sizes: np.ndarray, k: int):

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            before = _mass_before(router(_stacked(batch["x"])))
            order = np.argsort(before, axis=1, kind="stable")
            # Enough parts for the recall, and for k rows besides the query's own.
            held = np.empty_like(order)
            np.put_along_axis(held, order, np.cumsum(sizes[order], axis=1) - sizes[order], 1)
            asked = (before <= mass) | (held <= k)
            batch["parts"] = [np.flatnonzero(a & (sizes > 0)).astype("int32") for a in asked]
            yield batch

    return route


def _searcher(k: int):
    def search(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(vectors) or not len(queries):
            return pd.DataFrame(columns=[c.split()[0] for c in FOUND.split(", ")])
        # Ids first (null last), then rows, decide between equal distances.
        vectors = vectors.sort_values(["vec_id", "row"]).reset_index(drop=True)
        place = pd.Series(np.arange(len(vectors)), index=vectors["row"])
        own = place.reindex(queries["query_row"]).fillna(-1).to_numpy(dtype=np.int64)
        found = list(nearest(_stacked(queries["x"]), _stacked(vectors["x"]), min(k + 1, len(vectors)), own))
        at, dist = np.concatenate([a for a, _ in found]), np.concatenate([d for _, d in found])
        of = np.repeat(np.arange(len(queries)), [len(a) for a, _ in found])
        asked, hit = queries.iloc[of], vectors.iloc[at]
        return pd.DataFrame({"query_row": asked["query_row"].to_numpy(), "query_id": asked["query_id"].to_numpy(), "row": hit["row"].to_numpy(), "vec_id": hit["vec_id"].array, "score": dist})

    return search


def search(index: Index, chosen: Column, k: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found for each indexed row for which ``chosen`` (over ``vec_id``) holds.

    The score is the Euclidean distance in double precision; ties go to the
    smaller id, rows without one come last. A query's own row is no candidate,
    other rows with its id are. With fewer candidates all are found. Parts are
    searched in buckets of bounded bytes, and queries in blocks, so neither a
    crowded part nor a popular one fills a task.
    """
    width = max(1, min(BUCKET_BYTES // (8 * max(1, index.dim)), max(256, 2 * index.n // len(index.sizes))))
    queries = index.rows.filter(chosen).select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"), "x")
    everywhere = F.array(*(F.lit(p) for p in range(len(index.sizes))))
    typed = f"query_row bigint, query_id bigint, x {index.rows.schema['x'].dataType.simpleString()}, parts array<int>"
    routed = queries.withColumn("parts", everywhere) if index.router is None else queries.mapInPandas(_route(index.router, index.mass, np.array(index.sizes), k), typed)
    routed = materialise(routed.select("query_row", "query_id", "x", F.explode("parts").alias("part")), "routed")
    asked = dict(routed.groupBy("part").count().collect())
    # One short row per part: its buckets, and the blocks of its queries.
    plan = [(p, -(-size // width), -(-asked.get(p, 0) // QUERY_ROWS)) for p, size in enumerate(index.sizes) if size and asked.get(p)]
    plan = F.broadcast(index.rows.sparkSession.createDataFrame(plan, "part int, buckets bigint, blocks bigint"))
    vectors = index.rows.join(plan, "part").withColumn("bucket", F.pmod(F.xxhash64("row"), F.col("buckets")))
    vectors = vectors.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    routed = routed.join(plan, "part").withColumn("block", F.pmod(F.xxhash64("query_row"), F.col("blocks")))
    routed = routed.withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("buckets") - 1)))
    keys = ["part", "bucket", "block"]
    left = vectors.select(*keys, "row", "vec_id", "x").groupBy(*keys)
    found = left.cogroup(routed.select(*keys, "query_row", "query_id", "x").groupBy(*keys)).applyInPandas(_searcher(k), FOUND)
    best = Window.partitionBy("query_row").orderBy("score", F.col("vec_id").asc_nulls_last(), "row")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
