import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sunmesh.llm import learned_partitions as lp
from sunmesh.llm.queries import QUERIES


def exact(ids, x, chosen, k=10):
    """All nearest neighbours of the chosen rows by plain distances: ``(row, [(distance, id), ...])``."""
    found = {}
    for i in chosen:
        dist = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        found[i] = sorted((d, math.inf if ids[j] is None else ids[j]) for j, d in enumerate(dist) if j != i)[:k]
    return found


def recall(found, truth, ids):
    by_query = {}
    for r in found:
        by_query.setdefault(r["query_id"], []).append(r)
    hits = 0
    for i, best in truth.items():
        rows = sorted(by_query[ids[i]], key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, len(best) + 1))
        assert [(r["score"], r["vec_id"]) for r in rows] == sorted((r["score"], r["vec_id"]) for r in rows)
        hits += len({r["vec_id"] for r in rows} & {v for _, v in best})
    return hits / sum(len(b) for b in truth.values())


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_query_against_brute_force(spark, folder):
    rows = spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet").orderBy("vec_id").toPandas()
    ids, x = rows["vec_id"].tolist(), np.stack(rows["embedding"]).astype(float)
    truth = exact(ids, x, [i for i, v in enumerate(ids) if v % 100 == 0])
    found = QUERIES["op12_learned_partitions"](spark, f"/root/testdata/{folder}").collect()
    assert len(found) == 10 * len(truth) and recall(found, truth, ids) >= 0.9
    place = {v: i for i, v in enumerate(ids)}
    assert all(r["score"] == pytest.approx(math.dist(x[place[r["query_id"]]], x[place[r["vec_id"]]]), rel=1e-12) for r in found)


def clustered(rng, n):
    centres = rng.normal(size=(40, 12)) * 4
    return centres[rng.integers(0, 40, n)] + rng.normal(size=(n, 12))


def test_parts_are_searched_and_recall_kept(spark):
    rng = np.random.default_rng(5)
    x = clustered(rng, 6000)
    x[4000:] = x[4000]  # a third of all rows is one vector
    ids = rng.permutation(6000).tolist()
    frame = spark.createDataFrame([(v, p.tolist(), None) for v, p in zip(ids, x)], "vec_id int, embedding array<double>, x string").repartition(6)
    index = lp.build_index(frame, sample_rows=1500)
    assert index.router is not None and len(index.sizes) == 8 and sum(index.sizes) == 6000 and index.mass < 0.99
    found = lp.search(index, F.col("vec_id") % 100 == 0).collect()
    truth = exact(ids, x, [i for i, v in enumerate(ids) if v % 100 == 0])
    assert recall(found, truth, ids) >= 0.9
    for i, best in truth.items():
        if i >= 4000:
            assert [(r["score"], r["vec_id"]) for r in sorted((r for r in found if r["query_id"] == ids[i]), key=lambda r: r["rank"])] == best


def test_parts_are_balanced_and_follow_the_graph():
    rng = np.random.default_rng(2)
    x = clustered(rng, 1024)
    graph = np.array([at for at, _ in lp.nearest(x, x, 10, np.arange(len(x)))])
    label = lp.balanced_parts(graph, 8)
    assert np.bincount(label, minlength=8).max() <= math.ceil(1.1 * 128) and len(np.unique(label)) == 8
    assert (label[graph] == label[:, None]).mean() > 0.7


def test_odd_vectors_and_few_rows(spark):
    bad = [None, [], [0.0, 0.0], [1.0, None], [math.nan, 1.0], [math.inf, 1.0], [1.0, 2.0, 3.0]]
    good = [(100, [1.0, 0.0]), (100, [1.0, 0.0]), (3, [1.0, 0.0]), (None, [1.0, 0.0]), (2, [1.0, 0.0]), (200, [4.0, 4.0]), (-100, [1e200, -1e200])]
    frame = spark.createDataFrame([(100 * i, v) for i, v in enumerate(bad)] + good, "vec_id bigint, embedding array<double>")
    found = lp.search(lp.build_index(frame), F.col("vec_id") % 100 == 0, k=3).collect()
    by_query = {}
    for r in found:
        by_query.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(by_query) == [-100, 100, 200]
    assert sorted(by_query[100]) == sorted([(1, 2, 0.0), (2, 3, 0.0), (3, 100, 0.0)] * 2)
    assert sorted(by_query[200]) == [(1, 2, 5.0), (2, 3, 5.0), (3, 100, 5.0)]
    empty = frame.limit(0)
    assert lp.search(lp.build_index(empty), F.col("vec_id") % 100 == 0).count() == 0
    lone = spark.createDataFrame([(0, [1.0])], "vec_id bigint, embedding array<double>")
    assert lp.search(lp.build_index(lone), F.col("vec_id") % 100 == 0).count() == 0
    pair = spark.createDataFrame([(0, [1.0]), (7, [2.5])], "vec_id bigint, embedding array<double>")
    assert [tuple(r) for r in lp.search(lp.build_index(pair), F.col("vec_id") % 100 == 0).collect()] == [(0, 1, 7, 1.5)]


def test_nearest_with_ties():
    rng = random.Random(4)
    x = np.array([[rng.randint(0, 3), rng.randint(0, 3)] for _ in range(60)], dtype=float)
    for i, (at, dist) in enumerate(lp.nearest(x, x, 5, np.arange(60))):
        plain = sorted((math.dist(x[i], x[j]), j) for j in range(60) if j != i)[:5]
        assert list(zip(dist.tolist(), at.tolist())) == plain
