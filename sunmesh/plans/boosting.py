"""Boosted trees for searches: every fit is one group of rows, and all fits of a search are one job.

``GBTRegressor`` runs a job for each level of each tree, which is right for
tables that need many tasks. A search over a table of at most ``GROUP_ROWS``
rows asks for thousands of such jobs with hardly any work in them; here a group
holds the rows of one fit and grows its trees without leaving the task. The
method is that of ``GBTRegressor``: squared error, 32 cells per feature cut
between equal shares of the training rows, best variance gain first, each tree
after the first one shrunk by the step size. Sums are added up in the order of
the rows, so that splits of equal gain go the same way, too. Larger tables belong to ``GBTRegressor``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a group at most, some 10 MB; trees of larger tables are grown level by level over many tasks.
GROUP_ROWS = 1 << 17
#: Impurity below which a node counts as pure.
PURE = np.finfo(float).eps

TREES = "fit int, tree int, weight double, cuts array<array<double>>, feature binary, cell binary, left binary, value binary"


def cut_points(values: np.ndarray, bins: int) -> np.ndarray:
    """Thresholds of one feature: between all its values if they are few, else between shares of about equal size."""
    distinct, counts = np.unique(values, return_counts=True)
    between, bins = (distinct[:-1] + distinct[1:]) / 2, min(bins, len(values))
    if len(distinct) <= bins:
        return between
    stride, reach, chosen = len(values) / bins, np.cumsum(counts).tolist(), []
    wanted = stride
    for i in range(len(between)):
        if abs(reach[i] - wanted) < abs(reach[i + 1] - wanted):
            chosen.append(i)
            wanted += stride
    return between[chosen]


def cells(x: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """Of each feature and row, how many thresholds lie below the value."""
    return np.stack([np.searchsorted(c, x[:, f], "left").astype(np.uint8) for f, c in enumerate(cuts)])


def _variance(n, s, q):
    n = np.maximum(n, 1)
    return (q - s * s / n) / n


def grow(at: np.ndarray, widths: Sequence[int], y: np.ndarray, used: np.ndarray, depth: int, least: int, gain: float) -> tuple[dict, np.ndarray]:
    """One regression tree on the ``used`` rows, and the node that each row (used or not) ends in."""
    rows, everyone = np.flatnonzero(used), np.arange(len(y))
    t = y[rows]
    n, s, q = np.full(1, len(rows)), np.full(1, np.cumsum(t)[-1] if len(t) else 0.0), np.full(1, np.cumsum(t * t)[-1] if len(t) else 0.0)
    node, slot, frontier = np.zeros(len(y), np.int32), np.zeros(len(rows), np.int64), np.zeros(1 if len(rows) > 1 else 0, np.int32)
    tree = {"feature": np.full(1, -1, np.int8), "cell": np.zeros(1, np.uint8), "left": np.zeros(1, np.int32), "value": s / np.maximum(n, 1)}
    for _ in range(depth):
        m = len(frontier)
        if not m:
            break
        impurity, best, column, place = _variance(n, s, q), np.full(m, -np.inf), np.zeros(m, np.int8), np.zeros(m, np.int64)
        sides = np.zeros((3, m, 2))
        for f, width in enumerate(widths):
            if width == 1:
                continue
            key, shape = slot * width + at[f, rows], (m, width)
            cn = np.bincount(key, minlength=m * width).reshape(shape).cumsum(1)
            cs, cq = (np.bincount(key, w, m * width).reshape(shape).cumsum(1) for w in (t, t * t))
            left, right = [c[:, :-1] for c in (cn, cs, cq)], [c[:, -1:] - c[:, :-1] for c in (cn, cs, cq)]
            total = n[:, None]
            gained = impurity[:, None] - left[0] / total * _variance(*left) - right[0] / total * _variance(*right)
            gained = np.where((left[0] >= least) & (right[0] >= least), gained, -np.inf)
            cut = gained.argmax(1)
            gained = gained[np.arange(m), cut]
            better = np.flatnonzero(gained > best)
            best[better], column[better], place[better] = gained[better], f, cut[better]
            for i in range(3):
                sides[i, better, 0], sides[i, better, 1] = left[i][better, cut[better]], right[i][better, cut[better]]
        split = np.flatnonzero((best > 0) & (best >= gain))
        if not len(split):
            break
        parents, first = frontier[split], len(tree["value"]) + 2 * np.arange(len(split), dtype=np.int32)
        tree["feature"][parents], tree["cell"][parents], tree["left"][parents] = column[split], place[split], first
        n, s, q = sides[:, split].reshape(3, -1)
        for name, new in (("feature", np.full(len(n), -1)), ("cell", np.zeros(len(n))), ("left", np.zeros(len(n))), ("value", s / n)):
            tree[name] = np.concatenate([tree[name], new.astype(tree[name].dtype)])
        inner = everyone[tree["feature"][node] >= 0]
        above = node[inner]
        node[inner] = tree["left"][above] + (at[tree["feature"][above], inner] > tree["cell"][above])
        # A node goes on if it isn't pure and both its children can have rows enough.
        ready = np.flatnonzero((n >= 2 * least) & (np.abs(_variance(n, s, q)) >= PURE))
        n, s, q = n[ready], s[ready], q[ready]
        slots = np.full(len(tree["value"]), -1, np.int64)
        slots[first[0] + ready] = np.arange(len(ready))
        frontier = (first[0] + ready).astype(np.int32)
        slot = slots[node[rows]]
        keep = slot >= 0
        rows, t, slot = rows[keep], t[keep], slot[keep]
    return tree, node


def boost(x: np.ndarray, label: np.ndarray, train: np.ndarray, chosen: dict, cuts: Sequence[np.ndarray], keep: bool) -> tuple[np.ndarray, list[dict]]:
    """Predictions of all rows by trees that learn from the ``train`` ones; the trees themselves if ``keep``."""
    at, widths = cells(x, cuts), [len(c) + 1 for c in cuts]
    pred, trees, drawn = np.zeros(len(label)), [], np.ones(len(label), bool)
    by_value = np.lexsort([label, *x.T])
    for number in range(chosen["maxIter"]):
        if chosen["subsamplingRate"] < 1:
            drawn[by_value] = np.random.default_rng([chosen["seed"], number]).random(len(label)) < chosen["subsamplingRate"]
        y = 2 * (label - pred) if number else label
        tree, node = grow(at, widths, y, train & drawn, chosen["maxDepth"], chosen["minInstancesPerNode"], chosen["minInfoGain"])
        weight = chosen["stepSize"] if number else 1.0
        pred += weight * tree["value"][node]
        if keep:
            trees.append({"tree": number, "weight": weight, **tree})
    return pred, trees


def _arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, label and training mark in the rows' order."""
    table = table.sort_by("row")
    label = table.column("label").to_numpy()
    x = table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(label), -1)
    train = table.column("train").to_numpy()
    return x, label, train


def settings(fit: GBTRegressor) -> dict:
    names = ("maxIter", "maxDepth", "stepSize", "minInstancesPerNode", "minInfoGain", "subsamplingRate", "seed", "maxBins")
    return {n: fit.getOrDefault(n) for n in names}


def _grouped(rows: DataFrame, fits: int, train):
    """``rows`` once for each fit; ``train`` tells from the fit's number which rows it learns from."""
    each = rows.withColumn("row", F.monotonically_increasing_id()).select("*", F.explode(F.sequence(F.lit(0), F.lit(fits - 1))).alias("fit"))
    placed = each.select("fit", "row", vector_to_array("features").alias("x"), F.col("label").cast("double").alias("label"), train.alias("train"))
    # Numbers are dealt one to a task; hashes of few numbers would leave tasks without any.
    return placed.repartitionByRange(min(fits, 2000), "fit").groupBy("fit")


def held_out_errors(rows: DataFrame, fits: Sequence[GBTRegressor], train) -> list[float]:
    """Mean squared error of each fit on the rows that it doesn't learn from.

    ``rows`` has ``features`` and ``label``; ``train`` is a boolean column that may use ``fit``, the fit's place in ``fits``.
    """
    chosen = [settings(f) for f in fits]

    def run(key, table):
        x, label, mark = _arrays(table)
        if mark.all() or not mark.any():
            raise ValueError("a fit has no rows to learn from, or none to be judged by")
        own = chosen[key[0].as_py()]
        pred, _ = boost(x, label, mark, own, [cut_points(c, own["maxBins"]) for c in x[mark].T], False)
        error = np.mean((pred - label)[~mark] ** 2)
        return pa.table({"fit": pa.array([key[0].as_py()], pa.int32()), "error": pa.array([float(error)])})

    # One row per fit.
    errors = {r.fit: r.error for r in _grouped(rows, len(chosen), train).applyInArrow(run, "fit int, error double").collect()}
    if len(errors) < len(chosen):
        raise ValueError("there are no rows to learn from")
    return [errors[i] for i in range(len(chosen))]


def fitted(rows: DataFrame, fit: GBTRegressor) -> BoostedTrees:
    """The model of one fit on all rows."""
    chosen = settings(fit)

    def run(key, table):
        x, label, mark = _arrays(table)
        cuts = [cut_points(c, chosen["maxBins"]) for c in x.T]
        _, trees = boost(x, label, mark, chosen, cuts, True)
        out = [{"fit": 0, "tree": t["tree"], "weight": t["weight"], "cuts": [c.tolist() for c in cuts]} | {k: t[k].tobytes() for k in ("feature", "cell", "left", "value")} for t in trees]
        return pa.Table.from_pylist(out, schema=_ARROW)

    # As with Spark's own ensembles the trees go to the driver; a group's rows bound their nodes.
    stored = _grouped(rows, 1, F.lit(True)).applyInArrow(run, TREES).orderBy("tree").collect()
    if not stored:
        raise ValueError("there are no rows to learn from")
    return BoostedTrees(stored, fit.getOrDefault("featuresCol"), fit.getOrDefault("predictionCol"))


_ARROW = pa.schema(
    [("fit", pa.int32()), ("tree", pa.int32()), ("weight", pa.float64()), ("cuts", pa.list_(pa.list_(pa.float64())))]
    + [(k, pa.binary()) for k in ("feature", "cell", "left", "value")]
)


class BoostedTrees(Model):
    """A sum of regression trees, applied to batches of rows."""

    def __init__(self, stored: Sequence, features: str = "features", prediction: str = "pred"):
        super().__init__()
        self.cuts = [np.array(c) for c in stored[0].cuts]
        kinds = {"feature": np.int8, "cell": np.uint8, "left": np.int32, "value": np.float64}
        self.trees = [{k: np.frombuffer(r[k], t) for k, t in kinds.items()} | {"weight": r.weight} for r in stored]
        self.features, self.prediction, self.shared = features, prediction, None

    def predict(self, x: np.ndarray) -> np.ndarray:
        at, total, everyone = cells(x, self.cuts), np.zeros(len(x)), np.arange(len(x))
        for tree in self.trees:
            node = np.zeros(len(x), np.int32)
            inner = everyone if tree["feature"][0] >= 0 else everyone[:0]
            while len(inner):
                above = node[inner]
                node[inner] = tree["left"][above] + (at[tree["feature"][above], inner] > tree["cell"][above])
                inner = inner[tree["feature"][node[inner]] >= 0]
            total += tree["weight"] * tree["value"][node]
        return total

    def _transform(self, dataset: DataFrame) -> DataFrame:
        if self.shared is None:
            self.shared = dataset.sparkSession.sparkContext.broadcast((self.cuts, self.trees))
        shared = self.shared

        def predicted(x: pd.Series) -> pd.Series:
            model = BoostedTrees.__new__(BoostedTrees)
            model.cuts, model.trees = shared.value
            return pd.Series(model.predict(np.stack(x.to_numpy())) if len(x) else np.zeros(0))

        return dataset.withColumn(self.prediction, F.pandas_udf(predicted, "double")(vector_to_array(self.features)))
