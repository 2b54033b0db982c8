"""Models that need only means and covariances: grouped principal components and per-site regression.

Spark computes the moments of all groups in one aggregation with map-side
combine. What remains is one tiny row per group (or per group and fold), whose
small matrices are solved in vectorised Python tasks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sunmesh.operators.ordered import contiguous_folds
from sunmesh.operators.sizing import small_side

DOUBLES = T.ArrayType(T.DoubleType())


def _moments(columns: Sequence[str]) -> list[Column]:
    """Aggregates ``n``, ``mean`` and population ``cov`` (row by row) over rows complete in ``columns``."""
    complete = F.lit(True)
    for name in columns:
        complete = complete & F.col(name).isNotNull()
    values = [F.when(complete, F.col(c)) for c in columns]
    # The covariance is symmetric: each pair is named once, and equal aggregates are computed once.
    pairs = [(min(a, b), max(a, b)) for a in range(len(columns)) for b in range(len(columns))]
    cov = F.array(*[F.covar_pop(values[a], values[b]) for a, b in pairs])
    return [F.count_if(complete).alias("n"), F.array(*[F.avg(v) for v in values]).alias("mean"), cov.alias("cov")]


def grouped_moments(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``(by.., n, mean, cov)`` over rows without nulls."""
    return df.groupBy(*by).agg(*_moments(columns)).where(F.col("n") > 0)


def _signed(vector: np.ndarray) -> np.ndarray:
    """The direction whose largest absolute entry is positive."""
    return vector if vector[np.argmax(np.abs(vector))] > 0 else -vector


def fit_pca_groups(
    df: DataFrame, groups: Mapping[str, tuple[Sequence[str], Sequence[str]]], by: Sequence[str] = ("station_id",)
) -> DataFrame:
    """``(by.., group, component, mean, loadings, variance)``, centred, strongest component (0) first.

    ``groups`` maps a group name to its input columns and the names of its
    components. All groups come from one pass over the data. ``variance`` is the
    sample variance of the component's scores.
    """
    keys = list(by)
    counts = {name: len(new_columns) for name, (_, new_columns) in groups.items()}
    parts = [F.struct(F.lit(name).alias("group"), *_moments(columns)) for name, (columns, _) in groups.items()]
    moments = (
        df.groupBy(*keys)
        .agg(F.array(*parts).alias("__parts"))
        .select(*keys, F.inline("__parts"))
        .where(F.col("n") > 1)
    )
    schema = T.StructType(
        [moments.schema[c] for c in keys]
        + [
            T.StructField("group", T.StringType()),
            T.StructField("component", T.IntegerType()),
            T.StructField("mean", DOUBLES),
            T.StructField("loadings", DOUBLES),
            T.StructField("variance", T.DoubleType()),
        ]
    )

    def solve(batches):
        for rows in batches:
            for name, part in rows.groupby("group"):
                width = len(part["mean"].iloc[0])
                values, vectors = np.linalg.eigh(np.stack(part["cov"].to_numpy()).reshape(-1, width, width))
                sample = (part["n"] / (part["n"] - 1)).to_numpy()
                for component in range(counts[name]):
                    out = part[[*keys, "group"]].copy()
                    out["component"] = np.int32(component)
                    out["mean"] = part["mean"]
                    out["loadings"] = [_signed(v) for v in vectors[:, :, width - 1 - component]]
                    out["variance"] = values[:, width - 1 - component] * sample
                    yield out

    return moments.mapInPandas(solve, schema)


def apply_pca_groups(
    df: DataFrame,
    params: DataFrame,
    groups: Mapping[str, tuple[Sequence[str], Sequence[str]]],
    by: Sequence[str] = ("station_id",),
    drop_inputs: bool = True,
) -> DataFrame:
    """Scores of each row under its key's components; null where an input is null."""
    by = list(by)
    fitted = {
        new: F.max(F.when((F.col("group") == name) & (F.col("component") == i), F.struct("mean", "loadings"))).alias(f"__{new}")
        for name, (_, new_columns) in groups.items()
        for i, new in enumerate(new_columns)
    }
    wide = params.groupBy(*by).agg(*fitted.values())

    def score(new: str, columns: Sequence[str]):
        at = lambda part, j: F.get(F.col(f"__{new}.{part}"), F.lit(j))
        terms = [(F.col(c) - at("mean", j)) * at("loadings", j) for j, c in enumerate(columns)]
        return sum(terms[1:], terms[0])

    scores = {new: score(new, columns) for columns, new_columns in groups.values() for new in new_columns}
    inputs = {c for columns, _ in groups.values() for c in columns} if drop_inputs else set()
    joined = df.join(small_side(wide), by, "left").withColumns(scores)
    return joined.select(*[c for c in df.columns if c not in inputs], *scores)


def fit_pca(df: DataFrame, columns: Sequence[str], n_components: int, by: Sequence[str] = ("station_id",)) -> DataFrame:
    """Components of one column group: ``(by.., component, mean, loadings, variance)``."""
    return fit_pca_groups(df, {"": (columns, [str(i) for i in range(n_components)])}, by).drop("group")


def apply_pca(
    df: DataFrame,
    params: DataFrame,
    columns: Sequence[str],
    new_columns: Sequence[str],
    by: Sequence[str] = ("station_id",),
    drop_inputs: bool = True,
) -> DataFrame:
    """Scores of one column group."""
    return apply_pca_groups(df, params.withColumn("group", F.lit("")), {"": (columns, new_columns)}, by, drop_inputs)


def solve_ridge(n: float, mean: np.ndarray, cov: np.ndarray, alpha: float) -> np.ndarray:
    """``[intercept, coefficients..]`` of the last variable on the others; the penalty excludes the intercept."""
    inputs = cov[:-1, :-1] + np.eye(len(mean) - 1) * (alpha / n)
    slope = np.linalg.lstsq(inputs, cov[:-1, -1], rcond=None)[0]
    return np.concatenate([[mean[-1] - slope @ mean[:-1]], slope])


def _squared_error(mean: np.ndarray, cov: np.ndarray, model: np.ndarray) -> float:
    """Mean squared error of a linear model on data known by its moments only."""
    direction = np.concatenate([-model[1:], [1.0]])
    bias = direction @ mean - model[0]
    return float(direction @ cov @ direction + bias * bias)


def _merge(parts: list[tuple[float, np.ndarray, np.ndarray]]) -> tuple[float, np.ndarray, np.ndarray]:
    """Moments of the union of disjoint row sets."""
    n = sum(p[0] for p in parts)
    mean = sum(p[0] * p[1] for p in parts) / n
    cov = sum(p[0] * (p[2] + np.outer(p[1] - mean, p[1] - mean)) for p in parts) / n
    return n, mean, cov


def fit_linear(
    df: DataFrame, features: Sequence[str], target: str, by: Sequence[str] = ("station_id",), alpha: float = 0.0
) -> DataFrame:
    """Least squares (ridge for ``alpha > 0``) for every group in one job: ``(by.., n, intercept, coefficients)``."""
    moments = grouped_moments(df, by, [*features, target])
    schema = T.StructType(
        [moments.schema[c] for c in by]
        + [T.StructField("n", T.LongType()), T.StructField("intercept", T.DoubleType()), T.StructField("coefficients", DOUBLES)]
    )
    keys, width = list(by), len(features) + 1

    def solve(batches):
        for rows in batches:
            models = [
                solve_ridge(n, np.asarray(m), np.asarray(c).reshape(width, width), alpha)
                for n, m, c in zip(rows["n"], rows["mean"], rows["cov"])
            ]
            out = rows[[*keys, "n"]].copy()
            out["intercept"] = [m[0] for m in models]
            out["coefficients"] = [m[1:] for m in models]
            yield out

    return moments.mapInPandas(solve, schema)


def predict_linear(
    df: DataFrame, models: DataFrame, features: Sequence[str], by: Sequence[str] = ("station_id",), name: str = "pred"
) -> DataFrame:
    chosen = small_side(models.select(*by, "intercept", "coefficients"))
    terms = [F.col(c) * F.get("coefficients", F.lit(i)) for i, c in enumerate(features)]
    joined = df.join(chosen, list(by)).withColumn(name, sum(terms, F.col("intercept")))
    return joined.select(*df.columns, name)


def _fold_moments(df, features, target, by, order, k):
    folds = contiguous_folds(df.dropna("any", subset=[*features, target]), by, order, k)
    return grouped_moments(folds, [*by, "fold"], [*features, target])


def cross_validated_linear(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    order: Sequence[str],
    alphas: Sequence[float] = (0.0,),
    k: int = 5,
    refit: bool = True,
    by: Sequence[str] = ("station_id",),
) -> DataFrame:
    """K-fold search over ridge penalties for every group, from one pass over the data.

    The moments of each fold are enough both to fit on the other folds and to
    score on the held-out one. The penalty with the lowest mean held-out error
    wins. ``refit`` fits it on all rows (grid search); otherwise the model of its
    best single fold is kept (cross validation).
    Result: ``(by.., alpha, mse, fold_mse, intercept, coefficients)``.
    """
    moments = _fold_moments(df, features, target, list(by), order, k)
    keys, width = list(by), len(features) + 1
    schema = T.StructType(
        [moments.schema[c] for c in by]
        + [
            T.StructField("alpha", T.DoubleType()),
            T.StructField("mse", T.DoubleType()),
            T.StructField("fold_mse", DOUBLES),
            T.StructField("intercept", T.DoubleType()),
            T.StructField("coefficients", DOUBLES),
        ]
    )
    penalties = [float(a) for a in alphas]

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("fold")
        parts = [
            (float(n), np.asarray(m), np.asarray(c).reshape(width, width))
            for n, m, c in zip(rows["n"], rows["mean"], rows["cov"])
        ]
        if len(parts) < 2:
            return pd.DataFrame(columns=schema.names)
        best = None
        for alpha in penalties:
            models = [solve_ridge(*_merge(parts[:i] + parts[i + 1 :]), alpha) for i in range(len(parts))]
            errors = [_squared_error(p[1], p[2], m) for p, m in zip(parts, models)]
            if best is None or np.mean(errors) < best[1]:
                model = solve_ridge(*_merge(parts), alpha) if refit else models[int(np.argmin(errors))]
                best = (alpha, float(np.mean(errors)), errors, float(model[0]), list(model[1:]))
        head = [rows[c].iloc[0] for c in keys]
        return pd.DataFrame([[*head, *best]], columns=schema.names)

    # One row per fold: each group that reaches a task has at most k rows.
    return moments.groupBy(*by).applyInPandas(search, schema)


def _subtract(whole: tuple[float, np.ndarray, np.ndarray], part: tuple[float, np.ndarray, np.ndarray]) -> tuple[float, np.ndarray, np.ndarray]:
    """Moments of the rows of ``whole`` that are not in ``part``."""
    n = whole[0] - part[0]
    mean = (whole[0] * whole[1] - part[0] * part[1]) / n
    between = np.outer(part[1] - mean, part[1] - mean) * (part[0] * n / whole[0])
    return n, mean, (whole[0] * whole[2] - part[0] * part[2] - between) / n


def searched_linear(
    df: DataFrame,
    subsets: Sequence[Sequence[str]],
    target: str,
    keys: Sequence[str],
    order: Sequence[str],
    alphas: Sequence[float] = (0.0,),
    k: int = 5,
    by: Sequence[str] = (),
) -> DataFrame:
    """Exhaustive k-fold search over feature subsets and ridge penalties, from one pass over the rows.

    Each fold's moments of all features are added up once. Those of the other
    folds are the total's without the fold's own, and a subset's moments are a
    part of the matrix, so no candidate costs another pass. Folds are
    contiguous within ``keys``, as everywhere. One row per ``by`` group (none:
    all rows are pooled), subset and penalty: ``(by.., features, alpha, mse,
    fold_mse, best)``; ``best`` marks the smallest mean error, the earlier
    candidate of equal ones. Rows with a null in any used column are left out;
    a group needs rows in two folds.
    """
    features = list(dict.fromkeys(c for s in subsets for c in s))
    used = [*features, target]
    folds = contiguous_folds(df.dropna("any", subset=used), list(keys), order, k)
    moments = grouped_moments(folds, [*by, "fold"], used)
    width, places = len(used), [[features.index(c) for c in s] + [len(features)] for s in subsets]
    schema = T.StructType(
        [moments.schema[c] for c in by]
        + [
            T.StructField("features", T.ArrayType(T.StringType())),
            T.StructField("alpha", T.DoubleType()),
            T.StructField("mse", T.DoubleType()),
            T.StructField("fold_mse", DOUBLES),
            T.StructField("best", T.BooleanType()),
        ]
    )
    names, penalties, group = [list(s) for s in subsets], [float(a) for a in alphas], list(by)

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("fold")
        parts = [(float(n), np.asarray(m), np.asarray(c).reshape(width, width)) for n, m, c in zip(rows["n"], rows["mean"], rows["cov"])]
        if len(parts) < 2:
            return pd.DataFrame(columns=schema.names)
        whole = _merge(parts)
        others = [_subtract(whole, p) for p in parts]
        found = []
        for name, at in zip(names, places):
            for alpha in penalties:
                models = [solve_ridge(n, mean[at], cov[np.ix_(at, at)], alpha) for n, mean, cov in others]
                errors = [_squared_error(p[1][at], p[2][np.ix_(at, at)], m) for p, m in zip(parts, models)]
                found.append([name, alpha, float(np.mean(errors)), errors])
        first = min(range(len(found)), key=lambda i: found[i][2])
        head = [rows[c].iloc[0] for c in group]
        return pd.DataFrame([[*head, *f, i == first] for i, f in enumerate(found)], columns=schema.names)

    return moments.groupBy(*by).applyInPandas(search, schema)
