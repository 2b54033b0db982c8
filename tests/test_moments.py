import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sunmesh.operators import moments as mo


def _table(spark, seed=4, offset=0.0):
    draw = random.Random(seed)
    rows = []
    for key, n in (("hot", 300), ("cold", 40)):
        for i in range(n):
            a, b = draw.gauss(0, 3) + offset, draw.gauss(1, 1)
            rows.append((key, dt.datetime(2020, 1, 1) + dt.timedelta(hours=i), a, b, 0.5 * a + b, 2 * a - b + draw.gauss(0, 0.1)))
    rows.append(("hot", dt.datetime(2021, 1, 1), None, 1.0, 1.0, 1.0))
    schema = "station_id string, ts timestamp_ntz, a double, b double, c double, y double"
    return rows, spark.createDataFrame(rows, schema)


def _matrix(rows, key, columns):
    return np.array([[r[i] for i in columns] for r in rows if r[0] == key and r[2] is not None])


@pytest.mark.parametrize("offset", [0.0, 1e6])
def test_pca_equals_numpy(spark, offset):
    rows, df = _table(spark, offset=offset)
    params = mo.fit_pca(df, ["a", "b", "c"], 2).collect()
    scores = mo.apply_pca(df, mo.fit_pca(df, ["a", "b", "c"], 2), ["a", "b", "c"], ["p", "q"])
    assert scores.columns == ["station_id", "ts", "y", "p", "q"]
    assert scores.where("p is null").count() == 1
    for key in ("hot", "cold"):
        x = _matrix(rows, key, (2, 3, 4))
        values = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
        mine = {r.component: r for r in params if r.station_id == key}
        assert np.allclose([mine[0].variance, mine[1].variance], values[:2], rtol=1e-6)
        for component in (0, 1):
            loadings = np.array(mine[component].loadings)
            assert loadings[np.argmax(abs(loadings))] > 0
        spread = scores.where(F.col("station_id") == key).agg(F.avg("p"), F.var_samp("p"), F.covar_samp("p", "q")).first()
        assert abs(spread[0]) < 1e-6 and spread[1] == pytest.approx(values[0]) and abs(spread[2]) < 1e-6


@pytest.mark.parametrize("alpha", [0.0, 5.0])
def test_linear_equals_numpy(spark, alpha):
    rows, df = _table(spark)
    models = {r.station_id: r for r in mo.fit_linear(df, ["a", "b"], "y", alpha=alpha).collect()}
    for key in ("hot", "cold"):
        x, y = _matrix(rows, key, (2, 3)), _matrix(rows, key, (5,)).ravel()
        xc, yc = x - x.mean(axis=0), y - y.mean()
        slope = np.linalg.solve(xc.T @ xc + alpha * np.eye(2), xc.T @ yc)
        assert np.allclose(models[key].coefficients, slope) and models[key].intercept == pytest.approx(y.mean() - x.mean(axis=0) @ slope)


@pytest.mark.parametrize("refit", [True, False])
def test_cross_validation_equals_explicit_folds(spark, refit):
    rows, df = _table(spark)
    alphas = [0.0, 1.0, 50.0]
    found = {r.station_id: r for r in mo.cross_validated_linear(df, ["a", "b"], "y", ["ts"], alphas, 5, refit).collect()}
    for key in ("hot", "cold"):
        x, y = _matrix(rows, key, (2, 3)), _matrix(rows, key, (5,)).ravel()
        folds = np.array_split(np.arange(len(y)), 5)

        def fit(index, alpha):
            xc, yc = x[index] - x[index].mean(axis=0), y[index] - y[index].mean()
            slope = np.linalg.solve(xc.T @ xc + alpha * np.eye(2), xc.T @ yc)
            return y[index].mean() - x[index].mean(axis=0) @ slope, slope

        errors = {}
        for alpha in alphas:
            models = [fit(np.setdiff1d(np.arange(len(y)), f), alpha) for f in folds]
            errors[alpha] = ([np.mean((y[f] - m[0] - x[f] @ m[1]) ** 2) for f, m in zip(folds, models)], models)
        best = min(alphas, key=lambda a: np.mean(errors[a][0]))
        assert found[key].alpha == best and np.allclose(found[key].fold_mse, errors[best][0])
        model = fit(np.arange(len(y)), best) if refit else errors[best][1][int(np.argmin(errors[best][0]))]
        assert found[key].intercept == pytest.approx(model[0]) and np.allclose(found[key].coefficients, model[1])


def test_predictions_follow_the_model(spark):
    _, df = _table(spark)
    predicted = mo.predict_linear(df, mo.fit_linear(df, ["a", "b"], "y"), ["a", "b"])
    assert predicted.where("a is not null").agg(F.max(F.abs(F.col("pred") - F.col("y")))).first()[0] < 0.6
