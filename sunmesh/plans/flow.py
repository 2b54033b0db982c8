"""Training, registry, predictions, winners and blend of all stations and data sets as one flow of tables.

A fitted model is a row: its coefficients are scored by an equi-join with the
rows of its station and data set. Nothing is fitted, stored or looked up
station by station.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sunmesh.operators.metrics import regression_metrics
from sunmesh.operators.moments import DOUBLES, grouped_moments, solve_ridge
from sunmesh.operators.ranking import best_by_algorithm, best_by_station, blend
from sunmesh.operators.sizing import small_side
from sunmesh.sources.tables import materialise

KEYS = ["dataset", "station_id"]
SCORES = ["rmse", "mae", "mape", "mbe", "r2"]


@dataclass(frozen=True)
class Candidate:
    """A linear model to be fitted for every station: its inputs and ridge penalty."""

    features: Sequence[str]
    alpha: float = 0.0

    @property
    def params(self) -> str:
        return json.dumps({"alpha": self.alpha, "features": list(self.features)}, sort_keys=True)


@dataclass(frozen=True)
class Flow:
    """The tables of one training run."""

    #: ``dataset, station_id, model, timestamp, params, n, intercept, coefficients``: the registry, models included.
    models: DataFrame
    #: ``dataset, station_id, ts, model, pred, real`` of all models on the test rows.
    predictions: DataFrame
    #: One row of scores per model.
    results: DataFrame
    #: Best run per data set, station and algorithm; best run per data set and station; better one of both data sets.
    by_algorithm: DataFrame
    by_station: DataFrame
    blended: DataFrame = field(repr=False)

    def winning_predictions(self) -> DataFrame:
        """Test rows as the blended winners predict them."""
        dataset = F.when(F.col("is_interp"), F.lit("imputed")).otherwise(F.lit("original"))
        chosen = small_side(self.blended.select(dataset.alias("dataset"), "station_id", "model", "rmse", "is_interp"))
        return self.predictions.join(chosen, [*KEYS, "model"])


def fit_candidates(df: DataFrame, candidates: Mapping[str, Candidate], target: str, by: Sequence[str] = KEYS, min_rows: int = 2) -> DataFrame:
    """``(by.., model, params, n, intercept, coefficients)``: all candidates of all groups, from one pass of partial sums.

    Coefficients stand in the order of ``all_features(candidates)``, 0 for
    inputs that a candidate hasn't. Rows with a null in any input or the target don't
    count; groups of fewer than ``min_rows`` rows have no model.
    """
    features = all_features(candidates)
    moments = grouped_moments(df.dropna("any", subset=[*features, target]), by, [*features, target]).where(F.col("n") >= min_rows)
    chosen = [(name, c.params, c.alpha, [features.index(f) for f in c.features]) for name, c in candidates.items()]
    keys, width = list(by), len(features) + 1
    schema = T.StructType(
        [moments.schema[c] for c in by]
        + [T.StructField("model", T.StringType()), T.StructField("params", T.StringType()), T.StructField("n", T.LongType())]
        + [T.StructField("intercept", T.DoubleType()), T.StructField("coefficients", DOUBLES)]
    )

    def solve(batches):
        for rows in batches:
            found = []
            for head in rows.itertuples(index=False):
                mean, cov = np.asarray(head.mean), np.asarray(head.cov).reshape(width, width)
                for name, params, alpha, at in chosen:
                    used = [*at, width - 1]
                    model = solve_ridge(head.n, mean[used], cov[np.ix_(used, used)], alpha)
                    coefficients = np.zeros(width - 1)
                    coefficients[at] = model[1:]
                    found.append([*(getattr(head, k) for k in keys), name, params, head.n, model[0], coefficients])
            yield pd.DataFrame(found, columns=schema.names)

    return moments.mapInPandas(solve, schema)


def all_features(candidates: Mapping[str, Candidate]) -> list[str]:
    return list(dict.fromkeys(f for c in candidates.values() for f in c.features))


def score_candidates(rows: DataFrame, models: DataFrame, features: Sequence[str], target: str, by: Sequence[str] = KEYS) -> DataFrame:
    """Every row of ``rows`` as every model of its group predicts it: one equi-join."""
    terms = [F.col(c) * F.get("coefficients", F.lit(i)) for i, c in enumerate(features)]
    joined = rows.dropna("any", subset=[*features, target]).join(small_side(models.select(*by, "model", "intercept", "coefficients")), list(by))
    return joined.select(*by, "ts", "model", sum(terms, F.col("intercept")).alias("pred"), F.col(target).alias("real"))


def train_and_select(
    train: DataFrame,
    test: DataFrame,
    candidates: Mapping[str, Candidate],
    target: str,
    timestamp: str,
    min_rows: int = 2,
    criterion: str = "rmse",
    digits: int = 6,
) -> Flow:
    """Fit all candidates on ``train``, score them on ``test`` and choose, for all stations and both data sets at once.

    Both tables have ``dataset`` (``original`` or ``imputed``), ``station_id``,
    ``ts``, inputs and target. Scores are ranked as they are reported, rounded
    to ``digits``: equal ones of the two data sets then go to the original.
    ``timestamp`` names the run in registry and results.
    """
    fitted = fit_candidates(train, candidates, target, min_rows=min_rows).withColumn("timestamp", F.lit(timestamp))
    models = materialise(fitted, "models")
    predictions = score_candidates(test, models, all_features(candidates), target)
    scored = regression_metrics(predictions, [*KEYS, "model"], names=SCORES).withColumns({s: F.round(s, digits) for s in SCORES})
    known = models.select(*KEYS, "model", "timestamp", "params")
    # Scores are station-sized and read by every choice after them.
    results = materialise(scored.join(known, [*KEYS, "model"]), "results")
    by_station = best_by_station(results, KEYS, criterion)
    columns = ["model", "timestamp", *SCORES, "params"]
    pick = lambda name: by_station.where(F.col("dataset") == name).drop("dataset")
    blended = materialise(blend(pick("imputed"), pick("original"), columns), "blended")
    return Flow(models, predictions, results, best_by_algorithm(results, [*KEYS, "model"], criterion), by_station, blended)
