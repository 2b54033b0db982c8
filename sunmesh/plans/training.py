"""Training, search, stacking and batch inference with Spark ML on the pooled table of all stations.

One model is fitted on the rows of all stations, with the site described by
input columns, so the work is spread by rows and not by station. Models per
station are the linear ones of ``operators.moments``, fitted for all stations in one job.
"""

from __future__ import annotations

import json
import random
from collections.abc import Mapping, Sequence

from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunmesh.operators.ordered import contiguous_folds
from sunmesh.operators.scaling import invert_scaler
from sunmesh.operators.sizing import small_side
from sunmesh.plans import boosting
from sunmesh.plans.extra_trees import ExtraTreesRegressor
from sunmesh.plans.ledger import best_trial, run_trials
from sunmesh.schemas import MODEL_NAMES
from sunmesh.session import shared_folder
from sunmesh.sources.registry import parse_params
from sunmesh.sources.tables import materialise

# Names of the tuned parameters and their Spark counterparts.
PARAMETERS = {
    "n_estimators": {"rf": "numTrees", "extr": "numTrees", "xgb": "maxIter"},
    "min_samples_leaf": {"rf": "minInstancesPerNode", "extr": "minInstancesPerNode"},
    "max_features": {"rf": "featureSubsetStrategy", "extr": "featureSubsetStrategy"},
    "max_depth": {"rf": "maxDepth", "extr": "maxDepth", "xgb": "maxDepth"},
    "eta": {"xgb": "stepSize"},
    "gamma": {"xgb": "minInfoGain"},
    "subsample": {"xgb": "subsamplingRate"},
    "min_child_weight": {"xgb": "minInstancesPerNode"},
    "alpha": {"linear": "regParam"},
}
_VALUES = {"auto": "all"}

# Search grids, the default first.
GRIDS = {
    "rf": {
        "min_samples_leaf": [1, 10, 50, 150, 500],
        "max_features": ["auto", "sqrt"],
        "n_estimators": [100, 150, 200, 400],
    },
    "extr": {
        "min_samples_leaf": [1, 10, 50, 150, 500],
        "max_features": ["auto", "sqrt"],
        "n_estimators": [100, 150, 200, 400],
    },
    "xgb": {
        "eta": [0.3, 0.1, 0.15, 0.35],
        "gamma": [0, 0.05, 0.01],
        "max_depth": [6, 8, 10, 12],
    },
}

# Ranges of the random search over the boosted model, as (low, high, step); a step of 0 is continuous.
SEARCH_SPACE = {
    "n_estimators": (100, 1000, 100),
    "eta": (0.0001, 0.5, 0),
    "max_depth": (5, 16, 1),
    "subsample": (0.00001, 1.0, 0),
    "min_child_weight": (1, 10, 1),
}


def estimator(algorithm: str, params: Mapping | None = None, prediction: str = "pred") -> Estimator:
    """``linear``, ``rf``, ``extr`` (all rows, random cut points) or ``xgb`` (boosted trees) on ``features`` / ``label``."""
    common = {"featuresCol": "features", "labelCol": "label", "predictionCol": prediction}
    if algorithm == "linear":
        chosen = LinearRegression(**common)
    elif algorithm == "rf":
        chosen = RandomForestRegressor(seed=7, **common)
    elif algorithm == "extr":
        chosen = ExtraTreesRegressor(seed=7, **common)
    elif algorithm == "xgb":
        chosen = GBTRegressor(seed=7, **common)
    else:
        raise ValueError(f"algorithm {algorithm!r} is not one of linear, rf, extr, xgb")
    for name, value in spark_parameters(algorithm, params or {}).items():
        chosen.set(chosen.getParam(name), chosen.getParam(name).typeConverter(value))
    return chosen


def spark_parameters(algorithm: str, params: Mapping) -> dict:
    """Tuned parameters under their Spark names; null ones and those without a counterpart are left out."""
    known = {n: PARAMETERS[n][algorithm] for n in params if n in PARAMETERS and algorithm in PARAMETERS[n]}
    numbers = {n: _VALUES.get(params[n], params[n]) for n in known if params[n] is not None}
    return {known[n]: _number(v) for n, v in numbers.items()}


def _number(value):
    if not isinstance(value, str) or value.isalpha():
        return value
    return float(value) if "." in value or "e" in value else int(value)


def best_estimator(winners: DataFrame, station_id, algorithm: str, key: str = "station_id") -> Estimator:
    """Estimator with the parameters of a station's best run of ``algorithm``; ``winners`` holds one run per pair."""
    model = MODEL_NAMES.get(algorithm, algorithm)
    row = winners.where((F.col(key) == station_id) & (F.col("model") == model)).select(parse_params(F.col("params"))).first()
    if row is None:
        raise ValueError(f"station {station_id} has no result of {model}")
    return estimator(algorithm, row[0])


def assemble(df: DataFrame, features: Sequence[str], label: str | None = None) -> DataFrame:
    """Add the vector column ``features`` and, if given, ``label``; rows with a null in them are left out."""
    used = [*features, *([label] if label else [])]
    ready = VectorAssembler(inputCols=list(features), outputCol="features").transform(df.dropna("any", subset=used))
    return ready.withColumn("label", F.col(label).cast("double")) if label else ready


def _evaluator(prediction: str = "pred", metric: str = "mse") -> RegressionEvaluator:
    return RegressionEvaluator(predictionCol=prediction, labelCol="label", metricName=metric)


def param_grid(chosen: Estimator, algorithm: str, grid: Mapping[str, Sequence]) -> list:
    builder = ParamGridBuilder()
    for name, values in grid.items():
        mapped = [spark_parameters(algorithm, {name: v}) for v in values]
        param = chosen.getParam(next(iter(mapped[0])))
        builder = builder.addGrid(param, [param.typeConverter(next(iter(m.values()))) for m in mapped])
    return builder.build()


def _few_tasks(stored: DataFrame, rows_per_task: int = 20_000) -> DataFrame:
    """A stored table in as many tasks as its rows need: a tree's levels are many short jobs."""
    return stored.coalesce(stored.count() // rows_per_task + 1)


def cross_validated(
    rows: DataFrame, algorithm: str, params: Mapping | None, keys: Sequence[str], order: Sequence[str], k: int = 5
) -> tuple[Model, list[float]]:
    """Model of the fold with the lowest held-out squared error, and the errors of all folds."""
    folded = materialise(contiguous_folds(rows, keys, order, k), "folds")
    fits = []
    for fold in range(k):
        model = estimator(algorithm, params).fit(folded.where(F.col("fold") != fold))
        fits.append((_evaluator().evaluate(model.transform(folded.where(F.col("fold") == fold))), fold, model))
    return min(fits, key=lambda f: f[:2])[2], [f[0] for f in fits]


def grid_searched(
    rows: DataFrame,
    algorithm: str,
    grid: Mapping[str, Sequence],
    keys: Sequence[str],
    order: Sequence[str],
    k: int = 5,
    parallelism: int = 8,
    params: Mapping | None = None,
) -> tuple[Model, dict]:
    """Model with the best mean held-out squared error, refitted on all rows, and its parameters."""
    chosen = estimator(algorithm, params)
    maps = param_grid(chosen, algorithm, grid)
    folded = materialise(contiguous_folds(rows.select(*keys, *order, "features", "label"), keys, order, k), "folds")
    if algorithm == "xgb" and folded.count() <= boosting.GROUP_ROWS:
        # Fit i is parameter set i // k without fold i % k.
        errors = boosting.held_out_errors(folded, [chosen.copy(m) for m in maps for _ in range(k)], F.col("fit") % k != F.col("fold"))
        errors = [sum(errors[i * k : i * k + k]) / k for i in range(len(maps))]
        best = maps[min(range(len(maps)), key=errors.__getitem__)]
        return chosen.fit(_few_tasks(folded), best), {p.name: v for p, v in best.items()}
    search = CrossValidator(
        estimator=chosen, estimatorParamMaps=maps, evaluator=_evaluator(), numFolds=k, foldCol="fold", parallelism=parallelism
    )
    fitted = search.fit(_few_tasks(folded))
    best = maps[min(range(len(maps)), key=lambda i: fitted.avgMetrics[i])]
    return fitted.bestModel, {p.name: v for p, v in best.items()}


def random_trials(space: Mapping[str, tuple], trials: int, seed: int) -> list[dict]:
    """Parameter sets drawn uniformly from ``space``, repeatable by ``seed``."""
    draw = random.Random(seed)
    pick = lambda low, high, step: draw.randrange(low, high + 1, step) if step else draw.uniform(low, high)
    return [{name: pick(*bounds) for name, bounds in space.items()} for _ in range(trials)]


def random_searched(
    rows: DataFrame,
    ledger: str,
    algorithm: str = "xgb",
    space: Mapping[str, tuple] = SEARCH_SPACE,
    trials: int = 20,
    seed: int = 7,
    train_ratio: float = 0.75,
    parallelism: int = 4,
    target_scale: float = 1.0,
    limit: float | None = None,
) -> tuple[Model, dict, float]:
    """Best of the library's defaults and ``trials`` random parameter sets on one random split, refitted on all rows.

    Trials are rows of the ledger at ``ledger``; a search that was broken off
    goes on with those that are missing, on the same stored split. ``limit`` ends it
    after so many seconds. The error is in original target units.
    """
    spark = rows.sparkSession
    drawn = [{}, *random_trials(space, trials, seed)]
    # Drawn from the rows' values, so that neither their order nor a restart changes the halves.
    drawn_by = F.pmod(F.xxhash64(F.lit(seed), vector_to_array("features"), "label"), F.lit(10_000))
    halves = materialise(rows.select("features", "label", (drawn_by < int(train_ratio * 10_000)).alias("train")), "split")
    if algorithm == "xgb" and halves.count() <= boosting.GROUP_ROWS:

        def evaluate(params: Mapping) -> float:
            return boosting.held_out_errors(halves, [estimator(algorithm, params)], F.col("train"))[0] ** 0.5 * target_scale

        best, error = best_trial(run_trials(spark, ledger, drawn, evaluate, limit, parallelism), drawn)
        return boosting.fitted(halves, estimator(algorithm, best)), best, error
    halves = _few_tasks(halves).persist()
    train, held = halves.where("train"), halves.where("not train")

    def evaluate_in_tasks(params: Mapping) -> float:
        return _evaluator(metric="rmse").evaluate(estimator(algorithm, params).fit(train).transform(held)) * target_scale

    best, error = best_trial(run_trials(spark, ledger, drawn, evaluate_in_tasks, limit, parallelism), drawn)
    model = estimator(algorithm, best).fit(halves)
    halves.unpersist()
    return model, best, error


def stacked(
    rows: DataFrame,
    bases: Mapping[str, Mapping],
    keys: Sequence[str],
    order: Sequence[str],
    final: str = "linear",
    final_params: Mapping | None = None,
    k: int = 5,
) -> PipelineModel:
    """Stack of base models and a final one that learns from their out-of-fold predictions.

    ``bases`` maps each algorithm to its parameters. Every row is predicted by base
    models that have not seen it. The bases are then refitted on all rows; the
    result is one pipeline from ``features`` to ``pred``.
    """
    shared_folder(rows.sparkSession)
    folded = _few_tasks(materialise(contiguous_folds(rows.select(*keys, *order, "features", "label"), keys, order, k), "folds")).persist()
    columns = [f"pred_{name}" for name in bases]
    unseen = None
    for fold in range(k):
        others, held = folded.where(F.col("fold") != fold), folded.where(F.col("fold") == fold)
        for name, params in bases.items():
            held = estimator(name, params, f"pred_{name}").fit(others).transform(held)
        held = held.select("label", *columns)
        unseen = held if unseen is None else unseen.unionByName(held)
    # The final learner passes over these rows many times; the checkpoint frees it from all base models.
    level_two = VectorAssembler(inputCols=columns, outputCol="stacked")
    unseen = level_two.transform(unseen).select("stacked", "label").checkpoint()
    last = estimator(final, final_params)
    last.setFeaturesCol("stacked")
    fitted_last = last.fit(unseen)
    fitted_bases = [estimator(name, params, f"pred_{name}").fit(folded) for name, params in bases.items()]
    folded.unpersist()
    return PipelineModel([*fitted_bases, level_two, fitted_last])


def looked_up(winners: DataFrame, algorithms: Sequence[str], key: str = "station_id") -> DataFrame:
    """``(key, params)``: each station's best parameters of every algorithm as one text, equal for equal parameters.

    ``winners`` holds one run per station and model; an algorithm without a run
    has its defaults.
    """
    names = {MODEL_NAMES.get(a, a): a for a in algorithms}
    pairs = F.array_sort(F.map_entries(parse_params(F.col("params"))))
    found = winners.where(F.col("model").isin(list(names))).groupBy(key).pivot("model", list(names)).agg(F.max(pairs))
    return found.select(key, F.to_json(F.struct(*[F.map_from_entries(F.col(m)).alias(a) for m, a in names.items()])).alias("params"))


def stacked_with_best(
    rows: DataFrame,
    winners: DataFrame,
    algorithms: Sequence[str],
    keys: Sequence[str],
    order: Sequence[str],
    key: str = "station_id",
    final: str = "linear",
    k: int = 5,
) -> tuple[dict[str, PipelineModel], DataFrame]:
    """A stack for every distinct set of looked-up parameters, fitted on the stations that share it, and all predictions.

    Stations with equal best parameters are one group and one pipeline, so there
    are as many fits as distinct sets. Stations without a run of their own share
    the defaults. Predictions are ``rows`` with ``pred``.
    """
    marked = rows.join(small_side(looked_up(winners, algorithms, key)), key, "left").withColumn("__params", F.coalesce("params", F.lit("{}"))).drop("params")
    marked = materialise(marked, "parameter-sets")
    models, predicted = {}, None
    # One short text per distinct parameter set.
    for text in sorted(r[0] for r in marked.select("__params").distinct().collect()):
        chosen = json.loads(text)
        own = marked.where(F.col("__params") == text).drop("__params")
        models[text] = stacked(own, {a: chosen.get(a) or {} for a in algorithms}, keys, order, final, k=k)
        part = models[text].transform(own).select(*rows.columns, "pred")
        predicted = part if predicted is None else predicted.unionByName(part)
    return models, predicted if predicted is not None else rows.withColumn("pred", F.lit(None).cast("double"))


def batch_inference(
    model: Model,
    df: DataFrame,
    features: Sequence[str],
    sites: DataFrame,
    target_params: DataFrame | None = None,
    target: str = "target",
    key: str = "station_id",
) -> DataFrame:
    """``station_id, ts, pred, lat, lon`` for every complete row; ``target_params`` undo the target's scaling."""
    predicted = model.transform(assemble(df, features)).select(key, "ts", "pred")
    if target_params is not None:
        predicted = invert_scaler(predicted, target_params, {"pred": target}, [key])
    return predicted.join(small_side(sites.select(key, "lat", "lon")), key)
