import datetime as dt
import inspect
import random
import time

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from sunmesh.operators.metrics import regression_metrics
from sunmesh.operators.moments import searched_linear
from sunmesh.operators.ordered import contiguous_folds
from sunmesh.plans import boosting
from sunmesh.plans import flow as fl
from sunmesh.plans import training as tr
from sunmesh.plans.extra_trees import COPIES
from sunmesh.plans.ledger import best_trial, read_ledger, run_trials
from sunmesh.session import scratch_path
from sunmesh.sources import registry as rg
from workload import REGISTERED


@pytest.fixture(scope="module")
def rows(spark):
    draw = random.Random(9)
    data = []
    for s in ("a", "b", "c"):
        for i in range(80):
            x, z = draw.uniform(0, 10), draw.uniform(0, 10)
            data.append((s, dt.datetime(2020, 1, 1) + dt.timedelta(hours=i), x, z, 3 * x - z + (5 if x > 5 else 0)))
    df = spark.createDataFrame(data, "station_id string, ts timestamp_ntz, x double, z double, y double")
    return tr.assemble(df, ["x", "z"], "y").persist()


def _rmse(model, rows):
    return regression_metrics(model.transform(rows), [], real="label", names=["rmse"]).first().rmse


def test_stacking_is_better_than_its_worst_base_and_can_be_stored(spark, rows):
    bases = {"linear": {}, "rf": {"n_estimators": 10, "max_depth": 4}}
    model = tr.stacked(rows, bases, ["station_id"], ["ts"], k=3)
    single = [_rmse(tr.estimator(n, p).fit(rows), rows) for n, p in bases.items()]
    assert _rmse(model, rows) < max(single)
    entry = rg.save_model(model, scratch_path(spark, "store"), "original", "a", "StackingRegressor", "2024-01-01-00-00-00", {})
    assert _rmse(rg.load_model(entry["path"]), rows) == pytest.approx(_rmse(model, rows))


def test_grid_search_picks_the_better_depth(rows):
    _, best = tr.grid_searched(rows, "rf", {"max_depth": [1, 6]}, ["station_id"], ["ts"], 3, params={"n_estimators": 5})
    assert best == {"maxDepth": 6}


@pytest.fixture
def jobs(spark):
    """Runs a function and tells how many Spark jobs it took, up to the 1,000 that Spark remembers."""

    def count(run):
        spark.sparkContext.setJobGroup("counted", "")
        try:
            run()
            time.sleep(1)
            return len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

    return count


def test_grid_search_over_boosted_trees_takes_a_job_for_all_fits(rows, jobs, monkeypatch):
    grid, found = {"eta": [0.3, 0.1], "gamma": [0, 0.05], "max_depth": [1, 2]}, []
    search = lambda: found.append(tr.grid_searched(rows, "xgb", grid, ["station_id"], ["ts"], 3))
    # The refit has 20 trees of a few jobs each; 24 fits had as many each.
    assert jobs(search) < 150
    monkeypatch.setattr(boosting, "GROUP_ROWS", 10)
    search()
    assert found[0][1] == found[1][1] and _rmse(found[0][0], rows) == pytest.approx(_rmse(found[1][0], rows))


def test_random_search_has_no_job_for_each_level_of_a_tree(spark, rows, monkeypatch):
    def fails(*_):
        raise AssertionError("a fit of many short jobs")

    monkeypatch.setattr(boosting.GBTRegressor, "_fit", fails)
    space = {"n_estimators": (100, 200, 50), "max_depth": (8, 12, 1), "subsample": (0.3, 1.0, 0), "min_child_weight": (1, 10, 1)}
    ledger = scratch_path(spark, "ledger")
    model, _, error = tr.random_searched(rows, ledger, "xgb", space, trials=3)
    assert read_ledger(spark, ledger).count() == 4 and 0 < _rmse(model, rows) < 2 * error


@pytest.mark.parametrize("params", [{}, {"eta": 0.3, "gamma": 0.05, "max_depth": 9}, {"min_child_weight": 7, "n_estimators": 3}, {"max_depth": 1}, {"n_estimators": 1}])
def test_grouped_trees_are_those_of_spark(spark, params):
    draw = random.Random(4)
    points = [[draw.uniform(0, 1), float(draw.randrange(12)), 3.0, -draw.expovariate(1)] for _ in range(700)]
    data = spark.createDataFrame([(Vectors.dense(x), x[0] * x[1] + x[3] + draw.gauss(0, 1), i % 3 > 0) for i, x in enumerate(points)], ["features", "label", "train"]).coalesce(1).persist()
    fit = tr.estimator("xgb", params)
    pick = lambda model: [r.pred for r in model.transform(data).orderBy("label").collect()]
    assert pick(boosting.fitted(data, fit)) == pytest.approx(pick(fit.fit(data)), rel=1e-9)
    own = fit.fit(data.where("train")).transform(data.where("not train"))
    expected = own.agg(F.avg((F.col("pred") - F.col("label")) ** 2)).first()[0]
    assert boosting.held_out_errors(data, [fit, fit], F.col("train")) == pytest.approx([expected] * 2)


def test_grouped_trees_on_odd_rows(spark):
    same = spark.createDataFrame([(Vectors.dense([1.0, 2.0]), 4.0)] * 5, ["features", "label"])
    fit = tr.estimator("xgb", {"subsample": 0.00001})
    assert [r.pred for r in boosting.fitted(same, tr.estimator("xgb")).transform(same).collect()] == [4.0] * 5
    # Trees that draw no row say nothing.
    assert [r.pred for r in boosting.fitted(same, fit).transform(same).collect()] == [0.0] * 5
    assert boosting.fitted(same, fit).transform(same.where("label < 0")).count() == 0
    for none in (same.where("label < 0"), same):
        with pytest.raises(Exception, match="no rows to learn from"):
            boosting.held_out_errors(none, [fit], F.lit(True))
    with pytest.raises(ValueError):
        boosting.fitted(same.where("label < 0"), fit)


def test_random_search_is_repeatable_and_in_original_units(spark, rows):
    space = {"n_estimators": (2, 4, 1), "max_depth": (1, 4, 1)}
    _, first, error = tr.random_searched(rows, scratch_path(spark, "ledger"), "xgb", space, trials=3, seed=5)
    _, second, scaled = tr.random_searched(rows, scratch_path(spark, "ledger"), "xgb", space, trials=3, seed=5, target_scale=10.0)
    # Rows come in another order; equal splits may then go another way.
    assert first == second and scaled == pytest.approx(10 * error, rel=0.05)


def test_ledger_goes_on_after_a_broken_run(spark):
    path, trials, asked = scratch_path(spark, "ledger"), [{"a": i} for i in range(6)], []

    def evaluate(params):
        asked.append(params["a"])
        if params["a"] == 3 and len(asked) < 6:
            raise RuntimeError("lost")
        return abs(params["a"] - 4) + 0.5

    with pytest.raises(RuntimeError):
        run_trials(spark, path, trials, evaluate, parallelism=1)
    first = {r.trial for r in read_ledger(spark, path).collect()}
    assert {0, 1, 2} <= first and 3 not in first
    # A writer that was lost before it finished has left a folder without a mark.
    spark.range(1).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{path}/trial=3")
    before = list(asked)
    asked += [None] * 6
    ledger = run_trials(spark, path, trials, evaluate)
    again = asked[len(before) + 6 :]
    assert set(again) == set(range(6)) - first and ledger.count() == 6
    assert best_trial(ledger, trials) == ({"a": 4}, 0.5)
    assert run_trials(spark, path, trials, evaluate).count() == 6 and len(asked) == len(before) + 6 + len(again)
    with pytest.raises(ValueError):
        run_trials(spark, path, [{"a": 9}], evaluate)


def test_a_time_limit_ends_the_search_and_cancels_its_jobs(spark):
    slow = F.udf(lambda x: time.sleep(60) or x, "long")

    def evaluate(params):
        if params["a"]:
            spark.range(2).select(slow("id")).collect()
        return 1.0

    begin = time.monotonic()
    ledger = run_trials(spark, scratch_path(spark, "ledger"), [{"a": 0}, {"a": 1}, {"a": 1}], evaluate, limit=3.0, parallelism=2)
    assert [r.trial for r in ledger.collect()] == [0] and time.monotonic() - begin < 40
    # Without any finished trial the first one still counts.
    alone = run_trials(spark, scratch_path(spark, "ledger"), [{"a": 0}, {"a": 0}], evaluate, limit=0.0, parallelism=1)
    assert alone.count() >= 1


def test_stations_with_equal_parameters_share_a_stack(spark, rows):
    winners = spark.createDataFrame(
        [("a", "linear", '{"alpha": 0.5}'), ("b", "linear", '{"alpha": 0.5}'), ("a", "RandomForestRegressor", '{"max_depth": 2, "n_estimators": 3, "gamma": nan}'),
         ("b", "RandomForestRegressor", '{"n_estimators": 3, "max_depth": 2, "gamma": nan}'), ("z", "linear", '{"alpha": 9}')],
        "station_id string, model string, params string",
    )
    models, predicted = tr.stacked_with_best(rows, winners, ["linear", "rf"], ["station_id"], ["ts"], k=2)
    assert len(models) == 2 and predicted.count() == rows.count()
    shared, defaults = (next(m for t, m in models.items() if ("0.5" in t) == found) for found in (True, False))
    assert [m.getNumTrees for m in shared.stages if hasattr(m, "getNumTrees")] == [3] and [m.getNumTrees for m in defaults.stages if hasattr(m, "getNumTrees")] == [20]
    assert next(m for m in shared.stages if hasattr(m, "coefficients")).getRegParam() == 0.5
    own = rows.where("station_id <> 'c'")
    _, predicted = tr.stacked_with_best(rows, winners, ["linear"], ["station_id"], ["ts"], k=2)
    expected = tr.stacked(own, {"linear": {"alpha": 0.5}}, ["station_id"], ["ts"], k=2).transform(own)
    pick = lambda df: {(r.station_id, r.ts): r.pred for r in df.collect() if r.station_id != "c"}
    assert pick(predicted) == pytest.approx(pick(expected))


def test_subset_and_penalty_search_against_numpy(spark):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(101, 3)) + [5, -2, 0]
    y = x @ [2.0, -1.0, 0.0] + draw.normal(size=101)
    hour = lambda i: dt.datetime(2020, 1, 1) + dt.timedelta(hours=i)
    data = [(hour(i), *map(float, row), float(t)) for i, (row, t) in enumerate(zip(x, y))] + [(hour(500), None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(data, "ts timestamp_ntz, a double, b double, c double, y double").withColumn("station_id", F.lit(1))
    subsets = [["a"], ["b", "a"], ["a", "b", "c"]]
    found = searched_linear(df, subsets, "y", ["station_id"], ["ts"], [0.0, 7.0], k=4).collect()
    folds = np.array([r.fold for r in contiguous_folds(df.dropna(), ["station_id"], ["ts"], 4).orderBy("ts").collect()])
    best = min(found, key=lambda r: r.mse)
    assert len(found) == 6 and [r.best for r in found].count(True) == 1 and best.best
    for r in found:
        at = ["abc".index(c) for c in r.features]
        errors = []
        for fold in range(4):
            train, held = folds != fold, folds == fold
            m = x[train][:, at].mean(axis=0)
            xc = x[train][:, at] - m
            w = np.linalg.solve(xc.T @ xc + r.alpha * np.eye(len(at)), xc.T @ (y[train] - y[train].mean()))
            errors.append(np.mean((y[held] - y[train].mean() - (x[held][:, at] - m) @ w) ** 2))
        assert r.fold_mse == pytest.approx(errors) and r.mse == pytest.approx(np.mean(errors))


def test_flow_keeps_the_better_data_set(spark):
    draw = random.Random(1)
    rows = []
    for dataset, noise in (("original", {"a": 0.1, "b": 5.0}), ("imputed", {"a": 5.0, "b": 0.1, "c": 1.0})):
        for s, n in noise.items():
            rows += [(dataset, s, i, float(i), float(i % 7), 2.0 * i - (i % 7) + draw.gauss(0, n)) for i in range(60)]
    rows.append(("imputed", "d", 0, 1.0, 1.0, 1.0))  # too few rows for a model
    df = spark.createDataFrame(rows, "dataset string, station_id string, ts int, x double, z double, y double")
    candidates = {"one": fl.Candidate(["x"]), "both": fl.Candidate(["x", "z"]), "weak": fl.Candidate(["z"], 10.0)}
    flow = fl.train_and_select(df.where("ts < 40"), df.where("ts >= 40"), candidates, "y", "t", min_rows=2)
    assert {(r.station_id, r.is_interp, r.model) for r in flow.blended.collect()} == {("a", False, "both"), ("b", True, "both"), ("c", True, "both")}
    assert flow.models.count() == 15 and flow.results.count() == 15 and flow.winning_predictions().count() == 60
    model = flow.models.where("dataset = 'original' and station_id = 'a' and model = 'both'").first()
    own = np.array([r[2:] for r in rows if r[:2] == ("original", "a") and r[2] < 40], float)
    expected = np.linalg.lstsq(np.c_[np.ones(40), own[:, 1:3]], own[:, 3], rcond=None)[0]
    assert [model.intercept, *model.coefficients] == pytest.approx(list(expected))


def test_best_estimator_reads_the_registry(spark):
    winners = spark.createDataFrame([("a", "RandomForestRegressor", '{"n_estimators": 150, "max_features": "sqrt", "gamma": nan}')], "station_id string, model string, params string")
    chosen = tr.best_estimator(winners, "a", "rf")
    assert chosen.getNumTrees() == 150 and chosen.getFeatureSubsetStrategy() == "sqrt"
    with pytest.raises(ValueError):
        tr.best_estimator(winners, "b", "rf")
    with pytest.raises(ValueError):
        tr.estimator("svr")


def test_extra_trees_use_all_rows_and_differ(spark):
    draw = random.Random(2)
    points = [[draw.uniform(0, 1) for _ in range(5)] + [3.0] for _ in range(2000)]
    rows = spark.createDataFrame([(Vectors.dense(x), sum(x) + x[0] * x[1]) for x in points], ["features", "label"]).coalesce(2).persist()
    for leaf in tr.GRIDS["extr"]["min_samples_leaf"]:
        for features in tr.GRIDS["extr"]["max_features"]:
            chosen = tr.estimator("extr", {"n_estimators": 6, "min_samples_leaf": leaf, "max_features": features})
            cuts, forest = chosen.fit(rows).stages
            assert forest.getBootstrap() is False and forest.getNumTrees == 6 and forest.getMinInstancesPerNode() == leaf
            assert len({t.toDebugString.split("\n", 1)[1] for t in forest.trees}) > 3
    assert chosen.columns_looked_at(6) == 3 and tr.estimator("extr").columns_looked_at(6) == 6
    other = tr.estimator("extr", {"n_estimators": 6})._set(seed=8).fit(rows).stages[0]
    assert other.getOrDefault("starts") != cuts.getOrDefault("starts")
    # A constant feature is never cut; values beyond the bounds go to the outer cells.
    cut = cuts.transform(spark.createDataFrame([(Vectors.dense([-9.0] * 6),), (Vectors.dense([9.0] * 6),)], ["features"])).select("features_cut").collect()
    assert set(cut[0][0].toArray()) == {0.0} and cut[1][0].toArray()[-COPIES:].tolist() == [0.0] * COPIES
    model = tr.estimator("extr", {"n_estimators": 30, "max_depth": 8}).fit(rows)
    plain = tr.estimator("linear").fit(rows.withColumn("label", F.lit(0.0) + F.col("label") * 0 + 3.0))
    assert _rmse(model, rows) < 0.5 * _rmse(plain, rows)
    entry = rg.save_model(model, scratch_path(spark, "store"), "original", "a", "ExtraTreesRegressor", "2024-01-01-00-00-00", {})
    assert _rmse(rg.load_model(entry["path"]), rows) == pytest.approx(_rmse(model, rows))
    with pytest.raises(KeyError):
        tr.GRIDS["mlp"]


def test_every_grid_entry_has_a_spark_counterpart(spark):
    for algorithm, grid in tr.GRIDS.items():
        size = 1
        for values in grid.values():
            size *= len(values)
        assert len(tr.param_grid(tr.estimator(algorithm), algorithm, grid)) == size


@pytest.mark.parametrize("name", ["i9_pooled_grid_search", "i11_stacking", "i12_random_search", "i18_second_level_model"])
def test_queries_search_whole_grids(spark, monkeypatch, name):
    """Published grid and ranges, five folds, 20 trials, the library's numbers of trees; nothing is fitted here."""
    asked = {}

    class Asked(Exception):
        pass

    def seen(function):
        def call(*args, **kwargs):
            bound = inspect.signature(function).bind(*args, **kwargs)
            bound.apply_defaults()
            asked.update(bound.arguments)
            raise Asked

        return call

    for function in (tr.grid_searched, tr.random_searched, tr.stacked):
        monkeypatch.setattr(tr, function.__name__, seen(function))
    with pytest.raises(Asked):
        REGISTERED[name].run(spark, "/root/testdata/sf0.001")
    assert asked.get("k", 5) == 5 and asked.get("trials", 20) == 20 and not asked.get("params")
    assert asked.get("grid", tr.GRIDS["xgb"]) == tr.GRIDS["xgb"] and asked.get("space", tr.SEARCH_SPACE) == tr.SEARCH_SPACE
    assert not any({"n_estimators", "max_depth"} & set(p) for p in asked.get("bases", {}).values())
