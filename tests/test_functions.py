import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from sunmesh.functions import text as tx
from sunmesh.functions.radiation import hourly_radiation
from sunmesh.operators import cleaning as cl
from sunmesh.operators import metrics as mt
from sunmesh.operators import ranking as rk
from sunmesh.operators.scaling import apply_scaler, fit_scaler, invert_scaler
from sunmesh.plans.comparison import compare_methods, join_complete
from sunmesh.sources import registry as rg


def _one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "lat, lon, hour, doy, total, correction, expected",
    [
        (-23.5, -46.6, 6, 1, 20000.0, 0.15, 1882.376564475),
        (-23.5, -46.6, 9, 172, 15000.0, 0.15, 2821.950336758),
        (-20.0, -49.0, 15, 300, 22000.0, 0.20, -12.356361069),
    ],
)
def test_radiation_hand_values(spark, lat, lon, hour, doy, total, correction, expected):
    args = [F.lit(v) for v in (lat, lon, hour, -3.0, doy, total)]
    assert _one(spark, hourly_radiation(*args, correction)) == pytest.approx(expected, abs=1e-8)
    assert _one(spark, hourly_radiation(*args, correction, clip=True)) == pytest.approx(max(expected, 0.0), abs=1e-8)


def test_radiation_without_sunset_is_null(spark):
    assert _one(spark, hourly_radiation(*[F.lit(v) for v in (80.0, 0.0, 12, 0.0, 172, 100.0)])) is None


@pytest.mark.parametrize(
    "date, hour, expected",
    [
        ("2019/01/01", "1000 UTC", dt.datetime(2019, 1, 1, 10)),
        ("2018-01-01", "11:00", dt.datetime(2018, 1, 1, 11)),
        ("2018-12-31", " 23:30UTC", dt.datetime(2018, 12, 31, 23, 30)),
        ("2018-13-31", "11:00", None),
        ("2018-12-31", "", None),
        ("2018-12-31", "9999", None),
    ],
)
def test_observation_time(spark, date, hour, expected):
    assert _one(spark, tx.observation_time(F.lit(date), F.lit(hour))) == expected


def test_text_helpers(spark):
    assert _one(spark, tx.decimal_comma(F.lit(",2"))) == 0.2
    assert _one(spark, tx.decimal_comma(F.lit("-23,496"))) == -23.496
    assert _one(spark, tx.decimal_comma(F.lit("n/a"))) is None
    assert _one(spark, tx.title_case(F.lit("SAO-PAULO DO SUL"))) == "Sao-Paulo Do Sul"
    assert _one(spark, tx.title_case(F.lit("x2y ÉVORA"))) == "x2y évora".title()
    assert _one(spark, tx.flip_date(F.lit("2019/03/07"))) == "07/03/2019"
    assert _one(spark, tx.normalise_name(F.lit("Id Estação"))) == "id_estacao"
    assert tx.normalise_column_name("Id Estação") == "id_estacao"
    assert _one(spark, tx.zoneless_time(F.lit("2019-03-07 10:00:00+00:00"))) == dt.datetime(2019, 3, 7, 10)


def test_canonical_coordinates_take_the_most_frequent_complete_triple(spark):
    rows = [("a", 1.0, 2.0, 3.0)] * 2 + [("a", 1.0, None, 3.0)] * 5 + [("a", 0.0, 2.0, 3.0)] * 2
    df = spark.createDataFrame(rows, "station_id string, latitude double, longitude double, altitude double")
    assert [tuple(r) for r in cl.canonical_coordinates(df).collect()] == [("a", 0.0, 2.0, 3.0)]
    assert cl.with_canonical_coordinates(df).where("latitude = 0 and longitude = 2").count() == 9


def test_masks_and_nan(spark):
    df = spark.createDataFrame([(float("nan"), "NaN"), (-9999.0, "x"), (9.9, "9.9"), (10.0, "8000")], "t double, s string")
    cast = cl.cast_measurements(df, ["t", "s"])
    assert [tuple(r) for r in cast.collect()] == [(None, None), (-9999.0, None), (9.9, 9.9), (10.0, 8000.0)]
    ranged = cl.mask_ranges(cast, {"t": 10.0}, {"s": 8000.0})
    assert [tuple(r) for r in ranged.collect()] == [(None, None), (None, None), (None, 9.9), (10.0, None)]
    assert cl.mask_sentinel(cast, ["t"]).where("t is null").count() == 2


def test_duplicate_times_collapse_to_one_repeatable_row(spark):
    ts = dt.datetime(2020, 1, 1)
    df = spark.createDataFrame([("a", ts, 2.0), ("a", ts, 1.0), ("b", ts, None)], "station_id string, ts timestamp_ntz, v double")
    assert sorted((r.station_id, r.v) for r in cl.drop_duplicate_times(df).collect()) == [("a", 1.0), ("b", None)]


def test_status_needs_both_splits(spark):
    rows = [(s, dt.datetime(y, 1, d)) for s, y, n in (("a", 2018, 3), ("a", 2020, 1), ("b", 2018, 3), ("c", 2018, 1), ("c", 2021, 1), ("c", 2022, 1)) for d in range(1, n + 1)]
    split = cl.assign_split(spark.createDataFrame(rows, "station_id string, ts timestamp_ntz"))
    assert {(r.station_id, r.status) for r in cl.station_status(split, 4).collect()} == {("a", "train"), ("c", "skip")}
    assert {r.station_id for r in cl.keep_trainable(split, cl.station_status(split, 4)).collect()} == {"a"}


def test_metrics_against_hand_values(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, 2.5), ("a", 5.0, 7.0), ("a", None, 7.0), ("one", 1.0, 2.0), ("flat", 2.0, 2.0), ("flat", 2.0, 2.0), ("off", 1.0, 2.0), ("off", 2.0, 2.0)], "k string, pred double, real double")
    got = {r.k: r for r in mt.regression_metrics(df, ["k"], names=list(mt.METRICS)).collect()}
    p, y = [1.0, 3.0, 5.0], [2.0, 2.5, 7.0]
    mean = sum(y) / 3
    squared = sum((a - b) ** 2 for a, b in zip(p, y))
    assert got["a"].rmse == pytest.approx(math.sqrt(squared / 3))
    assert got["a"].mae == pytest.approx((1 + 0.5 + 2) / 3)
    assert got["a"].mbe == pytest.approx((-1 + 0.5 - 2) / 3) == -got["a"].mbe_reversed
    assert got["a"].mape == pytest.approx((1 / 2 + 0.5 / 2.5 + 2 / 7) / 3)
    assert got["a"].r2 == pytest.approx(1 - squared / sum((b - mean) ** 2 for b in y))
    assert got["a"].r2_swapped == pytest.approx(1 - squared / sum((a - 3.0) ** 2 for a in p))
    ratio = (sum((b - mean) ** 2 for b in y) - sum((a - mean) ** 2 for a in p)) / sum((b - mean) ** 2 for b in y)
    assert got["a"].r2_variance_ratio == pytest.approx(ratio)
    assert got["one"].r2 is None and got["flat"].r2 == 1.0 and got["off"].r2 == 0.0
    assert all(r.rmse >= r.mae - 1e-12 for r in got.values())


RESULTS = "station_id string, model string, timestamp string, rmse double, mae double, mape double, mbe double, r2 double, params string"


def test_ranking_order_and_criterion(spark):
    rows = [
        ("a", "rf", "1", 2.0, 1.0, 0.1, 5.0, 0.9, None),
        ("a", "rf", "2", 2.0, 1.0, 0.1, -6.0, 0.8, None),
        ("a", "xgb", "3", None, 0.5, 0.1, 0.1, 0.7, None),
    ]
    df = spark.createDataFrame(rows, RESULTS)
    assert {(r.model, r.timestamp) for r in rk.best_by_algorithm(df).collect()} == {("rf", "2"), ("xgb", "3")}
    assert rk.best_by_station(df).first().timestamp == "2"
    assert rk.best_by_station(df, criterion="mae").first().timestamp == "3"
    assert rk.best_by_station(df, criterion="mbe").first().timestamp == "2"
    assert rk.best_by_station(df, criterion="mbe", corrected=True).first().timestamp == "3"
    with pytest.raises(ValueError):
        rk.best_by_station(df, criterion="r2")


def test_blend_cases(spark):
    columns = ["model", "rmse"]
    schema = "station_id string, model string, rmse double"
    imputed = spark.createDataFrame([("only", "i", 1.0), ("tie", "i", 2.0), ("better", "i", 1.0), ("worse", "i", 3.0)], schema)
    original = spark.createDataFrame([("tie", "o", 2.0), ("better", "o", 2.0), ("worse", "o", 2.0), ("alone", "o", 2.0)], schema)
    chosen = {r.station_id: (r.model, r.is_interp) for r in rk.blend(imputed, original, columns).collect()}
    assert chosen == {"only": ("i", True), "tie": ("o", False), "better": ("i", True), "worse": ("o", False), "alone": ("o", False)}


def test_next_station(spark):
    stations = spark.createDataFrame([("a",), ("b",), ("c",)], "station_id string")
    registry = spark.createDataFrame([("a", "rf"), ("c", "rf"), ("b", "xgb")], "station_id string, algorithm string")
    assert rk.next_station(stations, registry, {"algorithm": ["rf"]}).first().station_id == "b"
    assert rk.next_station(stations, registry.withColumn("algorithm", F.lit("rf")), {"algorithm": ["rf"]}).first().station_id is None
    assert rk.planned_stations(stations, only="b").count() == 1 and rk.planned_stations(stations).count() == 3


@pytest.mark.parametrize("method", ["std", "mM", "rbst"])
def test_scaling_inverts_and_survives_constant_columns(spark, method):
    rows = [("a", float(i), 5.0) for i in range(5)] + [("b", float(i * i), 1.0) for i in range(4)]
    df = spark.createDataFrame(rows, "station_id string, x double, c double")
    params = fit_scaler(df, ["x", "c"], method)
    back = invert_scaler(apply_scaler(df, params, ["x", "c"]), params, {"x": "x", "c": "c"})
    assert [(r.station_id, pytest.approx(r.x), r.c) for r in back.orderBy("station_id", "x").collect()] == rows
    for column in ("x", "c"):
        pooled = fit_scaler(df, [column], method, by=())
        assert apply_scaler(df, pooled, [column], by=()).count() == 9
    with pytest.raises(KeyError):
        fit_scaler(df, ["x"], "other")


def test_method_table_keeps_common_stations_only(spark):
    rows = [("a", "x", 1.0), ("a", "y", 2.0), ("b", "x", 3.0)]
    scores = spark.createDataFrame(rows, "station_id string, method string, rmse double")
    assert [tuple(r) for r in compare_methods(scores, ["x", "y"], ["rmse"]).collect()] == [("a", 1.0, 2.0)]
    left = spark.createDataFrame([("a", 1.0), ("b", None)], "k string, v double")
    assert join_complete(left, left.withColumnRenamed("v", "w"), "k").count() == 1


def test_footer_and_rounding(spark):
    df = spark.createDataFrame([("a", 1.005, 2.0), ("b", 2.0, 4.0)], "station_id string, rmse double, mae double")
    report = {r.station_id: r.mae for r in mt.report_with_mean(df, "station_id", ["rmse", "mae"]).collect()}
    assert report == {"a": 2.0, "b": 4.0, None: 3.0}
    halves = spark.createDataFrame([(0.125,), (0.375,)], "x double")
    assert [r.x for r in mt.rounded(halves, {"x": 2}).collect()] == [0.12, 0.38]


def test_parameters_keep_null_entries(spark):
    parsed = _one(spark, rg.parse_params(F.lit('{"gamma": nan, "eta": 0.3}')))
    assert parsed == {"gamma": None, "eta": "0.3"}
    with pytest.raises(ValueError):
        rg.keep_to_checkpoint(spark.createDataFrame([("2020",)], "timestamp string"), "2021", "both")


def test_features_and_target_by_key_share_their_order(spark):
    df = spark.range(500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("x"), (F.col("id") * 3).alias("y"))
    features, target = cl.keyed_features_and_target(df.repartition(7), "y", ["k"], seed=3)
    first, second = features.collect(), target.collect()
    assert features.columns == ["k", "x"] and target.columns == ["k", "y"]
    assert [r.k for r in first] == [r.k for r in second] != list(range(500))
    assert all(a.x * 3 == b.y * 2 for a, b in zip(first, second))
    again, _ = cl.keyed_features_and_target(df.repartition(3), "y", ["k"], seed=3)
    assert [r.k for r in again.collect()] == [r.k for r in first]
    other, _ = cl.keyed_features_and_target(df, "y", ["k"], seed=4)
    assert [r.k for r in other.collect()] != [r.k for r in first]


def test_blend_of_runs_equals_blend_of_winners(spark):
    draw = random.Random(4)
    rows = [("imputed", 90, "m0", "t0", 1.0, 1.0, 0.0, 0.5), ("original", 91, "m0", "t0", None, None, None, None), ("other", 92, "m0", "t0", 0.1, 0.1, 0.0, 1.0)]
    for _ in range(400):
        scores = [draw.choice([None, float("nan"), 1.0, 2.0, 3.0]) if draw.random() < 0.5 else draw.uniform(-1, 4) for _ in range(4)]
        rows.append((draw.choice(["imputed", "original"]), draw.randrange(30), f"m{draw.randrange(3)}", f"t{draw.randrange(9)}", *scores))
    df = spark.createDataFrame(rows, "dataset string, station_id int, model string, timestamp string, rmse double, mae double, mbe double, r2 double")
    columns = ["model", "timestamp", "rmse", "mae", "mbe", "r2"]
    pick = lambda best, name: best.where(F.col("dataset") == name).drop("dataset")
    for criterion, corrected in (("rmse", False), ("mae", False), ("mbe", True)):
        best = rk.best_by_station(df, ("dataset", "station_id"), criterion, corrected)
        expected = rk.blend(pick(best, "imputed"), pick(best, "original"), columns)
        found = rk.blend_runs(df, columns, criterion=criterion, corrected=corrected)
        assert found.columns == expected.columns
        assert sorted(map(str, found.collect())) == sorted(map(str, expected.collect()))
        assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0
    assert {90, 91} <= {r.station_id for r in found.collect()} and 92 not in {r.station_id for r in found.collect()}
