import datetime as dt
import random

import numpy as np
import pytest

from sunmesh.operators.quantiles import exact_quantiles, mask_outliers

SHAPES = {
    "uniform": lambda r: r.uniform(-5, 5),
    "few values": lambda r: float(r.randrange(4)),
    "one huge outlier": lambda r: 1e300 if r.random() < 0.001 else r.gauss(0, 1),
    "heavy tail": lambda r: r.paretovariate(0.5),
    "constant": lambda r: 7.0,
}


@pytest.mark.parametrize("shape", list(SHAPES))
@pytest.mark.parametrize("accuracy", [10, 5000])
def test_equal_numpy(spark, shape, accuracy):
    draw = random.Random(1)
    data = [("hot" if i % 50 else "cold", SHAPES[shape](draw)) for i in range(3000)] + [("single", 3.0), ("hot", None)]
    df = spark.createDataFrame(data, "key string, v double")
    asked = [0.0, 0.05, 0.25, 0.5, 0.75, 0.999, 1.0]
    found = {r.key: r.quantiles for r in exact_quantiles(df, ["key"], "v", asked, accuracy=accuracy).collect()}
    for key in ("hot", "cold", "single"):
        values = [v for k, v in data if k == key and v is not None]
        assert np.allclose(found[key], np.quantile(values, asked), rtol=1e-12, atol=0)


@pytest.mark.parametrize("shape", list(SHAPES))
@pytest.mark.parametrize("by", [(), ("key",)])
def test_large_brackets_are_cut_again(spark, shape, by):
    draw = random.Random(2)
    data = [("hot" if i % 50 else "cold", SHAPES[shape](draw)) for i in range(3000)] + [("hot", None)]
    df = spark.createDataFrame(data, "key string, v double").repartition(4)
    asked = [0.0, 0.25, 0.5, 0.999, 1.0]
    found = exact_quantiles(df, by, "v", asked, accuracy=3, ordered_rows=2).collect()
    assert len(found) == (2 if by else 1)
    for row in found:
        values = [v for k, v in data if v is not None and (not by or k == row.key)]
        assert np.allclose(row.quantiles, np.quantile(values, asked), rtol=1e-12, atol=0)


def test_one_frequent_value_is_not_ordered_nor_cut_for_ever(spark):
    data = [(9.0,)] * 2000 + [(float(i % 7),) for i in range(50)] + [(float("inf"),)] * 3
    df = spark.createDataFrame(data, "v double")
    found = exact_quantiles(df, (), "v", [0.0, 0.01, 0.5, 0.99], accuracy=2, ordered_rows=1).first().quantiles
    assert np.allclose(found, np.quantile([v for v, in data], [0.0, 0.01, 0.5, 0.99]))


def test_no_value_at_all(spark):
    df = spark.createDataFrame([("a", None)], "key string, v double")
    assert exact_quantiles(df, (), "v", [0.5]).collect() == exact_quantiles(df, ("key",), "v", [0.5]).collect() == []


def test_hand_case_and_missing_group(spark):
    df = spark.createDataFrame([("a", float(i)) for i in (1, 2, 3, 4)] + [("b", None)], "key string, v double")
    found = exact_quantiles(df, ["key"], "v", [0.25, 0.5, 0.75]).collect()
    assert [(r.key, r.quantiles) for r in found] == [("a", [1.75, 2.5, 3.25])]


def test_outlier_bounds_are_inclusive(spark):
    # The quartiles are 2 and 6: whiskers end at -4 and 12, half ones at 0 and 8.
    values = [0, 1, 2, 3, 4, 5, 6, 7, 8]
    rows = [("a", dt.datetime(2020, 1, d + 1, 10), float(v)) for d, v in enumerate(values)]
    df = spark.createDataFrame(rows, "station_id string, ts timestamp_ntz, v double")
    assert mask_outliers(df, ["v"], 0.0).where("v is null").count() == 0
    wide = mask_outliers(df, ["v"], 0.0, whisker=0.5)
    assert sorted(r.v for r in wide.where("v is not null").collect()) == [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0]
    margin = mask_outliers(df, ["v"], 1.0, whisker=0.5)
    assert sorted(r.v for r in margin.where("v is not null").collect()) == [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0]
