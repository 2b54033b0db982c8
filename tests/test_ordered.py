import datetime as dt
import random

import pandas as pd
import pytest

from sunmesh.operators import ordered as od
from sunmesh.sources.tables import store_bucketed


def _series(spark, rows=400, seed=3):
    """Two keys, one with most rows, long gaps, and many nulls."""
    draw = random.Random(seed)
    data = []
    for key, n in (("hot", rows), ("cold", 23)):
        hours = sorted(draw.sample(range(24 * 400), n))
        for h in hours:
            value = draw.uniform(0, 9) if draw.random() < 0.5 else None
            data.append((key, dt.datetime(2020, 1, 1) + dt.timedelta(hours=h), value))
    frame = pd.DataFrame(data, columns=["key", "ts", "v"])
    return frame, spark.createDataFrame(data, "key string, ts timestamp_ntz, v double")


def _values(df, column):
    rows = df.orderBy("key", "ts").select(column).collect()
    return [None if r[0] is None or pd.isna(r[0]) else r[0] for r in rows]


def _expected(frame, column):
    return [None if pd.isna(v) else v for v in frame.sort_values(["key", "ts"])[column]]


@pytest.mark.parametrize("hours", [1, 24, 168, 720, 24000, "range"])
@pytest.mark.parametrize("rows", [1, 3])
def test_lead_equals_shift(spark, hours, rows):
    frame, df = _series(spark)
    frame["next"] = frame.groupby("key")["v"].shift(-rows)
    assert _values(od.with_lead(df, ["key"], ["ts"], {"next": "v"}, rows, hours), "next") == _expected(frame, "next")


@pytest.mark.parametrize("hours", [1, 24, 168, 24000, "range"])
@pytest.mark.parametrize("limit", [1, 2, 4])
def test_forward_fill_equals_pandas(spark, hours, limit):
    frame, df = _series(spark)
    frame["v"] = frame.groupby("key")["v"].ffill(limit=limit)
    assert _values(od.forward_fill(df, ["key"], ["ts"], ["v"], limit, hours), "v") == _expected(frame, "v")


def test_forward_fill_hand_case(spark):
    values = [1.0, None, None, None, None, 2.0, None]
    df = spark.createDataFrame([("a", dt.datetime(2020, 1, 1 + i), v) for i, v in enumerate(values)], "key string, ts timestamp_ntz, v double")
    assert _values(od.forward_fill(df, ["key"], ["ts"], ["v"], 2, slices=24), "v") == [1.0, 1.0, 1.0, None, None, 2.0, 2.0]


@pytest.mark.parametrize("hours", [1, 24, 720, "range"])
def test_row_numbers_and_folds(spark, hours):
    frame, df = _series(spark)
    numbered = od.with_row_numbers(df, ["key"], ["ts"], "n", "total", hours)
    frame["n"] = frame.sort_values("ts").groupby("key").cumcount() + 1
    assert _values(numbered, "n") == _expected(frame, "n")
    assert {r[0] for r in numbered.where("key = 'cold'").select("total").collect()} == {23}
    folds = od.contiguous_folds(df.where("key = 'cold'"), ["key"], ["ts"], 5, slices=hours)
    sizes = [r[1] for r in folds.groupBy("fold").count().orderBy("fold").collect()]
    assert sizes == [5, 5, 5, 4, 4]


def test_fewer_rows_than_folds(spark):
    df = spark.createDataFrame([("a", dt.datetime(2020, 1, d)) for d in (1, 2, 3)], "key string, ts timestamp_ntz")
    assert sorted(r.fold for r in od.contiguous_folds(df, ["key"], ["ts"], 5).collect()) == [0, 1, 2]


def test_one_time_holding_most_rows_is_split(spark):
    hot = dt.datetime(2020, 1, 1)
    rows = [("a", hot, i) for i in range(5000)] + [("a", hot + dt.timedelta(days=i), i) for i in range(1, 50)] + [("b", hot, 1)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "key string, ts timestamp_ntz, i int").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    numbered = od.with_row_numbers(df, ["key"], ["ts", "i"], "n", slices=od.RANGE).collect()
    parts = od._sliced(df, ["key"], ["ts", "i"], od.RANGE).groupBy("key", od.SLICE).count().collect()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert max(p["count"] for p in parts) < 2000
    expected = {r: i + 1 for i, r in enumerate(sorted(r for r in rows if r[0] == "a"))} | {("b", hot, 1): 1}
    assert {(r.key, r.ts, r.i): r.n for r in numbered} == expected


def test_numbers_without_a_key(spark):
    frame, df = _series(spark)
    numbered = od.with_row_numbers(df, [], ["ts", "key"], "n").orderBy("n").collect()
    expected = frame.sort_values(["ts", "key"])
    assert [(r.n, r.key, r.ts) for r in numbered] == [(i + 1, k, t) for i, (k, t) in enumerate(zip(expected.key, expected.ts))]


def test_rows_without_time_are_kept(spark):
    df = spark.createDataFrame([("a", None, 1.0), ("a", dt.datetime(2020, 1, 1), 2.0)], "key string, ts timestamp_ntz, v double")
    assert [(r.v, r.n) for r in od.with_row_numbers(df, ["key"], ["ts"], "n").orderBy("n").collect()] == [(1.0, 1), (2.0, 2)]


def test_target_runs_over_night_and_strict_time(spark):
    hours = [dt.datetime(2020, 1, 1, 20), dt.datetime(2020, 1, 1, 21), dt.datetime(2020, 1, 2, 10)]
    df = spark.createDataFrame([("a", h, float(i)) for i, h in enumerate(hours)], "station_id string, ts timestamp_ntz, v double")
    loose = od.next_hour_target(df, "v", "target").orderBy("ts").collect()
    assert [r.target for r in loose] == [1.0, 2.0, None]
    strict = od.next_hour_target(df, "v", "target", strict_time=True).orderBy("ts").collect()
    assert [r.target for r in strict] == [1.0, None, None]


def test_every_fifth_row(spark):
    df = spark.createDataFrame([("a", dt.datetime(2020, 1, 1) + dt.timedelta(days=i)) for i in range(12)], "key string, ts timestamp_ntz")
    split = od.every_nth_split(df, ["key"], ["ts"], 5, slices=72).orderBy("ts").collect()
    assert [i for i, r in enumerate(split) if r.split == "test"] == [0, 5, 10]


def test_no_window_over_the_whole_key(spark):
    """The rows themselves are only ordered inside (key, slice)."""
    _, df = _series(spark, 50)
    plan = od.with_row_numbers(df, ["key"], ["ts"], "n")._jdf.queryExecution().optimizedPlan().toString()
    ranks = [line for line in plan.splitlines() if "Window" in line and "row_number" in line]
    assert ranks and all(od.SLICE in line for line in ranks)


@pytest.fixture
def fixed_plans(spark):
    """No adaptive plans and no broadcasts, so that every exchange shows."""
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stored_slices_give_the_same_rows(spark):
    frame, df = _series(spark)
    stored = od.store_slices(df, ["key"], ["ts"], 168)
    frame["next"] = frame.groupby("key")["v"].shift(-2)
    frame["n"] = frame.sort_values("ts").groupby("key").cumcount() + 1
    frame["filled"] = frame.groupby("key")["v"].ffill(limit=2)
    led = od.with_lead(stored, ["key"], ["ts"], {"next": "v"}, 2, od.STORED)
    numbered = od.with_row_numbers(led, ["key"], ["ts"], "n", slices=od.STORED)
    assert od.SLICE in numbered.columns
    assert _values(numbered, "next") == _expected(frame, "next") and _values(numbered, "n") == _expected(frame, "n")
    assert _values(od.forward_fill(numbered, ["key"], ["ts"], ["v"], 2, od.STORED), "v") == _expected(frame, "filled")
    empty = od.store_slices(df.limit(0), ["key"], ["ts"])
    assert od.with_lead(empty, ["key"], ["ts"], {"next": "v"}, 1, od.STORED).count() == 0


def test_rows_of_stored_slices_are_not_moved(spark, fixed_plans):
    _, df = _series(spark)
    stored = od.store_slices(df, ["key"], ["ts"], 168)
    plan = _plan(od.with_lead(stored, ["key"], ["ts"], {"next": "v"}, 1, od.STORED))
    # Two exchanges, both of the border rows: by key for the following slice, and back by key and slice.
    assert plan.count("Exchange") == 2 and plan.count("Exchange hashpartitioning(key") == 2
    for line in (n for n in plan.splitlines() if "Exchange" in n):
        assert "SinglePartition" not in line
    above_rows = plan[: plan.index("SortMergeJoin")] + plan[plan.index("SortMergeJoin") :].split("Exchange")[0]
    assert "Window" in above_rows and "FileScan" in above_rows


def test_buckets_join_without_an_exchange(spark, fixed_plans):
    _, df = _series(spark)
    left = store_bucketed(df, "left", ["key", "ts"], ["key", "ts"])
    right = store_bucketed(df.withColumnRenamed("v", "w"), "right", ["key", "ts"], ["key", "ts"])
    joined = left.join(right, ["key", "ts"])
    assert "Exchange" not in _plan(joined) and "Exchange" not in _plan(joined.groupBy("key", "ts").count())
    assert joined.count() == df.count() and joined.where("v is distinct from w").count() == 0
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith(("left_", "right_", "slices_"))]
    assert "Exchange" in _plan(df.join(df.withColumnRenamed("v", "w"), ["key", "ts"]))
