import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest

from sunmesh import schemas
from sunmesh.plans.climatology import climate_readings, climatology

COLUMNS = list(schemas.CLIMATE_LOWER_LIMITS)
SCHEMA = "station_id string, ts timestamp_ntz, " + ", ".join(f"{c} double" for c in COLUMNS)


def _readings(spark, stations=9, seed=5):
    draw = random.Random(seed)
    rows = []
    for s in range(stations):
        for year in (2019, 2020, 2021):
            for day in range(0, 360, 7):
                for hour in (9, 10, 15, 21, 22):
                    ts = dt.datetime(year, 1, 1, hour) + dt.timedelta(days=day)
                    values = [draw.uniform(0, 30) for _ in COLUMNS]
                    if draw.random() < 0.1:
                        values[draw.randrange(len(COLUMNS))] = draw.choice([None, -9999.0, -0.5])
                    rows.append((f"A70{s}", ts, *values))
    return pd.DataFrame(rows, columns=["station_id", "ts", *COLUMNS]), spark.createDataFrame(rows, SCHEMA)


def test_levels_equal_pandas(spark):
    frame, df = _readings(spark)
    found = climatology(df)
    ok = (frame[COLUMNS] >= 0).all(axis=1) & frame.ts.dt.hour.between(10, 21)
    assert climate_readings(df).count() == ok.sum()
    rows = frame[ok].assign(year=lambda f: f.ts.dt.year, month=lambda f: f.ts.dt.month, day=lambda f: f.ts.dt.day)
    rows = rows.rename(columns={"precipitacao_total": "rain", "radiacao_global": "radiation"})
    day = rows.groupby(["station_id", "year", "month", "day"])[["rain", "radiation"]].sum()
    month = day.groupby(["station_id", "year", "month"]).agg(days=("rain", "size"), rain=("rain", "sum"), radiation=("radiation", "mean"))
    station_month = month.groupby(["station_id", "month"]).agg(years=("rain", "size"), rain=("rain", "mean"), radiation=("radiation", "mean"))
    for level, keys, expected in (
        (found.day, ["station_id", "year", "month", "day"], day),
        (found.month, ["station_id", "year", "month"], month),
        (found.station_month, ["station_id", "month"], station_month),
    ):
        got = level.toPandas().set_index(keys).sort_index()[list(expected.columns)]
        pd.testing.assert_frame_equal(got, expected.sort_index(), check_dtype=False, check_index_type=False)
    report = found.report.toPandas().set_index("month")
    for m, group in station_month.reset_index().groupby("month"):
        kept = np.sort(group.radiation[group.radiation > group.radiation.min()])
        q1, median, q3 = np.quantile(kept, [0.25, 0.5, 0.75])
        inside = kept[(kept >= q1 - 1.5 * (q3 - q1)) & (kept <= q3 + 1.5 * (q3 - q1))]
        assert report.loc[m].tolist() == pytest.approx([len(group), group.rain.mean(), q1, median, q3, inside[0], inside[-1]])


def test_single_station_and_no_reading(spark):
    _, df = _readings(spark, stations=1)
    report = climatology(df).report.collect()
    assert len(report) == 12 and all(r.stations == 1 and r.rain > 0 and r.median is None for r in report)
    assert climatology(df.limit(0)).report.count() == 0
