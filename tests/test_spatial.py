import datetime as dt
import math
import random

import pytest

from sunmesh.functions.geo import EARTH_RADIUS_KM
from sunmesh.operators.components import connected_components
from sunmesh.operators.idw import impute_cascade, impute_single_pass, interpolate
from sunmesh.operators.neighbours import station_pairs
from sunmesh.operators.slots import neighbour_slots


def _km(a, b):
    (la, lo), (lb, lp) = [tuple(map(math.radians, p)) for p in (a, b)]
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lp - lo) / 2) ** 2
    return 2 * EARTH_RADIUS_KM * math.asin(min(1.0, math.sqrt(h)))


@pytest.mark.parametrize("max_km", [50.0, 300.0, 2500.0, 12000.0])
def test_pairs_equal_brute_force_all_over_the_globe(spark, max_km):
    draw = random.Random(5)
    sites = [(i, draw.uniform(-90, 90), draw.uniform(-180, 180)) for i in range(150)]
    # Clusters at the date line, the poles and the equator.
    for lat, lon in ((0.0, 179.99), (0.0, -179.99), (89.9, 10.0), (89.9, -170.0), (-90.0, 0.0), (-20.0, -45.0), (-20.0, -45.0)):
        sites += [(len(sites) + i, max(-90.0, min(90.0, lat + draw.uniform(-0.3, 0.3) * i)), lon) for i in range(3)]
    df = spark.createDataFrame(sites, "station_id int, lat double, lon double")
    found = {(r.station_id, r.neighbour_id) for r in station_pairs(df, max_km).collect()}
    expected = {(a[0], b[0]) for a in sites for b in sites if a[0] != b[0] and _km(a[1:], b[1:]) <= max_km}
    assert found == expected
    apart = {(r.station_id, r.neighbour_id) for r in station_pairs(df, max_km, exclude_zero=True).collect()}
    assert apart == {(a, b) for a, b in expected if _km(sites[a][1:], sites[b][1:]) > 0}


def _brute_cascade(cells, neighbours, min_stations, use_filled):
    """cells: {(station, ts): value or None}; plain nested loops in station order."""
    source = dict(cells)
    result = dict(cells)
    for station in sorted({s for s, _ in cells}):
        for (s, ts), value in cells.items():
            if s != station or value is not None:
                continue
            seen = result if use_filled else source
            points = [(seen[(n, ts)], d) for n, d in neighbours[station] if seen.get((n, ts)) is not None]
            if len(points) >= min_stations:
                same = [v for v, d in points if d == 0]
                if same:
                    result[(s, ts)] = sum(same) / len(same)
                else:
                    result[(s, ts)] = sum(v / d**2 for v, d in points) / sum(1 / d**2 for _, d in points)
    return result


def _network(spark, seed=11, n=20, hours=30):
    draw = random.Random(seed)
    sites = [(i, draw.uniform(-22, -20), draw.uniform(-47, -45)) for i in range(n)] + [(n, -21.0, -46.0), (n + 1, -21.0, -46.0)]
    cells = {}
    for s, _, _ in sites:
        for h in range(hours):
            if draw.random() < 0.9:
                cells[(s, dt.datetime(2020, 1, 1) + dt.timedelta(hours=2 * h))] = draw.uniform(0, 100) if draw.random() < 0.5 else None
    stations = spark.createDataFrame(sites, "station_id int, lat double, lon double")
    readings = spark.createDataFrame([(s, t, v, v) for (s, t), v in cells.items()], "station_id int, ts timestamp_ntz, v double, w double")
    near = {a[0]: [(b[0], _km(a[1:], b[1:])) for b in sites if a[0] != b[0] and _km(a[1:], b[1:]) <= 80] for a in sites}
    return stations, readings, cells, near


@pytest.mark.parametrize("mode", ["single", "cascade"])
def test_imputation_equals_brute_force(spark, mode):
    stations, readings, cells, near = _network(spark)
    pairs = station_pairs(stations, 80.0)
    if mode == "single":
        filled = impute_single_pass(readings, pairs, ["v", "w"])
    else:
        filled = impute_cascade(readings, stations, pairs, ["v", "w"])
    expected = _brute_cascade(cells, near, 3, mode != "single")
    rows = filled.collect()
    assert len(rows) == len(cells)
    for r in rows:
        want = expected[(r.station_id, r.ts)]
        assert (r.v is None) == (want is None) and (want is None or math.isclose(r.v, want, rel_tol=1e-9)), (r, want)
        assert r.v == r.w


def test_cascade_uses_earlier_fills_and_single_pass_is_a_subset(spark):
    stations, readings, cells, _ = _network(spark)
    pairs = station_pairs(stations, 80.0)
    key = lambda df: {(r.station_id, r.ts) for r in df.where("v is not null").collect()}
    single = key(impute_single_pass(readings, pairs, ["v"]))
    cascade = key(impute_cascade(readings, stations, pairs, ["v"]))
    assert single < cascade


def test_interpolation_properties(spark):
    draw = random.Random(2)
    rows = [(k, draw.uniform(0, 10), draw.uniform(1, 100), 2.0) for k in range(20) for _ in range(4)]
    rows += [(100, 1.0, 5.0, 2.0), (100, 3.0, 5.0, 2.0), (101, 9.0, 0.0, 2.0), (101, 1.0, 3.0, 2.0), (102, None, 3.0, 2.0)]
    df = spark.createDataFrame(rows, "k int, value double, dist double, error double")
    plain = {r.k: r.interpolated for r in interpolate(df, ["k"]).collect()}
    weighted = {r.k: r.interpolated for r in interpolate(df, ["k"], error="error").collect()}
    for k in range(20):
        values = [v for key, v, _, _ in rows if key == k]
        assert min(values) <= plain[k] <= max(values)
    assert plain[100] == pytest.approx(2.0)  # equal distances give the mean
    assert plain[101] == 9.0  # a co-located value decides
    assert 102 not in plain  # no value, no result
    assert all(weighted[k] == pytest.approx(plain[k]) for k in plain)  # constant errors change nothing


def test_slots_are_padded_and_skip_zeros(spark):
    ts = dt.datetime(2020, 1, 1)
    rows = [(1, n, ts, float(n), 10.0 - n, p) for n, p in ((1, 5.0), (2, 0.0), (3, None), (4, 7.0))]
    rows += [(2, n, ts, float(n), 10.0 - n, float(n)) for n in range(1, 7)]
    df = spark.createDataFrame(rows, "station_id int, neighbour_id int, ts timestamp_ntz, dist double, error double, pred double")
    slots = {r.station_id: r for r in neighbour_slots(df).collect()}
    assert [slots[1][f"stat{i}_pred"] for i in range(1, 5)] == [5.0, 7.0, 0.0, 0.0]
    assert [slots[1][f"stat{i}_dist"] for i in range(1, 5)] == [1.0, 4.0, 0.0, 0.0]
    assert slots[1].n_points == 3
    assert [slots[2][f"stat{i}_pred"] for i in range(1, 5)] == [1.0, 2.0, 3.0, 4.0]
    by_error = {r.station_id: r for r in neighbour_slots(df, slot_order="error", pad=None).collect()}
    assert [by_error[2][f"stat{i}_pred"] for i in range(1, 5)] == [6.0, 5.0, 4.0, 3.0]
    assert by_error[1].stat3_pred is None


def test_cascade_ignores_unlisted_ends_and_keeps_rows_without_time(spark):
    hour = dt.datetime(2020, 1, 1)
    readings = spark.createDataFrame(
        [(1, hour, None), (2, hour, 10.0), (9, hour, 20.0), (1, None, None), (2, None, 5.0)], "station_id int, ts timestamp_ntz, v double"
    )
    stations = spark.createDataFrame([(1,), (2,)], "station_id int")
    pairs = spark.createDataFrame([(1, 9, 1.0), (7, 2, 1.0), (1, 2, 2.0)], "station_id int, neighbour_id int, dist double")
    filled = impute_cascade(readings, stations, pairs, ["v"], min_stations=1).collect()
    assert sorted(filled, key=str) == sorted([(1, hour, 10.0), (2, hour, 10.0), (9, hour, 20.0), (1, None, None), (2, None, 5.0)], key=str)
    assert {r.v for r in impute_cascade(readings, stations, pairs.where("neighbour_id = 9"), ["v"], min_stations=1).where("station_id = 1").collect()} == {None}


def test_components_of_the_station_graph(spark):
    # Several components, repeated and reversed edges, loops, nulls; and one long line in shuffled order.
    draw = random.Random(5)
    line = draw.sample(range(1000, 2000), 300)
    edges = [(1, 2), (2, 1), (2, 3), (5, 4), (7, 7), (None, 1), (9, 8), (8, 10), (10, 9), *zip(line, line[1:])]
    found = connected_components(spark.createDataFrame(edges, "station_id int, neighbour_id int")).collect()
    assert sorted(map(tuple, found)) == sorted([(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (8, 8), (9, 8), (10, 8), *((s, min(line)) for s in line)])
    named = spark.createDataFrame([("b", "a"), ("d", "c")], "station_id string, neighbour_id string")
    assert sorted(map(tuple, connected_components(named).collect())) == [("a", "a"), ("b", "a"), ("c", "c"), ("d", "c")]
    assert connected_components(named.limit(0)).collect() == []


@pytest.mark.parametrize("layout", ["components", "line"])
def test_cascade_by_component(spark, layout):
    """Networks of several components and of one long line, in groups of one hour each, equal brute force over all stations at once."""
    draw = random.Random(11)
    if layout == "components":
        sites = [(i, 10.0 * (i % 4) + draw.uniform(0, 0.4), 20.0 + draw.uniform(0, 0.4)) for i in range(24)]
    else:
        sites = [(i, 0.3 * place, 20.0) for place, i in enumerate(draw.sample(range(60), 60))]
    hours = [dt.datetime(2020, 3, 1) + dt.timedelta(minutes=30 * h) for h in range(7)]
    cells = {(s, t): draw.uniform(0, 100) if draw.random() < 0.6 else None for s, *_ in sites for t in hours if draw.random() < 0.9}
    near = {a[0]: [(b[0], _km(a[1:], b[1:])) for b in sites if a[0] != b[0] and _km(a[1:], b[1:]) <= 80] for a in sites}
    stations = spark.createDataFrame(sites, "station_id int, lat double, lon double")
    readings = spark.createDataFrame([(s, t, v, None, "x") for (s, t), v in cells.items()], "station_id int, ts timestamp_ntz, v double, w double, note string")
    expected = _brute_cascade(cells, near, 2, True)
    for group_rows in (1, 1 << 16):
        filled = impute_cascade(readings, stations, station_pairs(stations, 80.0), ["v", "w"], 2, group_rows=group_rows).collect()
        assert len(filled) == len(cells) and {r.note for r in filled} == {"x"} and {r.w for r in filled} == {None}
        for r in filled:
            want = expected[(r.station_id, r.ts)]
            assert (r.v is None) == (want is None) and (want is None or math.isclose(r.v, want, rel_tol=1e-9)), (r, want)


def test_rows_without_a_gap_stay_out_of_python(spark):
    """Only the component and hours with a gap are grouped; all other rows come back as they are, extra columns included."""
    hours = [dt.datetime(2020, 3, 1) + dt.timedelta(hours=h) for h in range(4)]
    rows = [(s, t, None if (s, t) == (1, hours[2]) else float(s)) for s in (1, 2, 3, 11, 12) for t in hours]
    readings = spark.createDataFrame(rows, "station_id int, ts timestamp_ntz, v double")
    stations = spark.createDataFrame([(s,) for s in (1, 2, 3, 11, 12)], "station_id int")
    pairs = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0), (1, 3, 1.0), (3, 1, 1.0), (11, 12, 1.0)], "station_id int, neighbour_id int, dist double")
    filled = impute_cascade(readings, stations, pairs, ["v"], 2, group_rows=3)
    assert sorted(map(tuple, filled.collect())) == sorted((s, t, 2.5 if v is None else v) for s, t, v in rows)
