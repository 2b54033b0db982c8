"""Composition of forecasts, the empirical formula, climatology and method comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from sunmesh import schemas
from sunmesh.functions.radiation import hourly_radiation
from sunmesh.operators import climate as cm
from sunmesh.operators.cleaning import daylight
from sunmesh.operators.metrics import regression_metrics
from sunmesh.operators.ordered import next_hour_target, with_row_numbers
from sunmesh.operators.slots import neighbour_slots, slot_columns
from sunmesh.plans import comparison as cp
from sunmesh.plans import composition as comp
from sunmesh.plans import empirical as emp
from sunmesh.plans.climatology import climatology
from sunmesh.sources.station_files import concatenate
from workload import fixtures as fx
from workload.core import query

FOUR = ["rmse", "mae", "mbe", "r2"]
SLOT_COLUMNS = slot_columns()
SLOT_INPUTS = ["doy", "hour", "lat", "lon", *SLOT_COLUMNS]

SLOTS_SQL = (
    "select station_id, ts, count(pred) as n_points, "
    + ", ".join(
        f"coalesce(max(case when rn = {i} and pred <> 0 then {p} end), 0e0) as stat{i}_{p}" for i in range(1, 5) for p in ("dist", "error", "pred")
    )
    + """ from (select *, row_number() over (partition by station_id, ts order by case when pred <> 0 then 0 else 1 end, {order}neighbour_id) as rn
                from near) n group by station_id, ts"""
)


@query("e7_neighbour_slots", SLOTS_SQL.format(order=""), SLOT_COLUMNS, 8)
def slots_by_station(spark, sf_dir):
    return neighbour_slots(comp.neighbour_predictions(fx.site_preds(spark, sf_dir), fx.error_pairs(spark, sf_dir)))


@query("e7_neighbour_slots_by_error", SLOTS_SQL.format(order="error, "), SLOT_COLUMNS, 8)
def slots_by_error(spark, sf_dir):
    near = comp.neighbour_predictions(fx.site_preds(spark, sf_dir), fx.error_pairs(spark, sf_dir))
    return neighbour_slots(near, slot_order="error")


@query("i16_composition", "select * from composition", ["comp_pred", "real"])
def composition(spark, sf_dir):
    return fx.composition(spark, sf_dir)


ROWS_SQL = f"""
    select n.station_id, n.ts, h.v as target, cast(dayofyear(n.ts) as double) as doy, cast(hour(n.ts) as double) as hour, s.lat, s.lon,
           {', '.join('n.' + c for c in SLOT_COLUMNS)}
    from ({SLOTS_SQL.format(order='')}) n join stations s on s.station_id = n.station_id
    join hourly h on h.station_id = n.station_id and h.ts = n.ts where n.n_points >= 3"""


def _second_level_rows(spark, sf_dir):
    truth = fx.hourly(spark, sf_dir).withColumnRenamed("v", "real")
    return comp.second_level_rows(
        fx.site_preds(spark, sf_dir).drop("real"), fx.error_pairs(spark, sf_dir), truth, fx.stations(spark, sf_dir)
    )


def _unit(c: str) -> str:
    return f"({c} - min({c}) over ()) / case when max({c}) over () = min({c}) over () then 1e0 else max({c}) over () - min({c}) over () end as {c}"


@query(
    "i17_second_level_set",
    f"""
    select station_id, ts, case when (row_number() over (partition by station_id order by ts) - 1) % 5 = 0 then 'test' else 'train' end as split,
           {', '.join(_unit(c) for c in ['target', *SLOT_INPUTS])} from ({ROWS_SQL}) r""",
    ["target", *SLOT_INPUTS],
)
def second_level_set(spark, sf_dir):
    scaled, _ = comp.second_level_set(_second_level_rows(spark, sf_dir))
    return scaled


@query(
    "i15_truth_table",
    """select station_id, ts, target as real from (select station_id, ts, lead(v) over (partition by station_id order by ts) as target
       from hourly where hour(ts) between 10 and 21) t where day(ts) >= 24""",
    ["real"],
)
def truth_table(spark, sf_dir):
    led = next_hour_target(daylight(fx.hourly(spark, sf_dir)), "v", "real")
    return led.where(F.day("ts") >= 24).select("station_id", "ts", "real")


@query("d9_daily_totals", "select * from daily_totals", ["daily_total"])
def daily_totals(spark, sf_dir):
    return emp.daily_totals(daylight(fx.hourly(spark, sf_dir)), "v", 4)


HOURS_SQL = """
    select h.station_id, cast(h.ts as date) as day, h.ts, h.v, d.daily_total from hourly h
    join daily_totals d on d.station_id = h.station_id and d.day = cast(h.ts as date) where hour(h.ts) between 10 and 21"""


@query("c14_hours_with_daily_total", HOURS_SQL, ["v", "daily_total"])
def hours_with_daily_total(spark, sf_dir):
    hours = daylight(fx.hourly(spark, sf_dir))
    return emp.with_daily_totals(hours, emp.daily_totals(hours, "v", 4))


@query(
    "c15_site_coordinates",
    "select h.station_id, h.ts, h.v, s.lat, s.lon from hourly h join stations s on s.station_id = h.station_id where s.status = 'train'",
    ["v", "lat", "lon"],
)
def site_coordinates(spark, sf_dir):
    return emp.with_site(fx.hourly(spark, sf_dir), fx.stations(spark, sf_dir).where(F.col("status") == "train"))


def _formula_sql(hour_offset: int, correction: str, source: str) -> str:
    """The published hourly formula, one step per sub-select."""
    return f"""
    select station_id, ts, (a + b * cos(w)) * (pi() / 24e0) * (cos(w) - cos(ws)) / g
           / (a + 0.5e0 * b * (ws - sin(ws) * cos(ws)) / g) * daily_total * (1e0 + {correction}) as emp_pred, v as real
    from (select *, sin(ws) - ws * cos(ws) as g, 0.4090e0 + 0.5016e0 * sin(radians(degrees(ws) - 60e0)) as a,
                 0.6609e0 + 0.4767e0 * sin(radians(degrees(ws) - 60e0)) as b
    from (select *, acos(-tan(radians(lat)) * tan(decl)) as ws,
                 radians(360e0 * (hour(ts) + {hour_offset} + eot / 60e0 + 4e0 / 60e0 * (-3e0 - lon) - 12e0) / 24e0) as w
    from (select *, 9.87e0 * sin(radians(2e0 * bb)) - 7.53e0 * cos(radians(bb)) - 1.5e0 * cos(radians(bb)) as eot,
                 0.006918e0 - 0.399912e0 * cos(gg) + 0.070257e0 * sin(gg) - 0.006758e0 * cos(2e0 * gg) + 0.000907e0 * sin(2e0 * gg)
                 - 0.002697e0 * cos(3e0 * gg) + 0.001480e0 * sin(3e0 * gg) as decl
    from (select *, 360e0 * (dayofyear(ts) - 81) / 365e0 as bb, 2e0 * pi() * (dayofyear(ts) - 1) / 365e0 as gg from ({source}) s0) s1) s2) s3) s4"""


SITE_HOURS_SQL = f"select h.*, s.lat, s.lon from ({HOURS_SQL}) h join stations s on s.station_id = h.station_id"
PYTHON_SQL = _formula_sql(-6, "0.15e0", SITE_HOURS_SQL)
JULIA_SQL = _formula_sql(-3, "0.2e0", SITE_HOURS_SQL)


@query("h2_empirical_radiation", PYTHON_SQL, ["emp_pred", "real"])
def empirical_radiation(spark, sf_dir):
    return emp.empirical_predictions(daylight(fx.hourly(spark, sf_dir)), fx.stations(spark, sf_dir), "v", 4)


@query("h2_empirical_radiation_second_variant", JULIA_SQL, ["emp_pred", "real"])
def empirical_radiation_second_variant(spark, sf_dir):
    return emp.empirical_predictions(daylight(fx.hourly(spark, sf_dir)), fx.stations(spark, sf_dir), "v", 4, "julia")


@query(
    "h2_formula_on_all_hours",
    _formula_sql(-6, "0.15e0", "select l_orderkey as station_id, l_shipdate as ts, l_extendedprice as daily_total, l_quantity as v, -l_discount * 300e0 as lat, -40e0 - l_tax * 100e0 as lon from lineitem")
    .replace("select station_id, ts,", "select station_id as l_orderkey, ts,", 1),
    ["emp_pred", "real"],
)
def formula_on_all_hours(spark, sf_dir):
    ts = F.col("l_shipdate")
    value = hourly_radiation(
        -F.col("l_discount") * 300.0,
        F.lit(-40.0) - F.col("l_tax") * 100.0,
        F.hour(ts) - 6,
        F.lit(-3.0),
        F.dayofyear(ts),
        F.col("l_extendedprice"),
    )
    return fx.table(spark, sf_dir, "lineitem").select("l_orderkey", ts.alias("ts"), value.alias("emp_pred"), F.col("l_quantity").alias("real"))


@query(
    "i21_empirical_scores",
    f"""select station_id, sqrt(avg(pow(emp_pred - real, 2))) as rmse, avg(abs(emp_pred - real)) as mae, avg(emp_pred - real) as mbe,
        1e0 - sum(pow(emp_pred - real, 2)) / (count(*) * var_pop(emp_pred)) as r2 from ({PYTHON_SQL}) e group by station_id""",
    FOUR,
)
def empirical_scores(spark, sf_dir):
    return emp.empirical_scores(fx.hourly(spark, sf_dir), fx.stations(spark, sf_dir), "v", 4)


@query(
    "i21_empirical_scores_second_variant",
    f"""select station_id, sqrt(avg(pow(emp_pred - real, 2))) as rmse, avg(abs(emp_pred - real)) as mae, avg(real - emp_pred) as mbe,
        (sum(pow(real - m, 2)) - sum(pow(emp_pred - m, 2))) / sum(pow(real - m, 2)) as r2
        from (select *, avg(real) over (partition by station_id) as m from ({JULIA_SQL}) j) e group by station_id""",
    FOUR,
)
def empirical_scores_second_variant(spark, sf_dir):
    return emp.empirical_scores(fx.hourly(spark, sf_dir), fx.stations(spark, sf_dir), "v", 4, "julia")


METHODS_SQL = f"""
    select station_id, 'ml' as method, sqrt(avg(pow(pred - real, 2))) as rmse, avg(abs(pred - real)) as mae, avg(pred - real) as mbe,
           1e0 - sum(pow(pred - real, 2)) / (count(*) * var_pop(real)) as r2 from site_preds group by station_id
    union all
    select station_id, 'idw', sqrt(avg(pow(comp_pred - real, 2))), avg(abs(comp_pred - real)), avg(comp_pred - real),
           1e0 - sum(pow(comp_pred - real, 2)) / (count(*) * var_pop(real)) from composition group by station_id having count(*) > 1
    union all
    select station_id, 'empi', sqrt(avg(pow(emp_pred - real, 2))), avg(abs(emp_pred - real)), avg(emp_pred - real),
           1e0 - sum(pow(emp_pred - real, 2)) / (count(*) * var_pop(emp_pred)) from ({PYTHON_SQL}) e group by station_id"""


def _method_scores(spark, sf_dir):
    composed = fx.composition(spark, sf_dir)
    scores = {
        "ml": regression_metrics(fx.site_preds(spark, sf_dir), ["station_id"], names=FOUR),
        "idw": regression_metrics(composed, ["station_id"], "comp_pred", names=FOUR, extra=[F.count(F.lit(1)).alias("n")])
        .where(F.col("n") > 1)
        .drop("n"),
        "empi": empirical_scores(spark, sf_dir),
    }
    return concatenate(s.withColumn("method", F.lit(m)) for m, s in scores.items())


@query("i20_method_scores", METHODS_SQL, FOUR)
def method_scores(spark, sf_dir):
    return _method_scores(spark, sf_dir)


@query(
    "c9_three_methods",
    f"""
    with m as ({METHODS_SQL}) select a.station_id, {', '.join(f'{t}.{n} as {n}_{name}' for n in FOUR for t, name in (('a', 'ml'), ('b', 'idw'), ('c', 'empi')))}
    from (select * from m where method = 'ml') a join (select * from m where method = 'idw') b on b.station_id = a.station_id
    join (select * from m where method = 'empi') c on c.station_id = a.station_id""",
    [f"{n}_{m}" for n in FOUR for m in ("ml", "idw", "empi")],
)
def three_methods(spark, sf_dir):
    return cp.compare_methods(_method_scores(spark, sf_dir), ["ml", "idw", "empi"], FOUR)


@query(
    "d13_monthly_totals",
    """
    with a as (select station_id, year(ts) as y, month(ts) as m, hour(ts) as h, sum(real) as v from forecasts group by 1, 2, 3, 4),
    b as (select station_id, y, m, sum(v) as v from a group by 1, 2, 3), c as (select station_id, m, avg(v) as v from b group by 1, 2)
    select cast(m as int) as month, avg(v) as real from c group by m""",
    ["real"],
    4,
)
def monthly_totals(spark, sf_dir):
    return cm.monthly_totals_mean(fx.forecasts(spark, sf_dir), "real")


DAILY_MEANS_SQL = """
    select station_id, cast(m as int) as month, avg(v) as real from (
      select station_id, y, m, avg(v) as v from (
        select station_id, year(ts) as y, month(ts) as m, day(ts) as d, sum(real) as v from forecasts group by 1, 2, 3, 4) a
      group by 1, 2, 3) b group by 1, 2"""


@query("d14_station_daily_means", DAILY_MEANS_SQL, ["real"])
def station_daily_means(spark, sf_dir):
    return cm.station_daily_means(fx.forecasts(spark, sf_dir), "real")


@query(
    "d15_monthly_box_statistics",
    f"""
    with s as ({DAILY_MEANS_SQL}), k as (select * from s where real > (select min(real) from s t where t.month = s.month)),
    q as (select month, quantile_cont(real, 0.25) as q1, quantile_cont(real, 0.5) as median, quantile_cont(real, 0.75) as q3 from k group by month)
    select q.month, q.q1, q.median, q.q3, min(k.real) as whisker_low, max(k.real) as whisker_high from q join k on k.month = q.month
    where k.real between q.q1 - 1.5e0 * (q.q3 - q.q1) and q.q3 + 1.5e0 * (q.q3 - q.q1) group by 1, 2, 3, 4""",
    ["q1", "median", "q3", "whisker_low", "whisker_high"],
)
def monthly_box_statistics(spark, sf_dir):
    means = cm.station_daily_means(fx.forecasts(spark, sf_dir), "real")
    return cm.box_statistics(cm.drop_minimum(means, "real", ["month"]), "real", ["month"])


def _climate_readings(spark, sf_dir):
    """The climatology's columns as shifted copies of the hourly value, some negative; days dealt out to three months of two years."""
    ts = F.col("ts") + F.make_ym_interval(F.day("ts") % 2, F.day("ts") % 3)
    cells = [(F.col("v") - F.lit(4.0) * ((F.day("ts") + F.lit(i)) % 5)).alias(c) for i, c in enumerate(schemas.CLIMATE_LOWER_LIMITS)]
    return fx.hourly(spark, sf_dir).select("station_id", ts.alias("ts"), *cells)


_CLIMATE_CELLS = ", ".join(f"v - 4e0 * ((day(ts) + {i}) % 5) as {c}" for i, c in enumerate(schemas.CLIMATE_LOWER_LIMITS))
_CLIMATE_RULE = " and ".join(f"{c} >= 0" for c in schemas.CLIMATE_LOWER_LIMITS)
CLIMATE_SQL = f"""
    r as (select station_id, ts + to_months(cast(12 * (day(ts) % 2) + day(ts) % 3 as int)) as ts, {_CLIMATE_CELLS} from hourly),
    d as (select station_id, year(ts) as y, month(ts) as m, day(ts) as d, sum(precipitacao_total) as rain, sum(radiacao_global) as radiation
          from r where hour(ts) between 10 and 21 and {_CLIMATE_RULE} group by 1, 2, 3, 4),
    p as (select station_id, y, m, count(*) as days, sum(rain) as rain, avg(radiation) as radiation from d group by 1, 2, 3),
    s as (select station_id, m, count(*) as years, avg(rain) as rain, avg(radiation) as radiation from p group by 1, 2)"""


@query(
    "d15_climatology_from_readings",
    f"""
    with {CLIMATE_SQL}, k as (select * from s where radiation > (select min(radiation) from s t where t.m = s.m)),
    q as (select m, quantile_cont(radiation, 0.25) as q1, quantile_cont(radiation, 0.5) as median, quantile_cont(radiation, 0.75) as q3 from k group by m),
    b as (select q.m, q.q1, q.median, q.q3, min(k.radiation) as whisker_low, max(k.radiation) as whisker_high from q join k on k.m = q.m
          where k.radiation between q.q1 - 1.5e0 * (q.q3 - q.q1) and q.q3 + 1.5e0 * (q.q3 - q.q1) group by 1, 2, 3, 4)
    select cast(a.m as int) as month, a.stations, a.rain, b.q1, b.median, b.q3, b.whisker_low, b.whisker_high
    from (select m, count(*) as stations, avg(rain) as rain from s group by m) a left join b on b.m = a.m""",
    ["rain", "q1", "median", "q3", "whisker_low", "whisker_high"],
    8,
)
def climatology_from_readings(spark, sf_dir):
    return climatology(_climate_readings(spark, sf_dir)).report


@query(
    "d14_monthly_levels",
    f"with {CLIMATE_SQL} select station_id, cast(y as int) as year, cast(m as int) as month, days, rain, radiation from p",
    ["rain", "radiation"],
    8,
)
def monthly_levels(spark, sf_dir):
    return climatology(_climate_readings(spark, sf_dir)).month


@query(
    "f5_three_quarter_split",
    """select station_id, ts, pred, case when (row_number() over (partition by station_id order by ts) - 1) % 4 = 3 then 'valid' else 'train' end as part
       from site_preds""",
    ["pred"],
    8,
)
def three_quarter_split(spark, sf_dir):
    numbered = with_row_numbers(fx.site_preds(spark, sf_dir), ["station_id"], ["ts"], "n")
    part = F.when((F.col("n") - 1) % 4 == 3, "valid").otherwise("train")
    return numbered.select("station_id", "ts", "pred", part.alias("part"))


@query(
    "f5_random_split",
    """select *, case when substr(md5(station_id || ' ' || strftime(ts, '%Y-%m-%d %H:%M:%S')), 1, 2) < 'c0' then 'train' else 'valid' end as part
       from site_preds""",
    ["real", "pred"],
    8,
)
def random_split(spark, sf_dir):
    """Three quarters of the rows, drawn by a hash of the key, so that one pass decides and reruns agree."""
    drawn = F.md5(F.concat_ws(" ", F.col("station_id").cast("string"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss")))
    part = F.when(F.substring(drawn, 1, 2) < "c0", "train").otherwise("valid")
    return fx.site_preds(spark, sf_dir).withColumn("part", part)


@query(
    "g1_union_of_station_sets",
    "select station_id, ts, v, cast(null as double) as pred from hourly where day(ts) >= 24 union all select station_id, ts, real as v, pred from site_preds",
    ["v", "pred"],
    8,
)
def union_of_station_sets(spark, sf_dir):
    late = fx.hourly(spark, sf_dir).where(F.day("ts") >= 24)
    return concatenate([late, fx.site_preds(spark, sf_dir).withColumnRenamed("real", "v")])
