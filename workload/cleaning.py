"""Projections, filters, cleaning rules and row-order operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from sunmesh.functions.text import normalise_name
from sunmesh.operators import cleaning as cl
from sunmesh.operators.metrics import rounded
from sunmesh.operators.ordered import (
    RANGE,
    SLICE,
    STORED,
    contiguous_folds,
    every_nth_split,
    forward_fill,
    next_hour_target,
    store_slices,
    with_row_numbers,
)
from sunmesh.operators.quantiles import exact_quantiles, mask_outliers, quartiles_by_hour
from sunmesh.sources.registry import STATION_PATTERN
from sunmesh.sources.tables import materialise
from workload import fixtures as fx
from workload.core import query

QUARTERS = ["q1", "q3"]


@query(
    "b1_rows_by_station",
    "select station_id, count(*) as n_rows, min(ts) as first_ts, max(ts) as last_ts from readings group by station_id",
)
def rows_by_station(spark, sf_dir):
    return (
        fx.readings(spark, sf_dir)
        .groupBy("station_id")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    )


@query(
    "b3_canonical_coordinates",
    """
    select r.station_id, r.data, r.hour, r.radiation, c.lat, c.lon, c.alt from raw_readings r join (
      select station_id, lat, lon, alt from (
        select station_id, lat, lon, alt,
               row_number() over (partition by station_id order by count(*) desc, lat, lon, alt) as rn
        from raw_readings where lat is not null and lon is not null and alt is not null
        group by station_id, lat, lon, alt) v where rn = 1) c on c.station_id = r.station_id""",
    ["radiation", "lat", "lon", "alt"],
)
def canonical_coordinates(spark, sf_dir):
    raw = fx.raw_readings(spark, sf_dir)
    return cl.with_canonical_coordinates(raw, columns=("lat", "lon", "alt"))


@query(
    "b4_parse_time",
    """
    select station_id, radiation, ts, cast(dayofyear(ts) as int) as doy, cast(year(ts) as int) as year,
           cast(hour(ts) as int) as hour from raw_readings""",
    ["radiation"],
)
def parse_time(spark, sf_dir):
    return cl.parse_time(fx.raw_readings(spark, sf_dir)).select("station_id", "radiation", "ts", "doy", "year", "hour")


@query(
    "b5_cast_measurements",
    """
    select station_id, ts, try_cast(case when hour(ts) = 3 then 'n/a' else cast(round(radiation, 4) as varchar) end as double) as radiation
    from readings""",
    ["radiation"],
    4,
)
def cast_measurements(spark, sf_dir):
    texts = fx.readings(spark, sf_dir).select(
        "station_id",
        "ts",
        F.when(F.hour("ts") == 3, "n/a").otherwise(F.round("radiation", 4).cast("string")).alias("radiation"),
    )
    return cl.cast_measurements(texts, ["radiation"])


@query(
    "b6_daylight_valid_radiation",
    """
    select station_id, ts, case when radiation < 150e0 then radiation end as radiation, temperature, pressure, humidity, wind
    from readings where hour(ts) between 10 and 21""",
    fx.FEATURES,
)
def daylight_valid_radiation(spark, sf_dir):
    return cl.daylight(cl.mask_ranges(fx.readings(spark, sf_dir), upper_exclusive={"radiation": 150.0}))


@query(
    "b7_mask_ranges",
    """
    select station_id, ts, radiation, case when temperature >= 5e0 then temperature end as temperature,
           case when pressure >= 0e0 then pressure end as pressure, case when humidity >= 0e0 then humidity end as humidity,
           case when wind >= 0e0 then wind end as wind from readings""",
    fx.FEATURES,
)
def mask_ranges(spark, sf_dir):
    rules = {"temperature": 5.0, "pressure": 0.0, "humidity": 0.0, "wind": 0.0}
    return cl.mask_ranges(fx.readings(spark, sf_dir), rules)


@query(
    "b8_mask_sentinel",
    "select station_id, data, hour, nullif(radiation, -9999e0) as radiation, lat, lon, alt from raw_readings",
    ["radiation", "lat", "lon", "alt"],
)
def mask_sentinel(spark, sf_dir):
    return cl.mask_sentinel(fx.raw_readings(spark, sf_dir), ["radiation", "lat", "lon", "alt"])


@query(
    "b9_drop_incomplete",
    "select * from readings where radiation is not null and temperature is not null",
    fx.FEATURES,
)
def drop_incomplete(spark, sf_dir):
    return cl.drop_incomplete(fx.readings(spark, sf_dir), ["radiation", "temperature"])


@query(
    "b10_drop_below_threshold",
    "select * from readings where " + " + ".join(f"cast({c} is not null as int)" for c in fx.FEATURES) + " >= 3",
    fx.FEATURES,
)
def drop_below_threshold(spark, sf_dir):
    return cl.drop_incomplete(fx.readings(spark, sf_dir), fx.FEATURES, 3)


@query("b11_drop_columns", "select station_id, ts, radiation, temperature from readings", ["radiation", "temperature"])
def drop_columns(spark, sf_dir):
    return fx.readings(spark, sf_dir).drop("pressure", "humidity", "wind")


@query("b12_features_and_target", "select temperature, pressure, humidity, wind, station_id, ts from readings", fx.FEATURES[1:])
def features_and_target(spark, sf_dir):
    features, _ = cl.features_and_target(fx.readings(spark, sf_dir), "radiation", seed=7)
    return features


@query("b12_features_and_target_by_key", "select station_id, ts, temperature, pressure, humidity, wind, radiation from readings", fx.FEATURES)
def features_and_target_by_key(spark, sf_dir):
    """Features and target of all rows, put together again by their key."""
    keys = ["station_id", "ts"]
    features, target = cl.keyed_features_and_target(fx.readings(spark, sf_dir), "radiation", keys, seed=7)
    return features.join(target, keys)


@query(
    "b13_temporal_split",
    "select station_id, ts, radiation, case when day(ts) < 24 then 'train' else 'test' end as split from readings",
    ["radiation"],
)
def temporal_split(spark, sf_dir):
    split = F.when(F.day("ts") < 24, "train").otherwise("test")
    return fx.readings(spark, sf_dir).select("station_id", "ts", "radiation", split.alias("split"))


def _by_year(spark, sf_dir):
    return cl.assign_split(fx.forecasts(spark, sf_dir), (1997, 1998))


@query(
    "b13_year_split",
    """
    select l_orderkey, l_linenumber, station_id, ts,
           case when year(ts) < 1997 then 'train' when year(ts) between 1997 and 1998 then 'test' end as split from forecasts""",
)
def year_split(spark, sf_dir):
    return _by_year(spark, sf_dir).select("l_orderkey", "l_linenumber", "station_id", "ts", "split")


@query(
    "b14_station_status",
    """
    select station_id, n_rows, n_train, n_test, case when n_rows >= 300 then 'train' else 'skip' end as status from (
      select station_id, count(*) as n_rows, count(*) filter (where day(ts) < 24) as n_train,
             count(*) filter (where day(ts) >= 24) as n_test from readings group by station_id) t
    where n_train > 0 and n_test > 0""",
)
def station_status(spark, sf_dir):
    return cl.station_status(temporal_split(spark, sf_dir), 300)


@query(
    "b14_keep_trainable",
    "select station_id, ts, radiation from readings where station_id in (select station_id from readings group by station_id having count(*) >= 300)",
    ["radiation"],
)
def keep_trainable(spark, sf_dir):
    split = temporal_split(spark, sf_dir)
    return cl.keep_trainable(split, cl.station_status(split, 300)).drop("split")


@query("b15_distinct_metadata", "select distinct station_id, lat, lon, alt from raw_readings", ["lat", "lon", "alt"])
def distinct_metadata(spark, sf_dir):
    return fx.raw_readings(spark, sf_dir).select("station_id", "lat", "lon", "alt").distinct()


@query(
    "b16_normalised_names",
    """
    select n_nationkey as id_estacao, lower(n_name) as nome_regiao,
           translate(replace(lower(concat(n_name, ' São Ação')), ' ', '_'), 'ãẽõçí', 'aeoci') as texto from nation""",
)
def normalised_names(spark, sf_dir):
    nation = fx.table(spark, sf_dir, "nation")
    named = nation.select(
        F.col("n_nationkey").alias("Id Estação"),
        F.lower("n_name").alias("Nome Região"),
        normalise_name(F.concat("n_name", F.lit(" São Ação"))).alias("texto"),
    )
    return cl.normalise_columns(named.withColumnRenamed("Id Estação", "Id EstaÇão"))


@query(
    "b17_fill_nulls",
    """
    select station_id, ts, coalesce(radiation, 0e0) as radiation, coalesce(temperature, 0e0) as temperature,
           coalesce(cast(cast(round(pressure) as bigint) as varchar), '--') as pressure from readings""",
    ["radiation", "temperature"],
)
def fill_nulls(spark, sf_dir):
    shown = fx.readings(spark, sf_dir).select(
        "station_id", "ts", "radiation", "temperature", F.round("pressure").cast("long").cast("string").alias("pressure")
    )
    return shown.fillna(0.0, ["radiation", "temperature"]).fillna("--", ["pressure"])


@query("b18_rename", "select station_id as station, ts as datetime, pred as estimado, real as valor_real from site_preds", ["estimado", "valor_real"], 8)
def rename(spark, sf_dir):
    names = {"station_id": "station", "ts": "datetime", "pred": "estimado", "real": "valor_real"}
    return fx.site_preds(spark, sf_dir).withColumnsRenamed(names)


@query(
    "b19_computed_columns",
    """select l_orderkey, l_linenumber, station_id, ts, real - pred as residual, (real + pred) / 2e0 as middle, real / 1000e0 as scaled
       from forecasts""",
    ["residual", "middle", "scaled"],
    9,
)
def computed_columns(spark, sf_dir):
    return fx.forecasts(spark, sf_dir).select(
        "l_orderkey",
        "l_linenumber",
        "station_id",
        "ts",
        (F.col("real") - F.col("pred")).alias("residual"),
        ((F.col("real") + F.col("pred")) / 2.0).alias("middle"),
        (F.col("real") / 1000.0).alias("scaled"),
    )


@query(
    "b20_half_even_rounding",
    """
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, round_even(l_quantity / 8e0, 2) as rmse, round_even(l_quantity / 16e0, 3) as r2
    from lineitem""",
)
def half_even_rounding(spark, sf_dir):
    source = fx.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_quantity") / 8.0).alias("rmse"), (F.col("l_quantity") / 16.0).alias("r2")
    )
    return rounded(source, {"rmse": 2, "r2": 3})


@query(
    "b21_climate_cleaning",
    "select station_id, ts, radiation, temperature, humidity from readings where radiation >= 0 and temperature >= 0 and humidity >= 0 and hour(ts) between 10 and 21",
    ["radiation", "temperature", "humidity"],
)
def climate_cleaning(spark, sf_dir):
    columns = ["radiation", "temperature", "humidity"]
    masked = cl.mask_ranges(fx.readings(spark, sf_dir).select("station_id", "ts", *columns), {c: 0.0 for c in columns})
    return cl.daylight(cl.drop_incomplete(masked, columns))


@query("b22_period_filter", "select station_id, ts, real from forecasts where year(ts) between 1995 and 1997", ["real"])
def period_filter(spark, sf_dir):
    return fx.forecasts(spark, sf_dir).where(F.year("ts").between(1995, 1997)).select("station_id", "ts", "real")


@query("b23_mask_split", "select is_interp, count(*) as n, avg(rmse) as rmse from best_overall group by is_interp", ["rmse"])
def mask_split(spark, sf_dir):
    return fx.best_overall(spark, sf_dir).groupBy("is_interp").agg(F.count(F.lit(1)).alias("n"), F.avg("rmse").alias("rmse"))


@query(
    "b24_station_pattern",
    """select c_custkey, c_name from (select c_custkey, c_name, concat(case when c_custkey % 4 = 0 then 'x' else chr(cast(65 + c_custkey % 26 as int)) end,
         lpad(cast(c_custkey % 1200 as varchar), 3, '0')) as code from customer) t
       where regexp_matches(code, '^[A-Z][0-9]{3}') and length(code) = 4""",
)
def station_pattern(spark, sf_dir):
    key = F.col("c_custkey")
    number = (key % 1200).cast("string")
    padded = F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(F.substring(number, 1, 3))
    code = F.concat(F.when(key % 4 == 0, "x").otherwise(F.char(F.lit(65) + key % 26)), padded)
    return (
        fx.table(spark, sf_dir, "customer")
        .where(code.rlike(STATION_PATTERN) & (F.length(code) == 4))
        .select("c_custkey", "c_name")
    )


def _daylight_hourly(spark, sf_dir):
    return cl.daylight(fx.hourly(spark, sf_dir))


@query(
    "e1_next_row_target",
    "select station_id, ts, v, lead(v) over (partition by station_id order by ts) as target from hourly where hour(ts) between 10 and 21",
    ["v", "target"],
)
def next_row_target(spark, sf_dir):
    return next_hour_target(_daylight_hourly(spark, sf_dir), "v", "target")


@query(
    "e1_target_from_stored_slices",
    """
    select station_id, ts, v, lead(v) over w as target, lead(v, 3) over w as later
    from hourly where hour(ts) between 10 and 21 window w as (partition by station_id order by ts)""",
    ["v", "target", "later"],
)
def target_from_stored_slices(spark, sf_dir):
    """Two targets from rows that are stored in buckets once and not moved again."""
    stored = store_slices(_daylight_hourly(spark, sf_dir), ["station_id"], ["ts"])
    led = next_hour_target(stored, "v", "target", slices=STORED)
    return next_hour_target(led, "v", "later", rows=3, slices=STORED).drop(SLICE)


@query(
    "e1_strict_two_hours",
    """
    select station_id, ts, v, case when lead(ts, 2) over w = ts + interval 2 hour then lead(v, 2) over w end as target
    from hourly where hour(ts) between 10 and 21 window w as (partition by station_id order by ts)""",
    ["v", "target"],
)
def strict_two_hours(spark, sf_dir):
    return next_hour_target(_daylight_hourly(spark, sf_dir), "v", "target", rows=2, strict_time=True)


@query(
    "e2_forward_fill",
    """
    select station_id, ts, coalesce(v, lag(v, 1) over w, lag(v, 2) over w) as v
    from grid window w as (partition by station_id order by ts)""",
    ["v"],
)
def fill_forward(spark, sf_dir):
    return forward_fill(fx.grid(spark, sf_dir), ["station_id"], ["ts"], ["v"], 2)


@query(
    "d19_quartiles_by_hour",
    """
    select station_id, cast(hour(ts) as int) as hour, 'v' as feature, quantile_cont(v, 0.25) as q1, quantile_cont(v, 0.75) as q3
    from hourly group by station_id, hour(ts)""",
    QUARTERS,
    9,
)
def station_hour_quartiles(spark, sf_dir):
    return quartiles_by_hour(fx.hourly(spark, sf_dir), ["v"])


@query(
    "d19_quantiles_by_station",
    """
    select dataset, station_id, quantile_cont(real, 0.05) as p5, quantile_cont(real, 0.5) as p50, quantile_cont(real, 0.999) as p999
    from forecasts group by dataset, station_id""",
    ["p5", "p50", "p999"],
    9,
)
def station_quantiles(spark, sf_dir):
    keys = ["dataset", "station_id"]
    found = exact_quantiles(fx.forecasts(spark, sf_dir), keys, "real", [0.05, 0.5, 0.999])
    return found.select(*keys, *[F.get("quantiles", F.lit(i)).alias(n) for i, n in enumerate(["p5", "p50", "p999"])])


@query(
    "e5_mask_outliers",
    """
    with day as (select station_id, ts, hour(ts) as h, v, lead(v) over (partition by station_id order by ts) as target
                 from hourly where hour(ts) between 10 and 21),
    q as (select station_id, h, quantile_cont(v, 0.25) as v1, quantile_cont(v, 0.75) as v3,
                 quantile_cont(target, 0.25) as t1, quantile_cont(target, 0.75) as t3 from day group by station_id, h)
    select d.station_id, d.ts,
           case when v > v1 - 1.5e0 * (v3 - v1) and v < v3 + 1.5e0 * (v3 - v1) then v end as v,
           case when target > t1 - 1.5e0 * (t3 - t1) and target < t3 + 1.5e0 * (t3 - t1) then target end as target
    from day d join q on q.station_id = d.station_id and q.h = d.h""",
    ["v", "target"],
)
def outliers(spark, sf_dir):
    day = materialise(next_hour_target(_daylight_hourly(spark, sf_dir), "v", "target"), "daylight")
    return mask_outliers(day, ["v", "target"], 0.0)


@query(
    "e6_every_fifth_row",
    """
    select station_id, ts, pred, case when (row_number() over (partition by station_id order by ts) - 1) % 5 = 0
           then 'test' else 'train' end as split from site_preds""",
    ["pred"],
    8,
)
def every_fifth_row(spark, sf_dir):
    return every_nth_split(fx.site_preds(spark, sf_dir).drop("real"), ["station_id"], ["ts"], 5)


@query(
    "e9_contiguous_folds",
    "select station_id, ts, cast(ntile(5) over (partition by station_id order by ts) - 1 as int) as fold from hourly",
)
def folds(spark, sf_dir):
    return contiguous_folds(fx.hourly(spark, sf_dir).drop("v"), ["station_id"], ["ts"], 5)


@query(
    "h11_modulo_of_row_number",
    """
    select station_id, l_orderkey, l_linenumber, ts, pred, cast(row_number() over (
      partition by station_id order by ts, l_orderkey, l_linenumber, pred) % 7 as bigint) as position from forecasts""",
    ["pred"],
    9,
)
def modulo_of_row_number(spark, sf_dir):
    order = ["ts", "l_orderkey", "l_linenumber", "pred"]
    numbered = with_row_numbers(fx.forecasts(spark, sf_dir), ["station_id"], order, "n", slices=RANGE)
    return numbered.select("station_id", "l_orderkey", "l_linenumber", "ts", "pred", (F.col("n") % 7).alias("position"))
