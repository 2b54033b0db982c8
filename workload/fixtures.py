"""Station-network tables derived from the given tables, as Spark plans and as SQL views.

``nation`` gives a 5 x 5 grid of stations, ``events`` their readings, and
``lineitem`` forecasts with known errors. ``hourly`` loses about one cell in
seven, so that there are gaps to fill; ``grid`` shows them as nulls.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sunmesh.functions.geo import EARTH_RADIUS_KM
from sunmesh.operators.metrics import regression_metrics
from sunmesh.operators.neighbours import pair_errors, station_pairs
from sunmesh.operators.ranking import best_by_station, blend_runs
from sunmesh.plans.composition import compose, estimator_errors

N_STATIONS = 25
FEATURES = ["radiation", "temperature", "pressure", "humidity", "wind"]
RUN_COLUMNS = ["model", "timestamp", "rmse", "mae", "mape", "mbe", "r2", "params"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def haversine_sql(a: str, b: str) -> str:
    return (
        f"2e0 * {EARTH_RADIUS_KM}e0 * asin(sqrt(pow(sin(radians({b}.lat - {a}.lat) / 2e0), 2)"
        f" + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2e0), 2)))"
    )


METRICS_SQL = """
    sqrt(avg(pow(pred - real, 2))) as rmse, avg(abs(pred - real)) as mae,
    avg(abs(pred - real) / greatest(abs(real), 2.220446049250313e-16)) as mape, avg(pred - real) as mbe,
    1e0 - sum(pow(pred - real, 2)) / (count(*) * var_pop(real)) as r2"""

VIEWS = {
    "stations": """
        select cast(n_nationkey as int) as station_id, -20e0 - n_regionkey * 0.7e0 as lat,
               -45e0 - floor(n_nationkey / 5e0) * 0.8e0 as lon, 500e0 + 10e0 * n_nationkey as alt,
               case when n_nationkey % 8 = 7 then 'skip' else 'train' end as status
        from nation""",
    "hourly": """
        select station_id, ts, v from (
          select cast(user_id % 25 as int) as station_id, date_trunc('hour', ts) as ts, avg(value) as v
          from events group by cast(user_id % 25 as int), date_trunc('hour', ts)) t
        where (station_id * 3 + day(ts) * 5 + hour(ts) * 4) % 7 <> 0""",
    "grid": """
        select s.station_id, h.ts, y.v
        from stations s cross join (select distinct ts from hourly) h
        left join hourly y on y.station_id = s.station_id and y.ts = h.ts""",
    "readings": """
        select station_id, ts,
               avg(case when event_type = 'view' then value end) as radiation,
               avg(case when event_type = 'click' then value end) as temperature,
               avg(case when event_type = 'signup' then value end) as pressure,
               avg(case when event_type = 'purchase' then value end) as humidity,
               avg(case when event_type = 'error' then value end) as wind
        from (select cast(user_id % 25 as int) as station_id, date_trunc('hour', ts) as ts, event_type, value from events) e
        group by station_id, ts""",
    "raw_readings": """
        select g.station_id,
               concat('2024', case when g.station_id % 2 = 0 then '/' else '-' end, '01',
                      case when g.station_id % 2 = 0 then '/' else '-' end, lpad(cast(day(g.ts) as varchar), 2, '0')) as data,
               concat(lpad(cast(hour(g.ts) as varchar), 2, '0'), ':00', case when g.station_id % 3 = 0 then ' UTC' else '' end) as hour,
               coalesce(g.v, -9999e0) as radiation,
               case when day(g.ts) % 10 = 0 then s.lat + 1e0 else s.lat end as lat, s.lon, s.alt, g.ts
        from grid g join stations s on s.station_id = g.station_id""",
    "forecasts": """
        select case when l_linestatus = 'F' then 'imputed' else 'original' end as dataset,
               cast(l_suppkey % 25 as int) as station_id, l_returnflag as algorithm, l_shipdate as ts,
               l_orderkey, l_linenumber, l_extendedprice / 1e3 as real,
               l_extendedprice / 1e3 * (0.8e0 + ((l_partkey * 7 + l_suppkey * 13) % 41) / 1e2) as pred
        from lineitem""",
    "site_preds": """
        select y.station_id, y.ts, y.v * (0.9e0 + (y.station_id % 5) * 0.05e0) as pred, y.v as real
        from hourly y join stations s on s.station_id = y.station_id
        where s.status = 'train'""",
    "pairs": f"""
        select a.station_id, b.station_id as neighbour_id, {haversine_sql('a', 'b')} as dist
        from stations a join stations b on a.station_id <> b.station_id
        where {haversine_sql('a', 'b')} <= 120e0""",
    "train_pairs": """
        select p.station_id, p.neighbour_id, p.dist
        from pairs p join stations s on s.station_id = p.neighbour_id where s.status = 'train' and p.dist > 0""",
    "model_runs": f"""
        select dataset, station_id, algorithm as model, concat(cast(year(ts) as varchar), '-01-01-00-00-00') as "timestamp",
               {METRICS_SQL},
               concat('{{"max_depth": ', cast(4 + year(ts) % 3 as varchar), ', "n_estimators": ',
                      cast(100 + 50 * (year(ts) % 4) as varchar), ', "gamma": ',
                      case when year(ts) % 2 = 0 then 'nan' else '0.05' end, '}}') as params
        from forecasts group by dataset, station_id, algorithm, year(ts)""",
    "best_models": """
        select dataset, station_id, model, "timestamp", rmse, mae, mape, mbe, r2, params from (
          select *, row_number() over (partition by dataset, station_id
                                       order by rmse, mae, mbe, r2, "timestamp", model) as rn from model_runs) t
        where rn = 1""",
    "best_overall": """
        select coalesce(o.station_id, i.station_id) as station_id,
               case when o.station_id is null or i.rmse < o.rmse then i.model else o.model end as model,
               case when o.station_id is null or i.rmse < o.rmse then i."timestamp" else o."timestamp" end as "timestamp",
               case when o.station_id is null or i.rmse < o.rmse then i.rmse else o.rmse end as rmse,
               case when o.station_id is null or i.rmse < o.rmse then i.mae else o.mae end as mae,
               case when o.station_id is null or i.rmse < o.rmse then i.mape else o.mape end as mape,
               case when o.station_id is null or i.rmse < o.rmse then i.mbe else o.mbe end as mbe,
               case when o.station_id is null or i.rmse < o.rmse then i.r2 else o.r2 end as r2,
               case when o.station_id is null or i.rmse < o.rmse then i.params else o.params end as params,
               coalesce(o.station_id is null or i.rmse < o.rmse, false) as is_interp
        from (select * from best_models where dataset = 'imputed') i
        full join (select * from best_models where dataset = 'original') o on o.station_id = i.station_id""",
    "errors": "select station_id, (rmse + mae) / 2e0 as error from best_overall",
    "near": """
        select p.station_id, p.neighbour_id, f.ts, p.dist, e.error, f.pred
        from train_pairs p join errors e on e.station_id = p.neighbour_id
        join site_preds f on f.station_id = p.neighbour_id""",
    "composition": """
        select n.station_id, n.ts, sum(n.pred / (n.dist * n.dist * n.error)) / sum(1e0 / (n.dist * n.dist * n.error)) as comp_pred,
               count(*) as n_points, max(h.v) as real
        from near n join hourly h on h.station_id = n.station_id and h.ts = n.ts
        group by n.station_id, n.ts having count(*) >= 3""",
    "daily_totals": """
        select station_id, cast(ts as date) as day, sum(v) as daily_total
        from hourly where hour(ts) between 10 and 21 group by station_id, cast(ts as date) having count(*) = 4""",
    "file_names": """
        select concat('INMET_', case when c_custkey % 3 = 0 then 'SE' else 'S' end, '_', case when c_custkey % 3 = 0 then 'SP' else 'PR' end,
                      '_', case when c_custkey % 97 = 0 then 'C891' else concat('A', cast(500 + c_custkey % 260 as varchar)) end,
                      '_', upper(replace(c_mktsegment, ' ', '-')), case when c_custkey % 2 = 0 then ' DO SUL' else '' end,
                      '_01-01-', cast(2001 + c_custkey % 20 as varchar), '_A_31-12-', cast(2001 + c_custkey % 20 as varchar), '.CSV') as file_name
        from customer""",
}


def with_views(sql: str) -> str:
    """Put the views that ``sql`` names in front of it, those they need first."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(VIEWS[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql.strip()
    views = ",\n".join(f"{n} as ({VIEWS[n].strip()}\n)" for n in needed)
    return f"with {views}\n{sql.strip()}"


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    return nation.select(
        F.col("n_nationkey").cast("int").alias("station_id"),
        (F.lit(-20.0) - F.col("n_regionkey") * 0.7).alias("lat"),
        (F.lit(-45.0) - F.floor(F.col("n_nationkey") / 5) * 0.8).alias("lon"),
        (F.lit(500.0) + F.col("n_nationkey") * 10.0).alias("alt"),
        F.when(F.col("n_nationkey") % 8 == 7, "skip").otherwise("train").alias("status"),
    )


def _station_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % N_STATIONS).cast("int").alias("station_id"),
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"),
        "event_type",
        "value",
    )


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = _station_hours(spark, sf_dir).groupBy("station_id", "ts").agg(F.avg("value").alias("v"))
    return means.where((F.col("station_id") * 3 + F.day("ts") * 5 + F.hour("ts") * 4) % 7 != 0)


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    observed = hourly(spark, sf_dir)
    cells = observed.select("ts").distinct().select(
        F.explode(F.sequence(F.lit(0), F.lit(N_STATIONS - 1))).alias("station_id"), "ts"
    )
    return cells.join(observed, ["station_id", "ts"], "left")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = dict(zip(FEATURES, ["view", "click", "signup", "purchase", "error"]))
    return (
        _station_hours(spark, sf_dir)
        .groupBy("station_id", "ts")
        .agg(*[F.avg(F.when(F.col("event_type") == kind, F.col("value"))).alias(name) for name, kind in kinds.items()])
    )


def raw_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = F.when(F.col("station_id") % 2 == 0, "/").otherwise("-")
    two = lambda part: F.lpad(part.cast("string"), 2, "0")
    return grid(spark, sf_dir).join(stations(spark, sf_dir).drop("status"), "station_id").select(
        "station_id",
        F.concat(F.lit("2024"), mark, F.lit("01"), mark, two(F.day("ts"))).alias("data"),
        F.concat(two(F.hour("ts")), F.lit(":00"), F.when(F.col("station_id") % 3 == 0, " UTC").otherwise("")).alias("hour"),
        F.coalesce("v", F.lit(-9999.0)).alias("radiation"),
        F.when(F.day("ts") % 10 == 0, F.col("lat") + 1.0).otherwise(F.col("lat")).alias("lat"),
        "lon",
        "alt",
    )


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    real = F.col("l_extendedprice") / 1000.0
    return table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_linestatus") == "F", "imputed").otherwise("original").alias("dataset"),
        (F.col("l_suppkey") % N_STATIONS).cast("int").alias("station_id"),
        F.col("l_returnflag").alias("algorithm"),
        F.col("l_shipdate").alias("ts"),
        "l_orderkey",
        "l_linenumber",
        real.alias("real"),
        (real * (F.lit(0.8) + ((F.col("l_partkey") * 7 + F.col("l_suppkey") * 13) % 41) / 100.0)).alias("pred"),
    )


def site_preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = stations(spark, sf_dir).where(F.col("status") == "train").select("station_id")
    return hourly(spark, sf_dir).join(train, "station_id", "left_semi").select(
        "station_id", "ts", (F.col("v") * (F.lit(0.9) + (F.col("station_id") % 5) * 0.05)).alias("pred"), F.col("v").alias("real")
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return station_pairs(stations(spark, sf_dir), 120.0)


def train_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = stations(spark, sf_dir)
    return station_pairs(sites, 120.0, sites.where(F.col("status") == "train"), exclude_zero=True)


def model_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = forecasts(spark, sf_dir).withColumn("year", F.year("ts")).withColumnRenamed("algorithm", "model")
    scored = regression_metrics(runs, ["dataset", "station_id", "model", "year"])
    params = F.concat(
        F.lit('{"max_depth": '),
        (F.lit(4) + F.col("year") % 3).cast("string"),
        F.lit(', "n_estimators": '),
        (F.lit(100) + (F.col("year") % 4) * 50).cast("string"),
        F.lit(', "gamma": '),
        F.when(F.col("year") % 2 == 0, "nan").otherwise("0.05"),
        F.lit("}"),
    )
    return scored.select(
        "dataset",
        "station_id",
        "model",
        F.concat(F.col("year").cast("string"), F.lit("-01-01-00-00-00")).alias("timestamp"),
        "rmse",
        "mae",
        "mape",
        "mbe",
        "r2",
        params.alias("params"),
    )


def best_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_by_station(model_runs(spark, sf_dir), ("dataset", "station_id"))


def best_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blend_runs(model_runs(spark, sf_dir), RUN_COLUMNS)


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return estimator_errors(best_overall(spark, sf_dir))


def error_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_errors(train_pairs(spark, sf_dir), errors(spark, sf_dir))


def composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = hourly(spark, sf_dir).withColumnRenamed("v", "real")
    return compose(site_preds(spark, sf_dir).drop("real"), error_pairs(spark, sf_dir), truth)


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    home = key % 3 == 0
    years = (F.lit(2001) + key % 20).cast("string")
    return table(spark, sf_dir, "customer").select(
        F.concat(
            F.lit("INMET_"),
            F.when(home, "SE").otherwise("S"),
            F.lit("_"),
            F.when(home, "SP").otherwise("PR"),
            F.lit("_"),
            F.when(key % 97 == 0, "C891").otherwise(F.concat(F.lit("A"), (F.lit(500) + key % 260).cast("string"))),
            F.lit("_"),
            F.upper(F.replace("c_mktsegment", F.lit(" "), F.lit("-"))),
            F.when(key % 2 == 0, " DO SUL").otherwise(""),
            F.lit("_01-01-"),
            years,
            F.lit("_A_31-12-"),
            years,
            F.lit(".CSV"),
        ).alias("file_name")
    )
