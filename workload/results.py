"""Metrics, rankings and reports on model results."""

from __future__ import annotations

from pyspark.sql import functions as F

from sunmesh.operators import metrics as mt
from sunmesh.operators import ranking as rk
from sunmesh.operators.climate import residual_histogram
from sunmesh.plans import comparison as cp
from sunmesh.session import scratch_path
from sunmesh.sources import registry as rg
from sunmesh.sources.tables import store_bucketed
from workload import fixtures as fx
from workload.core import query

SCORES = ["rmse", "mae", "mape", "mbe", "r2"]
FOUR = ["rmse", "mae", "mbe", "r2"]
PARAMETERS = ["max_depth", "n_estimators", "gamma"]


@query(
    "c6_forecast_with_truth",
    "select f.station_id, f.ts, f.pred, h.v as real from site_preds f join hourly h on h.station_id = f.station_id and h.ts = f.ts",
    ["pred", "real"],
    8,
)
def forecast_with_truth(spark, sf_dir):
    truth = fx.hourly(spark, sf_dir).withColumnRenamed("v", "real")
    return fx.site_preds(spark, sf_dir).drop("real").join(truth, ["station_id", "ts"])


@query(
    "c6_bucketed_forecast_with_truth",
    "select f.station_id, f.ts, f.pred, h.v as real from site_preds f join hourly h on h.station_id = f.station_id and h.ts = f.ts",
    ["pred", "real"],
    8,
)
def bucketed_forecast_with_truth(spark, sf_dir):
    """Forecasts and truth stored in equal buckets by station and time, joined without an exchange."""
    keys = ["station_id", "ts"]
    truth = store_bucketed(fx.hourly(spark, sf_dir).withColumnRenamed("v", "real"), "truth", keys, keys)
    forecasts = store_bucketed(fx.site_preds(spark, sf_dir).drop("real"), "forecasts", keys, keys)
    return forecasts.join(truth.hint("merge"), keys)


@query("c7_blend_best_models", "select * from best_overall", SCORES)
def blend_best_models(spark, sf_dir):
    return fx.best_overall(spark, sf_dir)


@query(
    "c8_estimators_with_sites",
    """select s.station_id, s.lat, s.lon, b.model, b.rmse, b.mae, (b.rmse + b.mae) / 2e0 as error
       from best_overall b join stations s on s.station_id = b.station_id""",
    ["lat", "lon", "rmse", "mae", "error"],
)
def estimators_with_sites(spark, sf_dir):
    best = fx.best_overall(spark, sf_dir)
    joined = best.join(fx.stations(spark, sf_dir), "station_id").join(fx.errors(spark, sf_dir), "station_id")
    return joined.select("station_id", "lat", "lon", "model", "rmse", "mae", "error")


@query(
    "c10_two_methods",
    "select i.station_id, "
    + ", ".join(f"i.{m} as {m}_imputed, o.{m} as {m}_original" for m in FOUR)
    + """ from (select * from best_models where dataset = 'imputed') i
         join (select * from best_models where dataset = 'original') o on o.station_id = i.station_id""",
    [f"{m}_{d}" for m in FOUR for d in ("imputed", "original")],
)
def two_methods(spark, sf_dir):
    scores = fx.best_models(spark, sf_dir).withColumnRenamed("dataset", "method")
    return cp.compare_methods(scores, ["imputed", "original"], FOUR)


@query(
    "c11_complete_sites",
    """
    select e.station_id, e.rmse as rmse_emp, m.rmse as rmse_ml, m.is_interp from (
      select station_id, case when count(*) > 1000 then sqrt(avg(pow(pred - real, 2))) end as rmse from forecasts group by station_id) e
    join best_overall m on m.station_id = e.station_id where e.rmse is not null and m.rmse is not null""",
    ["rmse_emp", "rmse_ml"],
)
def complete_sites(spark, sf_dir):
    rmse = mt.METRICS["rmse"](F.col("pred"), F.col("real"))
    emp = fx.forecasts(spark, sf_dir).groupBy("station_id").agg(
        F.when(F.count(F.lit(1)) > 1000, rmse).alias("rmse_emp")
    )
    ml = fx.best_overall(spark, sf_dir).select("station_id", F.col("rmse").alias("rmse_ml"), "is_interp")
    return cp.join_complete(emp, ml, "station_id")


@query(
    "c12_stations_left_join",
    "select s.station_id, s.status, b.model, b.rmse from stations s left join best_overall b on b.station_id = s.station_id",
    ["rmse"],
)
def stations_left_join(spark, sf_dir):
    best = fx.best_overall(spark, sf_dir).select("station_id", "model", "rmse")
    return fx.stations(spark, sf_dir).select("station_id", "status").join(best, "station_id", "left")


@query(
    "c13_different_key_names",
    "select b.station_id as station, n.n_name as site_name, b.rmse, b.mae from best_overall b join nation n on n.n_nationkey = b.station_id",
    ["rmse", "mae"],
)
def different_key_names(spark, sf_dir):
    best = fx.best_overall(spark, sf_dir).withColumnRenamed("station_id", "station")
    nation = fx.table(spark, sf_dir, "nation")
    return best.join(nation, best.station == nation.n_nationkey).select(
        "station", nation.n_name.alias("site_name"), "rmse", "mae"
    )


@query(
    "c16_next_untrained_station",
    """
    select d.dataset, a.algorithm, min(case when m.model is null then s.station_id end) as station_id
    from (select unnest(['A', 'N', 'R']) as algorithm) a cross join (select unnest(['imputed', 'original']) as dataset) d cross join stations s
    left join (select distinct dataset, station_id, model from model_runs) m
      on m.dataset = d.dataset and m.station_id = s.station_id and m.model = a.algorithm
    group by d.dataset, a.algorithm""",
)
def next_untrained_station(spark, sf_dir):
    registry = fx.model_runs(spark, sf_dir).withColumnRenamed("model", "algorithm")
    return rk.next_station(fx.stations(spark, sf_dir), registry, {"dataset": ["imputed", "original"], "algorithm": ["A", "N", "R"]})


@query("b2_other_stations", "select station_id, status from stations where station_id not in (7, 11)")
def other_stations(spark, sf_dir):
    return rk.other_stations(fx.stations(spark, sf_dir).select("station_id", "status"), [7, 11])


@query(
    "c16_warm_start",
    "select station_id, status from stations where station_id >= 7",
)
def warm_start(spark, sf_dir):
    return rk.planned_stations(fx.stations(spark, sf_dir).select("station_id", "status"), warm_start=7)


@query(
    "c17_winning_predictions",
    """
    select f.station_id, f.ts, f.l_orderkey, f.l_linenumber, f.pred, f.real from forecasts f join best_overall b
    on b.station_id = f.station_id and b.model = f.algorithm and f.dataset = case when b.is_interp then 'imputed' else 'original' end
       and concat(cast(year(f.ts) as varchar), '-01-01-00-00-00') = b."timestamp" """,
    ["pred", "real"],
    9,
)
def winning_predictions(spark, sf_dir):
    best = fx.best_overall(spark, sf_dir)
    winners = best.withColumn("dataset", F.when(F.col("is_interp"), "imputed").otherwise("original"))
    signed = (
        fx.forecasts(spark, sf_dir)
        .withColumnRenamed("algorithm", "model")
        .withColumn("timestamp", F.concat(F.year("ts").cast("string"), F.lit("-01-01-00-00-00")))
    )
    kept = rg.winners_only(signed, winners, ["dataset", "station_id", "model", "timestamp"])
    return kept.select("station_id", "ts", "l_orderkey", "l_linenumber", "pred", "real")


@query(
    "d6_regression_metrics",
    f"select dataset, station_id, algorithm, {fx.METRICS_SQL} from forecasts group by dataset, station_id, algorithm",
    SCORES,
)
def regression_metrics(spark, sf_dir):
    return mt.regression_metrics(fx.forecasts(spark, sf_dir), ["dataset", "station_id", "algorithm"])


@query(
    "d7_composition_metrics",
    """
    select c.station_id, c.rmse, c.mae, c.mbe, c.r2, c.n_samples, n.n_stations from (
      select station_id, sqrt(avg(pow(comp_pred - real, 2))) as rmse, avg(abs(comp_pred - real)) as mae, avg(comp_pred - real) as mbe,
             case when count(*) >= 2 then 1e0 - sum(pow(comp_pred - real, 2)) / nullif(count(*) * var_pop(real), 0) end as r2,
             count(*) as n_samples
      from composition group by station_id) c
    join (select station_id, count(distinct neighbour_id) as n_stations from near group by station_id) n on n.station_id = c.station_id""",
    FOUR,
)
def composition_metrics(spark, sf_dir):
    neighbours = fx.error_pairs(spark, sf_dir).join(
        fx.site_preds(spark, sf_dir).select(F.col("station_id").alias("neighbour_id")).distinct(), "neighbour_id", "left_semi"
    )
    return mt.composition_metrics(fx.composition(spark, sf_dir), neighbours)


@query(
    "d8_metric_variants",
    """
    select station_id, avg(real - pred) as mbe_reversed,
           1e0 - sum(pow(pred - real, 2)) / (count(*) * var_pop(pred)) as r2_swapped,
           (sum(pow(real - m, 2)) - sum(pow(pred - m, 2))) / sum(pow(real - m, 2)) as r2_variance_ratio
    from (select station_id, pred, real, avg(real) over (partition by station_id) as m from forecasts) f group by station_id""",
    ["mbe_reversed", "r2_swapped", "r2_variance_ratio"],
)
def metric_variants(spark, sf_dir):
    names = ["mbe_reversed", "r2_swapped", "r2_variance_ratio"]
    return mt.regression_metrics(fx.forecasts(spark, sf_dir), ["station_id"], names=names)


@query(
    "d10_mean_and_deviation",
    "select dataset, " + ", ".join(f"avg({m}) as {m}_mean, stddev_samp({m}) as {m}_std" for m in FOUR) + " from best_models group by dataset",
    [f"{m}_{s}" for m in FOUR for s in ("mean", "std")],
)
def mean_and_deviation(spark, sf_dir):
    return mt.summarise_methods(fx.best_models(spark, sf_dir), "dataset")


@query(
    "d11_report_with_mean",
    "select station_id, rmse, mae, mbe, r2 from best_overall union all select null, avg(rmse), avg(mae), avg(mbe), avg(r2) from best_overall",
    FOUR,
)
def report_with_mean(spark, sf_dir):
    return mt.report_with_mean(fx.best_overall(spark, sf_dir), "station_id", FOUR)


@query(
    "d12_sample_counts",
    """
    with c as (select station_id, count(*) filter (where year(ts) < 1997) as train, count(*) filter (where year(ts) >= 1997) as test
               from forecasts group by station_id)
    select cast(sum(train) as bigint) as train_total, cast(sum(test) as bigint) as test_total, avg(train) as train_mean, avg(test) as test_mean,
           min(train) as train_min, min(test) as test_min, max(train) as train_max, max(test) as test_max from c""",
    ["train_mean", "test_mean"],
)
def sample_counts(spark, sf_dir):
    counts = cp.samples_by_station(
        fx.forecasts(spark, sf_dir).withColumn("split", F.when(F.year("ts") < 1997, "train").otherwise("test"))
    )
    return cp.sample_totals(counts)


@query(
    "d12_samples_by_station",
    """select station_id, count(*) filter (where year(ts) < 1997) as train, count(*) filter (where year(ts) >= 1997) as test
       from forecasts group by station_id""",
)
def samples_by_station(spark, sf_dir):
    return cp.samples_by_station(
        fx.forecasts(spark, sf_dir).withColumn("split", F.when(F.year("ts") < 1997, "train").otherwise("test"))
    )


@query(
    "d16_residual_histogram",
    """
    with f as (select station_id, real - pred as residual,
                      row_number() over (partition by station_id order by ts, l_orderkey, l_linenumber, pred) - 1 as x from forecasts),
    r as (select station_id, min(residual) as lo, max(residual) as hi, count(*) - 1 as last from f group by station_id)
    select f.station_id, cast(least(floor(x / last::double * 150), 149) as int) as x_bin,
           cast(least(floor((residual - lo) / (hi - lo) * 60), 59) as int) as y_bin, count(*) as n
    from f join r on r.station_id = f.station_id group by 1, 2, 3""",
)
def histogram(spark, sf_dir):
    residuals = fx.forecasts(spark, sf_dir).withColumn("residual", F.col("real") - F.col("pred"))
    return residual_histogram(residuals, ["station_id"], ["ts", "l_orderkey", "l_linenumber", "pred"], "residual")


@query(
    "d17_distinct_counts",
    "select count(distinct station_id) as n_stations, count(distinct model) as n_models, count(distinct \"timestamp\") as n_timestamps from model_runs",
)
def distinct_counts(spark, sf_dir):
    return fx.model_runs(spark, sf_dir).agg(
        F.count_distinct("station_id").alias("n_stations"),
        F.count_distinct("model").alias("n_models"),
        F.count_distinct("timestamp").alias("n_timestamps"),
    )


@query(
    "d18_parameter_report",
    """
    select dataset, station_id, model, json_extract_string(p, '$.max_depth') as max_depth, json_extract_string(p, '$.n_estimators') as n_estimators,
           json_extract_string(p, '$.gamma') as gamma from (
      select dataset, station_id, model, replace(params, 'nan', 'null') as p from (
        select *, row_number() over (partition by dataset, station_id, model order by rmse, mae, mbe, r2, "timestamp") as rn
        from model_runs) t where rn = 1) b""",
)
def parameter_report(spark, sf_dir):
    best = rk.best_by_algorithm(fx.model_runs(spark, sf_dir), ("dataset", "station_id", "model"))
    return rg.parameter_report(best, PARAMETERS, ["dataset", "station_id"])


@query("d20_latest_model", 'select max("timestamp") as "timestamp" from model_runs')
def latest_model(spark, sf_dir):
    return rg.latest(fx.model_runs(spark, sf_dir))


@query(
    "e3_best_by_algorithm",
    """
    select dataset, station_id, model, "timestamp", rmse, mae, mape, mbe, r2, params from (
      select *, row_number() over (partition by dataset, station_id, model order by rmse, mae, mbe, r2, "timestamp") as rn
      from model_runs) t where rn = 1""",
    SCORES,
)
def best_by_algorithm(spark, sf_dir):
    return rk.best_by_algorithm(fx.model_runs(spark, sf_dir), ("dataset", "station_id", "model"))


def _criterion_sql(order: str) -> str:
    return f"""select dataset, station_id, model, "timestamp", rmse, mae, mape, mbe, r2, params from (
      select *, row_number() over (partition by dataset, station_id order by {order}, "timestamp", model) as rn from model_runs) t where rn = 1"""


@query("e4_best_by_mae", _criterion_sql("mae, rmse, mbe, r2"), SCORES)
def best_by_mae(spark, sf_dir):
    return rk.best_by_station(fx.model_runs(spark, sf_dir), ("dataset", "station_id"), "mae")


@query("e4_best_by_bias", _criterion_sql("mbe, rmse, mae, r2"), SCORES)
def best_by_bias(spark, sf_dir):
    return rk.best_by_station(fx.model_runs(spark, sf_dir), ("dataset", "station_id"), "mbe")


@query("e4_best_by_absolute_bias", _criterion_sql("abs(mbe), rmse, mae, -r2"), SCORES)
def best_by_absolute_bias(spark, sf_dir):
    return rk.best_by_station(fx.model_runs(spark, sf_dir), ("dataset", "station_id"), "mbe", corrected=True)


@query(
    "f2_sorted_results",
    "select station_id, model, rmse, mae, r2 from best_overall order by rmse desc, mae desc, r2 desc",
    ["rmse", "mae", "r2"],
)
def sorted_results(spark, sf_dir):
    best = fx.best_overall(spark, sf_dir).select("station_id", "model", "rmse", "mae", "r2")
    return best.orderBy(F.desc("rmse"), F.desc("mae"), F.desc("r2"))


@query(
    "f3_top_and_bottom_three",
    """
    (select station_id, model, rmse, 'best' as side from best_overall order by rmse, station_id limit 3) union all
    (select station_id, model, rmse, 'worst' as side from best_overall order by rmse desc, station_id desc limit 3)""",
    ["rmse"],
)
def top_and_bottom_three(spark, sf_dir):
    best = fx.best_overall(spark, sf_dir).select("station_id", "model", "rmse")
    return rk.with_ends(best, [F.col("rmse"), F.col("station_id")], [F.desc("rmse"), F.desc("station_id")], 3)


DIFFERENCES_SQL = """select i.station_id, o.rmse - i.rmse as diff_rmse, o.mae - i.mae as diff_mae, o.r2 - i.r2 as diff_r2, o.mbe - i.mbe as diff_mbe
    from (select * from best_models where dataset = 'imputed') i
    join (select * from best_models where dataset = 'original') o on o.station_id = i.station_id"""


@query(
    "f4_largest_differences",
    f"""
    with d as ({DIFFERENCES_SQL})
    (select *, 'best' as side from d order by diff_rmse desc, diff_mae desc limit 4) union all
    (select *, 'worst' as side from d order by diff_rmse, diff_mae limit 4)""",
    ["diff_rmse", "diff_mae", "diff_r2", "diff_mbe"],
)
def largest_differences(spark, sf_dir):
    differences = cp.metric_differences(two_methods(spark, sf_dir), "original", "imputed", ["rmse", "mae", "r2", "mbe"])
    return rk.with_ends(
        differences, [F.desc("diff_rmse"), F.desc("diff_mae")], [F.asc("diff_rmse"), F.asc("diff_mae")], 4
    )


@query(
    "g2_stations_without_model",
    "select station_id from stations except select station_id from best_models where dataset = 'imputed' and rmse < 5.6",
)
def stations_without_model(spark, sf_dir):
    good = fx.best_models(spark, sf_dir).where((F.col("dataset") == "imputed") & (F.col("rmse") < 5.6)).select("station_id")
    return fx.stations(spark, sf_dir).select("station_id").exceptAll(good)


@query(
    "g3_stations_in_all_methods",
    "select station_id from best_models where dataset = 'imputed' intersect select station_id from best_models where dataset = 'original'",
)
def stations_in_all_methods(spark, sf_dir):
    best = fx.best_models(spark, sf_dir)
    ids = lambda name: best.where(F.col("dataset") == name).select("station_id")
    return ids("imputed").intersect(ids("original"))


@query(
    "h12_parse_parameters",
    """
    select dataset, station_id, model, "timestamp", json_extract_string(p, '$.max_depth') as max_depth,
           json_extract_string(p, '$.gamma') as gamma, cast(len(json_keys(p)) as int) as n_params
    from (select *, cast(replace(params, 'nan', 'null') as json) as p from model_runs) t""",
)
def parse_parameters(spark, sf_dir):
    parsed = fx.model_runs(spark, sf_dir).withColumn("p", rg.parse_params(F.col("params")))
    return parsed.select(
        "dataset", "station_id", "model", "timestamp", F.col("p")["max_depth"].alias("max_depth"), F.col("p")["gamma"].alias("gamma"), F.size("p").alias("n_params")
    )


REGISTRY_SQL = """select dataset, station_id, model, "timestamp", concat('sk_', model, '_', "timestamp", '.dat') as file_name from model_runs"""


def _registry(spark, sf_dir):
    runs = fx.model_runs(spark, sf_dir).select("dataset", "station_id", "model", "timestamp")
    return runs.withColumn("file_name", rg.model_file_name(F.col("model"), F.col("timestamp")))


@query("i13_registry_checkpoint", REGISTRY_SQL + """ where "timestamp" <= '1996-06-01-00-00-00' """)
def registry_checkpoint(spark, sf_dir):
    return rg.keep_to_checkpoint(_registry(spark, sf_dir), "1996-06-01-00-00-00")


@query("i13_registry_clear", REGISTRY_SQL + " where dataset <> 'imputed'")
def registry_clear(spark, sf_dir):
    return rg.clear(_registry(spark, sf_dir), "imputed")


@query(
    "i13_registry_stored",
    f"select dataset, station_id, model, \"timestamp\", path from (select *, file_name as path from ({REGISTRY_SQL})) r "
    "where \"timestamp\" <= '1996-06-01-00-00-00' and dataset <> 'imputed'",
)
def registry_stored(spark, sf_dir):
    """Stored, cut at a checkpoint, cleared of a data set, and read back."""
    root = scratch_path(spark, "registry")
    rg.store_registry(_registry(spark, sf_dir).withColumnRenamed("file_name", "path").withColumn("path", F.concat(F.lit(f"{root}/models/"), "path")), root)
    rg.replace_registry(spark, root, lambda stored: rg.keep_to_checkpoint(stored, "1996-06-01-00-00-00"))
    rg.replace_registry(spark, root, lambda stored: rg.clear(stored, "imputed"))
    return rg.stored_registry(spark, root).withColumn("path", F.element_at(F.split("path", "/"), -1))


@query(
    "i13_registry_file_names",
    f"""select file_name, dataset, station_id, regexp_extract(file_name, '^sk_([A-Za-z]+)_', 1) as parsed_model,
        regexp_extract(file_name, '_([0-9-]+)[.]dat$', 1) as parsed_timestamp from ({REGISTRY_SQL}) r""",
)
def registry_file_names(spark, sf_dir):
    model, timestamp = rg.parse_model_file(F.col("file_name"))
    return _registry(spark, sf_dir).select(
        "file_name", "dataset", "station_id", model.alias("parsed_model"), timestamp.alias("parsed_timestamp")
    )


@query(
    "i19_winners_of_both_datasets",
    """
    select m.dataset, m.station_id, m.model, m."timestamp", m.rmse from model_runs m join best_overall b
    on b.station_id = m.station_id and b.model = m.model and b."timestamp" = m."timestamp"
       and m.dataset = case when b.is_interp then 'imputed' else 'original' end""",
    ["rmse"],
)
def winners_of_both_datasets(spark, sf_dir):
    runs = fx.model_runs(spark, sf_dir)
    winners = fx.best_overall(spark, sf_dir).withColumn("dataset", F.when(F.col("is_interp"), "imputed").otherwise("original"))
    kept = rg.winners_only(runs, winners, ["dataset", "station_id", "model", "timestamp"])
    return kept.select("dataset", "station_id", "model", "timestamp", "rmse")


@query(
    "i22_best_parameters",
    """
    select dataset, station_id, model, key as name, json_extract_string(p, '$.' || key) as value from (
      select dataset, station_id, model, p, unnest(json_keys(p)) as key from (
        select dataset, station_id, model, cast(replace(params, 'nan', 'null') as json) as p from (
          select *, row_number() over (partition by dataset, station_id, model order by rmse, mae, mbe, r2, "timestamp") as rn
          from model_runs) t where rn = 1) b) k""",
)
def best_parameters(spark, sf_dir):
    best = rk.best_by_algorithm(fx.model_runs(spark, sf_dir), ("dataset", "station_id", "model"))
    return rg.parameters_long(best, ["dataset", "station_id"])
