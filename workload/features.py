"""Scaling, principal components and per-site linear models."""

from __future__ import annotations

from pyspark.sql import functions as F

from sunmesh.operators.moments import (
    apply_pca,
    cross_validated_linear,
    fit_linear,
    fit_pca,
    predict_linear,
)
from sunmesh.operators.scaling import apply_scaler, fit_scaler, invert_scaler
from workload import fixtures as fx
from workload.core import query

PARAMS = ["center", "scale"]


def _params_sql(center: str, scale: str, where: str = "") -> str:
    return " union all ".join(
        f"select station_id, '{c}' as feature, {center.format(c=c)} as center, "
        f"case when {scale.format(c=c)} = 0 then 1e0 else {scale.format(c=c)} end as scale "
        f"from readings where {c} is not null {where} group by station_id"
        for c in fx.FEATURES
    )


STANDARD_SQL = _params_sql("avg({c})", "stddev_pop({c})")


@query("i2_standard_scaler", STANDARD_SQL, PARAMS, 8)
def standard_scaler(spark, sf_dir):
    return fit_scaler(fx.readings(spark, sf_dir), fx.FEATURES, "std")


@query("i3_range_scaler", _params_sql("min({c})", "max({c}) - min({c})"), PARAMS)
def range_scaler(spark, sf_dir):
    return fit_scaler(fx.readings(spark, sf_dir), fx.FEATURES, "mM")


@query("i4_robust_scaler", _params_sql("quantile_cont({c}, 0.5)", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"), PARAMS)
def robust_scaler(spark, sf_dir):
    return fit_scaler(fx.readings(spark, sf_dir), fx.FEATURES, "rbst")


@query(
    "i5_inverse_scaling",
    """select s.station_id, s.ts, (s.real - p.mr) / p.sr as real, (s.pred - p.mp) / p.sp * p.sr + p.mr as pred from site_preds s join (
      select station_id, avg(real) as mr, avg(pred) as mp, case when stddev_pop(real) = 0 then 1e0 else stddev_pop(real) end as sr,
             case when stddev_pop(pred) = 0 then 1e0 else stddev_pop(pred) end as sp from site_preds group by station_id) p
    on p.station_id = s.station_id""",
    ["pred", "real"],
)
def inverse_scaling(spark, sf_dir):
    preds = fx.site_preds(spark, sf_dir)
    params = fit_scaler(preds, ["pred", "real"], "std")
    scaled = apply_scaler(preds, params, ["pred", "real"])
    # The forecast is taken back to units by the truth's parameters; the truth stays scaled.
    return invert_scaler(scaled, params, {"pred": "real"})


@query(
    "i6_fit_on_train_apply_to_all",
    f"with p as ({_params_sql('avg({c})', 'stddev_pop({c})', 'and day(ts) < 24')}) "
    + "select r.station_id, r.ts, case when day(r.ts) < 24 then 'train' else 'test' end as split, "
    + ", ".join(f"(r.{c} - p_{c}.center) / p_{c}.scale as {c}" for c in fx.FEATURES)
    + " from readings r "
    + " ".join(f"left join p p_{c} on p_{c}.station_id = r.station_id and p_{c}.feature = '{c}'" for c in fx.FEATURES),
    fx.FEATURES,
)
def fit_on_train(spark, sf_dir):
    split = fx.readings(spark, sf_dir).withColumn("split", F.when(F.day("ts") < 24, "train").otherwise("test"))
    params = fit_scaler(split.where(F.col("split") == "train"), fx.FEATURES, "std")
    return apply_scaler(split, params, fx.FEATURES)


# Largest eigenvalue in closed form (trigonometric solution) of each station's 3 x 3 covariance matrix, and
# its direction from the cross product of two rows of the shifted matrix.
PCA_INPUTS = ["x", "y", "z"]
PCA_SOURCE_SQL = """
    select station_id, l_orderkey, l_linenumber, ts, real as x, pred as y, real * 0.5e0 + (l_orderkey % 17) as z from forecasts"""
PCA_SQL = f"""
    with s as ({PCA_SOURCE_SQL}),
    c as (select station_id, avg(x) as mx, avg(y) as my, avg(z) as mz, var_samp(x) as a, var_samp(y) as b, var_samp(z) as d,
                 covar_samp(x, y) as e, covar_samp(x, z) as f, covar_samp(y, z) as g from s group by station_id),
    q as (select *, (a + b + d) / 3e0 as m from c),
    r as (select *, sqrt(((a - m) * (a - m) + (b - m) * (b - m) + (d - m) * (d - m) + 2e0 * (e * e + f * f + g * g)) / 6e0) as p from q),
    t as (select *, ((a - m) * ((b - m) * (d - m) - g * g) - e * (e * (d - m) - g * f) + f * (e * g - (b - m) * f)) / (2e0 * p * p * p) as h from r),
    l as (select *, m + 2e0 * p * cos(acos(greatest(-1e0, least(1e0, h))) / 3e0) as ev from t),
    v as (select *, e * g - f * (b - ev) as vx, f * e - (a - ev) * g as vy, (a - ev) * (b - ev) - e * e as vz from l),
    u as (select *, sqrt(vx * vx + vy * vy + vz * vz)
                    * case when greatest(vx, vy, vz) >= -least(vx, vy, vz) then 1e0 else -1e0 end as len from v)"""


def _pca_source(spark, sf_dir):
    return fx.forecasts(spark, sf_dir).select(
        "station_id",
        "l_orderkey",
        "l_linenumber",
        "ts",
        F.col("real").alias("x"),
        F.col("pred").alias("y"),
        (F.col("real") * 0.5 + F.col("l_orderkey") % 17).alias("z"),
    )


@query(
    "i1_fit_principal_component",
    PCA_SQL + " select station_id, ev as variance, vx / len as load_x, vy / len as load_y, vz / len as load_z from u",
    ["variance", "load_x", "load_y", "load_z"],
)
def fit_principal_component(spark, sf_dir):
    fitted = fit_pca(_pca_source(spark, sf_dir), PCA_INPUTS, 1)
    return fitted.select(
        "station_id", "variance", *[F.get("loadings", F.lit(i)).alias(f"load_{c}") for i, c in enumerate(PCA_INPUTS)]
    )


@query(
    "i1_apply_principal_component",
    PCA_SQL
    + """ select s.station_id, s.l_orderkey, s.l_linenumber, s.ts,
                 ((s.x - mx) * vx + (s.y - my) * vy + (s.z - mz) * vz) / len as pca from s join u on u.station_id = s.station_id""",
    ["pca"],
)
def apply_principal_component(spark, sf_dir):
    source = _pca_source(spark, sf_dir)
    return apply_pca(source, fit_pca(source, PCA_INPUTS, 1), PCA_INPUTS, ["pca"])


@query(
    "i1_two_components",
    PCA_SQL
    + """ select station_id, 0e0 as first_mean, ev as first_variance, 0e0 as second_mean,
                 3e0 * m - ev - (m + 2e0 * p * cos(acos(greatest(-1e0, least(1e0, h))) / 3e0 + 2e0 * pi() / 3e0)) as second_variance from u""",
    ["first_mean", "first_variance", "second_mean", "second_variance"],
)
def two_components(spark, sf_dir):
    source = _pca_source(spark, sf_dir)
    scores = apply_pca(source, fit_pca(source, PCA_INPUTS, 2), PCA_INPUTS, ["first", "second"])
    return scores.groupBy("station_id").agg(
        *[f(c).alias(f"{c}_{n}") for c in ("first", "second") for f, n in ((F.avg, "mean"), (F.var_samp, "variance"))]
    )


@query(
    "i7_site_regression",
    """
    select dataset, station_id, n, intercept, slope from (
      select dataset, station_id, count(*) as n, regr_intercept(real, pred) as intercept, regr_slope(real, pred) as slope
      from forecasts group by dataset, station_id) t""",
    ["intercept", "slope"],
)
def site_regression(spark, sf_dir):
    fitted = fit_linear(fx.forecasts(spark, sf_dir), ["pred"], "real", ["dataset", "station_id"])
    return fitted.select("dataset", "station_id", "n", "intercept", F.get("coefficients", F.lit(0)).alias("slope"))


@query(
    "i7_site_predictions",
    """
    select f.station_id, f.l_orderkey, f.l_linenumber, f.ts, f.real, m.a + m.b * f.pred as corrected from forecasts f join (
      select station_id, regr_intercept(real, pred) as a, regr_slope(real, pred) as b from forecasts group by station_id) m
    on m.station_id = f.station_id""",
    ["real", "corrected"],
)
def site_predictions(spark, sf_dir):
    rows = fx.forecasts(spark, sf_dir).select("station_id", "l_orderkey", "l_linenumber", "ts", "real", "pred")
    models = fit_linear(rows, ["pred"], "real")
    return predict_linear(rows, models, ["pred"], name="corrected").drop("pred")


@query(
    "i8_site_cross_validation",
    """
    with f as (select station_id, ts, pred, v as real, ntile(5) over (partition by station_id order by ts) - 1 as fold
               from (select s.station_id, s.ts, s.pred, s.pred * 2e0 + (day(s.ts) % 5) as v from site_preds s) s),
    k as (select unnest(range(5)) as fold),
    m as (select f.station_id, k.fold, regr_intercept(real, pred) as a, regr_slope(real, pred) as b
          from f join k on f.fold <> k.fold group by f.station_id, k.fold),
    e as (select f.station_id, f.fold, any_value(m.a) as a, any_value(m.b) as b, avg(pow(f.real - m.a - m.b * f.pred, 2)) as mse
          from f join m on m.station_id = f.station_id and m.fold = f.fold group by f.station_id, f.fold)
    select station_id, avg(mse) as mse, arg_min(a, mse) as intercept, arg_min(b, mse) as slope from e group by station_id having count(*) > 1""",
    ["mse", "intercept", "slope"],
)
def site_cross_validation(spark, sf_dir):
    rows = fx.site_preds(spark, sf_dir).withColumn("real", F.col("pred") * 2.0 + F.day("ts") % 5)
    best = cross_validated_linear(rows, ["pred"], "real", ["ts"], refit=False)
    return best.select("station_id", "mse", "intercept", F.get("coefficients", F.lit(0)).alias("slope"))


@query(
    "i9_site_penalty_search",
    """
    with f as (select station_id, ts, pred, pred * 2e0 + (day(ts) % 7) * 9e0 as real, ntile(5) over (partition by station_id order by ts) - 1 as fold
               from site_preds),
    k as (select unnest(range(5)) as fold), p as (select unnest([0e0, 10e0, 1000e0, 10000e0]) as alpha),
    s as (select f.station_id, k.fold, count(*) as n, avg(pred) as mx, avg(real) as my, var_pop(pred) as vx, covar_pop(pred, real) as cxy
          from f join k on f.fold <> k.fold group by f.station_id, k.fold),
    e as (select f.station_id, p.alpha, f.fold, avg(pow(f.real - s.my - s.n * s.cxy / (s.n * s.vx + p.alpha) * (f.pred - s.mx), 2)) as mse
          from f cross join p join s on s.station_id = f.station_id and s.fold = f.fold group by f.station_id, p.alpha, f.fold),
    m as (select station_id, alpha, avg(mse) as mse from e group by station_id, alpha having count(*) > 1),
    b as (select station_id, arg_min(alpha, mse) as alpha, min(mse) as mse from m group by station_id),
    a as (select station_id, count(*) as n, avg(pred) as mx, avg(real) as my, var_pop(pred) as vx, covar_pop(pred, real) as cxy from f group by station_id)
    select b.station_id, b.alpha, b.mse, a.n * a.cxy / (a.n * a.vx + b.alpha) as slope from b join a on a.station_id = b.station_id""",
    ["mse", "slope"],
)
def site_penalty_search(spark, sf_dir):
    rows = fx.site_preds(spark, sf_dir).withColumn("real", F.col("pred") * 2.0 + F.day("ts") % 7 * 9.0)
    best = cross_validated_linear(rows, ["pred"], "real", ["ts"], alphas=[0.0, 10.0, 1000.0, 10000.0])
    return best.select("station_id", "alpha", "mse", F.get("coefficients", F.lit(0)).alias("slope"))
