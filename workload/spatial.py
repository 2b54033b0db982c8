"""Distance joins and inverse distance weighting."""

from __future__ import annotations

from pyspark.sql import functions as F

from sunmesh.functions.geo import haversine_km
from sunmesh.operators.idw import impute_cascade, impute_single_pass, interpolate, neighbour_values
from sunmesh.operators.sizing import small_side
from sunmesh.operators.slots import rank_neighbours
from workload import fixtures as fx
from workload.core import query


@query("c1_pairs_within_distance", "select * from pairs", ["dist"])
def pairs_within_distance(spark, sf_dir):
    return fx.pairs(spark, sf_dir)


@query("c2_train_neighbours", "select * from train_pairs", ["dist"])
def train_neighbours(spark, sf_dir):
    return fx.train_pairs(spark, sf_dir)


@query(
    "c3_pair_errors",
    "select p.station_id, p.neighbour_id, p.dist, e.error from train_pairs p join errors e on e.station_id = p.neighbour_id",
    ["dist", "error"],
)
def pair_errors(spark, sf_dir):
    return fx.error_pairs(spark, sf_dir)


@query(
    "c4_same_time_neighbours",
    """
    select g.station_id, g.ts, p.neighbour_id, p.dist, h.v
    from grid g join pairs p on p.station_id = g.station_id
    join hourly h on h.station_id = p.neighbour_id and h.ts = g.ts
    where g.v is null""",
    ["dist", "v"],
)
def same_time_neighbours(spark, sf_dir):
    gaps = fx.grid(spark, sf_dir).where(F.col("v").isNull()).select("station_id", "ts")
    near = neighbour_values(gaps, fx.pairs(spark, sf_dir), fx.hourly(spark, sf_dir), ["v"])
    return near.select("station_id", "ts", "neighbour_id", "dist", "v")


@query(
    "c5_wide_neighbour_predictions",
    "select p.station_id, f.ts, "
    + ", ".join(f"max(case when p.neighbour_id = {i} then f.pred end) as n_{i}" for i in range(fx.N_STATIONS))
    + " from train_pairs p join site_preds f on f.station_id = p.neighbour_id group by p.station_id, f.ts",
    [f"n_{i}" for i in range(fx.N_STATIONS)],
    8,
)
def wide_neighbour_predictions(spark, sf_dir):
    preds = fx.site_preds(spark, sf_dir).select(F.col("station_id").alias("neighbour_id"), "ts", "pred").repartition("ts")
    long = preds.join(small_side(fx.train_pairs(spark, sf_dir)), "neighbour_id")
    wide = long.groupBy("station_id", "ts").pivot("neighbour_id", list(range(fx.N_STATIONS))).agg(F.max("pred"))
    return wide.withColumnsRenamed({str(i): f"n_{i}" for i in range(fx.N_STATIONS)})


@query(
    "d1_idw_standard",
    """
    select p.station_id, h.ts, sum(h.v / (p.dist * p.dist)) / sum(1e0 / (p.dist * p.dist)) as interpolated, count(*) as n_points
    from pairs p join hourly h on h.station_id = p.neighbour_id group by p.station_id, h.ts""",
    ["interpolated"],
)
def idw_standard(spark, sf_dir):
    source = fx.hourly(spark, sf_dir).withColumnRenamed("station_id", "neighbour_id").repartition("ts")
    near = source.join(small_side(fx.pairs(spark, sf_dir)), "neighbour_id")
    return interpolate(near, ["station_id", "ts"], "v")


@query(
    "d2_idw_error_weighted",
    """
    select station_id, ts, sum(pred / (dist * dist * error)) / sum(1e0 / (dist * dist * error)) as interpolated,
           count(*) as n_points
    from near group by station_id, ts having count(*) >= 3""",
    ["interpolated"],
)
def idw_error_weighted(spark, sf_dir):
    preds = fx.site_preds(spark, sf_dir).select(F.col("station_id").alias("neighbour_id"), "ts", "pred").repartition("ts")
    near = preds.join(small_side(fx.error_pairs(spark, sf_dir)), "neighbour_id")
    return interpolate(near, ["station_id", "ts"], "pred", error="error", min_points=3)


@query(
    "d3_impute_single_pass",
    """
    select g.station_id, g.ts, sum(h.v / (p.dist * p.dist)) / sum(1e0 / (p.dist * p.dist)) as v
    from grid g join pairs p on p.station_id = g.station_id
    join hourly h on h.station_id = p.neighbour_id and h.ts = g.ts
    where g.v is null group by g.station_id, g.ts having count(*) >= 3""",
    ["v"],
)
def single_pass(spark, sf_dir):
    grid = fx.grid(spark, sf_dir).withColumn("gap", F.col("v").isNull())
    filled = impute_single_pass(grid, fx.pairs(spark, sf_dir), ["v"])
    return filled.where(F.col("gap") & F.col("v").isNotNull()).select("station_id", "ts", "v")


@query(
    "d3_impute_all_features",
    "select r.station_id, r.ts, "
    + ", ".join(f"coalesce(r.{c}, case when o.n_{c} >= 3 then o.v_{c} end) as {c}" for c in fx.FEATURES)
    + " from readings r left join (select r.station_id, r.ts, "
    + ", ".join(
        f"count(b.{c}) as n_{c}, sum(b.{c} / (p.dist * p.dist)) / sum(case when b.{c} is not null then 1e0 / (p.dist * p.dist) end) as v_{c}"
        for c in fx.FEATURES
    )
    + """ from readings r join pairs p on p.station_id = r.station_id
          join readings b on b.station_id = p.neighbour_id and b.ts = r.ts group by r.station_id, r.ts) o
          on o.station_id = r.station_id and o.ts = r.ts""",
    fx.FEATURES,
)
def all_features(spark, sf_dir):
    return impute_single_pass(fx.readings(spark, sf_dir), fx.pairs(spark, sf_dir), fx.FEATURES)


# One list of station values per hour, updated station by station; ids are list positions.
CASCADE_SQL = """
with recursive lists as (
  select station_id as s, list({'nb': neighbour_id, 'dist': dist} order by neighbour_id) as l from pairs group by station_id),
fill(ts, k, orig, vals) as (
  select ts, 0, list(v order by station_id), list(v order by station_id) from grid group by ts
  union all
  select ts, k + 1, orig,
         case when vals[k + 1] is not null or len(list_filter(l, lambda x: vals[x.nb + 1] is not null)) < 3 then vals
              else list_concat(vals[1:k], [
                list_sum(list_transform(list_filter(l, lambda x: vals[x.nb + 1] is not null), lambda x: vals[x.nb + 1] / (x.dist * x.dist)))
                / list_sum(list_transform(list_filter(l, lambda x: vals[x.nb + 1] is not null), lambda x: 1e0 / (x.dist * x.dist)))],
                vals[k + 2:]) end
  from fill r join lists nl on nl.s = r.k where k < 25),
filled as (select ts, unnest(range(25)) as station_id, unnest(vals) as v, unnest(orig) as ov from fill where k = 25)
select cast(station_id as int) as station_id, ts, v from filled where ov is null and v is not null"""


@query("d3_impute_cascade", CASCADE_SQL, ["v"])
def cascade(spark, sf_dir):
    grid = fx.grid(spark, sf_dir).withColumn("gap", F.col("v").isNull())
    filled = impute_cascade(grid, fx.stations(spark, sf_dir), fx.pairs(spark, sf_dir), ["v"])
    return filled.where(F.col("gap") & F.col("v").isNotNull()).select("station_id", "ts", "v")


@query(
    "e8_neighbours_by_error",
    """
    select p.station_id, p.neighbour_id, p.dist, e.error,
           cast(row_number() over (partition by p.station_id order by e.error, p.neighbour_id) as int) as neighbour_rank
    from train_pairs p join errors e on e.station_id = p.neighbour_id""",
    ["dist", "error"],
)
def neighbours_by_error(spark, sf_dir):
    return rank_neighbours(fx.error_pairs(spark, sf_dir))


@query(
    "h1_great_circle_distance",
    f"""
    select a.station_id, a.event_id, {fx.haversine_sql('a', 's')} as dist from (
      select event_id, cast(user_id % 25 as int) as station_id, -20e0 - (event_id % 100) / 25e0 as lat, -45e0 - value / 100e0 as lon
      from events) a join stations s on s.station_id = a.station_id""",
    ["dist"],
)
def great_circle_distance(spark, sf_dir):
    points = fx.table(spark, sf_dir, "events").select(
        "event_id",
        (F.col("user_id") % fx.N_STATIONS).cast("int").alias("station_id"),
        (F.lit(-20.0) - (F.col("event_id") % 100) / 25.0).alias("plat"),
        (F.lit(-45.0) - F.col("value") / 100.0).alias("plon"),
    )
    joined = points.join(fx.stations(spark, sf_dir), "station_id")
    dist = haversine_km(F.col("plat"), F.col("plon"), F.col("lat"), F.col("lon"))
    return joined.select("station_id", "event_id", dist.alias("dist"))
