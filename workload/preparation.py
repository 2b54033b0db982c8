"""The whole preparation job on readings spread over all raw columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from sunmesh import schemas
from sunmesh.plans.preparation import Settings, prepare
from workload import fixtures as fx
from workload.core import query

SETTINGS = Settings(max_km=120.0, min_rows=100, test_years=(2025, 2025), max_radiation=400.0)


def _full_readings(spark, sf_dir):
    """Every raw column as a shifted copy of the hourly value; some cells missing, the last ten days in 2025."""
    hourly = fx.hourly(spark, sf_dir)
    ts = F.when(F.day("ts") >= 20, F.col("ts") + F.make_ym_interval(F.lit(1))).otherwise(F.col("ts"))
    cells = {}
    for i, name in enumerate(schemas.MEASUREMENTS):
        value = F.col("v") + 20.0 + i + F.hour("ts") % (i + 2)
        gap = (F.col("station_id") + F.day("ts") + i) % 23 == 0
        cells[name] = value if name == "vento_rajada" else F.when(~gap, value)
    sites = fx.stations(spark, sf_dir).select("station_id", *[F.col(a).alias(b) for a, b in zip(("lat", "lon", "alt"), schemas.COORDINATES)])
    rows = hourly.join(sites, "station_id").withColumns(cells)
    return rows.select(F.lpad(F.col("station_id").cast("string"), 3, "0").alias("station_id"), ts.alias("ts"), *schemas.MEASUREMENTS, *schemas.COORDINATES)


def _cell(i: int, name: str) -> str:
    value = f"v + 20e0 + {i} + hour(ts) % {i + 2}"
    return f"{value} as {name}" if name == "vento_rajada" else f"case when (station_id + day(ts) + {i}) % 23 <> 0 then {value} end as {name}"


RADIATION = ["radiacao_global", schemas.TARGET]
VALUES = [*schemas.MEASUREMENTS, schemas.TARGET]
FEATURES = [*VALUES, "doy", "hour"]


def _kept(name: str) -> str:
    inside = f"{name} > q1_{name} - 1.5e0 * (q3_{name} - q1_{name}) and {name} < q3_{name} + 1.5e0 * (q3_{name} - q1_{name}) + 300e0"
    return f"case when {inside} then {name} end as {name}"


UNFILLED_SQL = f"""
    with cells as (select lpad(cast(station_id as varchar), 3, '0') as station_id, case when day(ts) >= 20 then ts + interval 1 year else ts end as ts,
                          {', '.join(_cell(i, c) for i, c in enumerate(schemas.MEASUREMENTS))} from hourly),
    valid as (select * replace (case when radiacao_global < 400e0 then radiacao_global end as radiacao_global,
                {', '.join(f'case when {c} >= {low}e0 then {c} end as {c}' for c, low in schemas.LOWER_LIMITS.items())}),
                case when radiacao_global < 400e0 then radiacao_global end as raw from cells where hour(ts) between 10 and 21),
    led as (select * exclude (raw), lead(raw) over (partition by station_id order by ts) as {schemas.TARGET} from valid),
    q as (select station_id, hour(ts) as h, {', '.join(f'quantile_cont({c}, 0.25) as q1_{c}, quantile_cont({c}, 0.75) as q3_{c}' for c in RADIATION)}
          from led group by station_id, hour(ts)),
    masked as (select led.* replace ({', '.join(_kept(c) for c in RADIATION)}) from led join q on q.station_id = led.station_id and q.h = hour(led.ts)),
    complete as (select *, cast(dayofyear(ts) as double) as doy, cast(hour(ts) as double) as hour, case when year(ts) < 2025 then 'train' else 'test' end as split
                 from masked where {' and '.join(f'{c} is not null' for c in VALUES)}),
    enough as (select station_id from complete group by station_id
               having count(*) >= 30 and count(*) filter (where split = 'train') > 0 and count(*) filter (where split = 'test') > 0),
    p as (select station_id, {', '.join(f'quantile_cont({c}, 0.5) as m_{c}, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) as s_{c}' for c in FEATURES)}
          from complete where split = 'train' group by station_id)
    select c.station_id, c.ts, c.split, {', '.join(f'(c.{c} - m_{c}) / case when s_{c} = 0 then 1e0 else s_{c} end as {c}' for c in FEATURES)}
    from complete c join enough e on e.station_id = c.station_id join p on p.station_id = c.station_id"""


@query("prepared_without_imputation", UNFILLED_SQL, FEATURES, 7)
def prepared_without_imputation(spark, sf_dir):
    unfilled = Settings(**{**SETTINGS.__dict__, "impute": "none", "min_rows": 30})
    return prepare(_full_readings(spark, sf_dir), unfilled, pca_groups={}).scaled


@query("prepared_station_sets")
def prepared_station_sets(spark, sf_dir):
    return prepare(_full_readings(spark, sf_dir), SETTINGS).scaled


@query("prepared_station_sets_single_pass")
def prepared_single_pass(spark, sf_dir):
    single = Settings(**{**SETTINGS.__dict__, "impute": "single_pass", "scaling": "std"})
    return prepare(_full_readings(spark, sf_dir), single).scaled
