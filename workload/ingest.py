"""Raw station files, stored tables and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sunmesh import schemas
from sunmesh.functions import text as tx
from sunmesh.operators.slots import first_valid
from sunmesh.plans.comparison import samples_by_station
from sunmesh.session import scratch_path
from sunmesh.sources import station_files as sf
from sunmesh.sources import tables as tb
from sunmesh.operators.scaling import fit_scaler, apply_scaler
from workload import fixtures as fx
from workload.core import query

HEADER_KEYS = ["REGIÃO", "UF", "ESTAÇÃO", "CODIGO (WMO)", "LATITUDE", "LONGITUDE", "ALTITUDE", "DATA DE FUNDAÇÃO"]
NAME_SQL = "concat('INMET_SE_SP_A', cast(700 + station_id as varchar), '_CITY-', cast(station_id as varchar), '_01-01-2024_A_31-12-2024.CSV')"


def _comma(value):
    return F.replace(F.format_string("%.6f", value), F.lit("."), F.lit(","))


def _station_lines(spark, sf_dir):
    """Raw readings as the text lines of station files: eight header lines, a title line, data lines."""
    station = F.col("station_id").cast("string")
    name = F.concat(
        F.lit("INMET_SE_SP_A"), (F.col("station_id") + 700).cast("string"), F.lit("_CITY-"), station, F.lit("_01-01-2024_A_31-12-2024.CSV")
    )
    sites = fx.stations(spark, sf_dir)
    values = [F.lit("SE"), F.lit("SP"), station, F.concat(F.lit("A"), (F.col("station_id") + 700).cast("string"))]
    values += [_comma(F.col(c)) for c in ("lat", "lon", "alt")] + [F.lit("25/07/06")]
    header = F.array(
        *[F.concat(F.lit(f"{k}:;"), v) for k, v in zip(HEADER_KEYS, values)], F.lit("Data;Hora UTC;" + ";".join("x" * 17) + ";")
    )
    headers = sites.select(name.alias("file_name"), F.explode(header).alias("value"))
    # Every measurement is a shifted copy; about one cell in nine is empty.
    cells = [F.col("data"), F.col("hour")]
    for i in range(len(schemas.MEASUREMENTS)):
        empty = (F.col("station_id") + F.substring("data", 9, 2).cast("int") + i) % 9 == 0
        cells.append(F.when(empty, F.lit("")).otherwise(_comma(F.col("radiation") + i)))
    data = fx.raw_readings(spark, sf_dir).select(name.alias("file_name"), F.concat_ws(";", *cells, F.lit("")).alias("value"))
    return headers.unionByName(data)


_MEASURED = ", ".join(
    f"case when (r.station_id + day(r.ts) + {i}) % 9 <> 0 then r.radiation + {i} end as {c}" for i, c in enumerate(schemas.MEASUREMENTS)
)
OBSERVATIONS_SQL = f"""
    select concat('A', cast(700 + r.station_id as varchar)) as station_id, r.ts, {_MEASURED},
           s.lat as latitude, s.lon as longitude, s.alt as altitude
    from raw_readings r join stations s on s.station_id = r.station_id"""
OBSERVED = [*schemas.MEASUREMENTS, *schemas.COORDINATES]


def _written_files(spark, sf_dir):
    path = scratch_path(spark, "station-files")
    _station_lines(spark, sf_dir).write.partitionBy("file_name").option("encoding", "ISO-8859-1").text(path)
    return path


@query("a1_station_file_scan", OBSERVATIONS_SQL, OBSERVED)
def station_file_scan(spark, sf_dir):
    readings = sf.read_station_files(spark, _written_files(spark, sf_dir))
    return readings.select("station_id", "ts", *OBSERVED)


@query("a1_landed_station_files", OBSERVATIONS_SQL, OBSERVED)
def landed_station_files(spark, sf_dir):
    landed = sf.land(spark, _written_files(spark, sf_dir), scratch_path(spark, "landed"))
    return sf.observations(landed).select("station_id", "ts", *OBSERVED)


@query(
    "a2_file_headers",
    f"""
    select {NAME_SQL} as file_name, unnest(['REGIAO', 'UF', 'ESTACAO', 'CODIGO (WMO)', 'LATITUDE', 'LONGITUDE', 'ALTITUDE', 'DATA DE FUNDACAO']) as key,
           unnest(['SE', 'SP', cast(station_id as varchar), concat('A', cast(700 + station_id as varchar)), format('{{:.6f}}', lat),
                   format('{{:.6f}}', lon), format('{{:.6f}}', alt), '25/07/06']) as value from stations""",
)
def file_headers(spark, sf_dir):
    return sf.header_pairs(sf.lines_as_cells(_station_lines(spark, sf_dir)))


FIELDS_SQL = "select file_name, split_part(file_name, '_', 4) as station_id, split_part(file_name, '_', 5) as city from file_names"


@query("a3_station_from_file_name", FIELDS_SQL)
def station_from_file_name(spark, sf_dir):
    name = F.col("file_name")
    fields = [tx.file_name_field(name, 3).alias("station_id"), tx.file_name_field(name, 4).alias("city")]
    return fx.file_names(spark, sf_dir).select(name, *fields)


@query(
    "a4_selected_files",
    f"""select file_name from ({FIELDS_SQL}) f where station_id not in ('{"', '".join(schemas.IGNORED_STATIONS)}')
        and (contains(file_name, '{schemas.REGION_TAG}') or station_id in ('{"', '".join(schemas.EXTRA_STATIONS)}'))""",
)
def selected_files(spark, sf_dir):
    return fx.file_names(spark, sf_dir).where(sf.selected(F.col("file_name")))


@query(
    "a5_concatenated_tables",
    """
    select station_id, ts, radiation, temperature, cast(null as double) as pressure from readings where station_id % 2 = 0 union all
    select station_id, ts, radiation, null, pressure from readings where station_id % 2 = 1""",
    ["radiation", "temperature", "pressure"],
)
def concatenated_tables(spark, sf_dir):
    readings = fx.readings(spark, sf_dir)
    even = readings.where(F.col("station_id") % 2 == 0).select("station_id", "ts", "radiation", "temperature")
    odd = readings.where(F.col("station_id") % 2 == 1).select("station_id", "ts", "radiation", "pressure")
    return sf.concatenate([even, odd])


@query("a6_parquet_round_trip", "select * from readings", fx.FEATURES)
def parquet_round_trip(spark, sf_dir):
    path = tb.write_table(fx.readings(spark, sf_dir), scratch_path(spark, "readings"), cluster_by=["station_id", "ts"])
    return tb.read_table(spark, path)


@query("a7_csv_round_trip", "select station_id, ts, pred, real from site_preds", ["pred", "real"], 8)
def csv_round_trip(spark, sf_dir):
    preds = fx.site_preds(spark, sf_dir)
    return tb.import_csv(spark, tb.export_csv(preds, scratch_path(spark, "predictions")), preds.schema)


@query(
    "a8_matrix_round_trip",
    """
    select r.station_id, r.ts, (r.radiation - p.center) / p.scale as radiation, case when day(r.ts) < 24 then 'train' else 'test' end as split
    from readings r join (select station_id, min(radiation) as center, case when max(radiation) = min(radiation) then 1e0 else max(radiation) - min(radiation) end as scale
                          from readings where day(ts) < 24 group by station_id) p on p.station_id = r.station_id""",
    ["radiation"],
)
def matrix_round_trip(spark, sf_dir):
    split = F.when(F.day("ts") < 24, "train").otherwise("test")
    rows = fx.readings(spark, sf_dir).select("station_id", "ts", "radiation", split.alias("split"))
    params = fit_scaler(rows.where(F.col("split") == "train"), ["radiation"], "mM")
    scaled = apply_scaler(rows, params, ["radiation"])
    return tb.read_table(spark, tb.write_matrices(scaled, scratch_path(spark, "matrices")))


@query(
    "a10_partitioned_layout",
    "select station_id, algorithm, ts, pred, dataset from forecasts where dataset = 'imputed'",
    ["pred"],
    9,
)
def partitioned_layout(spark, sf_dir):
    rows = fx.forecasts(spark, sf_dir).select("station_id", "algorithm", "ts", "pred", "dataset")
    path = tb.write_table(rows, scratch_path(spark, "forecasts"), ["dataset"], ["station_id", "ts"])
    return tb.read_table(spark, path).where(F.col("dataset") == "imputed")


@query(
    "a11_samples_file",
    """select cast(station_id as varchar) as station, count(*) filter (where day(ts) < 24) as train, count(*) filter (where day(ts) >= 24) as test
       from readings group by station_id""",
)
def samples_file(spark, sf_dir):
    split = F.when(F.day("ts") < 24, "train").otherwise("test")
    counts = samples_by_station(fx.readings(spark, sf_dir).withColumn("split", split))
    texts = counts.select(F.col("station_id").cast("string").alias("station"), "train", "test")
    return tb.read_samples(spark, tb.export_csv(texts, scratch_path(spark, "samples")))


@query(
    "d4_station_summary",
    """
    select r.station_id, min(r.lat) as latitude, min(r.lon) as longitude, min(r.alt) as altitude,
           strftime(min(r.ts), '%d/%m/%Y') as first_register, count(*) as n_samples, any_value(c.city_name) as city_name
    from raw_readings r left join (
      select s.station_id, n.n_name as city_name from stations s join nation n on n.n_nationkey = s.station_id where s.status = 'train') c
    on c.station_id = r.station_id group by r.station_id""",
    ["latitude", "longitude", "altitude"],
)
def station_summary(spark, sf_dir):
    raw = fx.raw_readings(spark, sf_dir)
    readings = raw.select(
        "station_id",
        tx.observation_time(F.col("data"), F.col("hour")).alias("ts"),
        F.col("lat").alias("latitude"),
        F.col("lon").alias("longitude"),
        F.col("alt").alias("altitude"),
    )
    nation = fx.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("station_id"), F.col("n_name").alias("city_name"))
    known = fx.stations(spark, sf_dir).where(F.col("status") == "train").select("station_id")
    return sf.station_summary(readings, nation.join(known, "station_id"))


@query(
    "d5_station_cities",
    """
    select station_id, array_to_string(list_transform(string_split(lower(city), ' '), lambda w: concat(upper(w[1]), w[2:])), ' ') as city_name
    from (select split_part(file_name, '_', 4) as station_id, split_part(min(file_name), '_', 5) as city from file_names
          group by split_part(file_name, '_', 4)) t""",
)
def station_cities(spark, sf_dir):
    return sf.cities(fx.file_names(spark, sf_dir))


@query(
    "h3_date_parts",
    """
    select l_orderkey, l_linenumber, l_partkey, cast(year(l_shipdate) as int) as year, cast(month(l_shipdate) as int) as month,
           cast(day(l_shipdate) as int) as day, cast(hour(l_shipdate) as int) as hour, cast(dayofyear(l_shipdate) as int) as doy from lineitem""",
)
def date_parts(spark, sf_dir):
    day = F.make_date(F.year("l_shipdate"), F.month("l_shipdate"), F.day("l_shipdate"))
    return fx.table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.year("l_shipdate").alias("year"),
        F.month("l_shipdate").alias("month"),
        F.day("l_shipdate").alias("day"),
        F.hour("l_shipdate").alias("hour"),
        F.dayofyear(day).alias("doy"),
    )


@query("h4_zoneless_time", "select event_id, date_trunc('second', ts) as ts from events")
def zoneless_time(spark, sf_dir):
    events = fx.table(spark, sf_dir, "events")
    written = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("+00:00"))
    return events.select("event_id", tx.zoneless_time(written).alias("ts"))


@query(
    "h5_flipped_dates",
    "select o_orderkey, strftime(o_orderdate, '%d/%m/%Y') as from_dashes, strftime(o_orderdate, '%d/%m/%Y') as from_slashes from orders",
)
def flipped_dates(spark, sf_dir):
    return fx.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        tx.flip_date(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("from_dashes"),
        tx.flip_date(F.date_format("o_orderdate", "yyyy/MM/dd")).alias("from_slashes"),
    )


@query(
    "h6_time_text_parts",
    """select station_id, pred, strftime(ts, '%Y') as year, strftime(ts, '%m') as month, strftime(ts, '%d') as day, strftime(ts, '%H') as hour
       from site_preds""",
    ["pred"],
    8,
)
def time_text_parts(spark, sf_dir):
    return tb.time_columns(fx.site_preds(spark, sf_dir).drop("real"))


@query(
    "h7_title_case",
    r"""
    select p_partkey, array_to_string(list_transform(regexp_extract_all(lower(p_name || '-' || p_type), '[a-z]+|[^a-z]+'), lambda w: concat(upper(w[1]), w[2:])), '') as title
    from part""",
)
def title_case(spark, sf_dir):
    joined = F.concat(F.col("p_name"), F.lit("-"), F.col("p_type"))
    return fx.table(spark, sf_dir, "part").select("p_partkey", tx.title_case(joined).alias("title"))


@query(
    "h8_decimal_comma",
    "select l_orderkey, l_linenumber, l_partkey, case when l_discount = 0 then null else l_discount end as number, l_extendedprice as price from lineitem",
    ["number", "price"],
)
def decimal_comma(spark, sf_dir):
    line = fx.table(spark, sf_dir, "lineitem")
    discount = F.when(F.col("l_discount") == 0, "--").otherwise(F.substring(F.format_string("%.2f", "l_discount"), 2, 9))
    price = F.concat(F.lit(" "), F.format_string("%.2f", "l_extendedprice"))
    comma = lambda c: F.replace(c, F.lit("."), F.lit(","))
    return line.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        tx.decimal_comma(comma(discount)).alias("number"),
        tx.decimal_comma(comma(price)).alias("price"),
    )


@query(
    "h9_error_terms",
    "select l_orderkey, l_linenumber, ts, abs(pred - real) as absolute, pow(pred - real, 2) as squared, sqrt(abs(pred - real)) as root from forecasts",
    ["absolute", "squared", "root"],
    7,
)
def error_terms(spark, sf_dir):
    miss = F.col("pred") - F.col("real")
    return fx.forecasts(spark, sf_dir).select(
        "l_orderkey",
        "l_linenumber",
        "ts",
        F.abs(miss).alias("absolute"),
        F.pow(miss, F.lit(2.0)).alias("squared"),
        F.sqrt(F.abs(miss)).alias("root"),
    )


@query(
    "h10_missing_values",
    """
    select station_id, ts, radiation is null as is_missing, nullif(temperature, pressure) as differing,
           coalesce(radiation, temperature, pressure, humidity, wind) as first_present from readings""",
    ["differing", "first_present"],
)
def missing_values(spark, sf_dir):
    # NaN marks a missing value on entry; it is turned into null once.
    readings = fx.readings(spark, sf_dir).withColumn("as_nan", F.coalesce("radiation", F.lit(float("nan"))))
    back = F.nullif(F.col("as_nan"), F.lit(float("nan")))
    return readings.select(
        "station_id",
        "ts",
        back.isNull().alias("is_missing"),
        F.nullif(F.col("temperature"), F.col("pressure")).alias("differing"),
        F.coalesce(back, "temperature", "pressure", "humidity", "wind").alias("first_present"),
    )


@query(
    "h13_first_valid_values",
    """
    with v as (select station_id, ts, list_filter([radiation, temperature, pressure, humidity, wind], lambda x: x is not null and x <> 0) as a from readings)
    select station_id, ts, coalesce(a[1], 0e0) as v1, coalesce(a[2], 0e0) as v2, coalesce(a[3], 0e0) as v3, coalesce(a[4], 0e0) as v4 from v""",
    ["v1", "v2", "v3", "v4"],
)
def first_valid_values(spark, sf_dir):
    valid = fx.readings(spark, sf_dir).select("station_id", "ts", first_valid(F.array(*fx.FEATURES)).alias("a"))
    return valid.select("station_id", "ts", *[F.get("a", F.lit(i)).alias(f"v{i + 1}") for i in range(4)])


@query(
    "h14_membership_and_ranges",
    "select l_orderkey, l_linenumber, ts, station_id from forecasts where year(ts) in (1995, 1996, 1998) and month(ts) between 3 and 10",
)
def membership_and_ranges(spark, sf_dir):
    chosen = F.year("ts").isin(1995, 1996, 1998) & F.month("ts").between(3, 10)
    return fx.forecasts(spark, sf_dir).where(chosen).select("l_orderkey", "l_linenumber", "ts", "station_id")


@query(
    "f1_sorted_by_time",
    "select station_id, ts, v, row_number() over (order by station_id, ts) as position from hourly",
    ["v"],
    8,
)
def sorted_by_time(spark, sf_dir):
    """A range-sorted table, and where each row stands in its files."""
    path = tb.write_table(fx.hourly(spark, sf_dir), scratch_path(spark, "by-time"), cluster_by=["station_id", "ts"])
    return tb.read_positions(spark, path)
