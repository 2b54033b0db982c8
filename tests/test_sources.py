import datetime as dt
import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from sunmesh import schemas
from sunmesh.operators.sizing import small_side
from sunmesh.plans.preparation import Settings, clean, prepare
from sunmesh.plans.training import random_trials, spark_parameters
from sunmesh.session import scratch_path
from sunmesh.sources import registry as rg
from sunmesh.sources import station_files as sf
from sunmesh.sources import tables as tb

HEADER = ["REGIÃO:;SE", "UF:;SP", "ESTAÇÃO:;X", "CODIGO (WMO):;{id}", "LATITUDE:;{lat}", "LONGITUDE:;-46,620088", "ALTITUDE:;785,16", "DATA DE FUNDAÇÃO:;25/07/06"]


def _write(folder, name, station, lines, lat="-23,496294"):
    os.makedirs(folder, exist_ok=True)
    title = "Data;Hora UTC;" + ";".join(["título"] * 17) + ";"
    text = "\n".join([h.format(id=station, lat=lat) for h in HEADER] + [title, *lines]) + "\n"
    with open(os.path.join(folder, name), "w", encoding="latin-1") as file:
        file.write(text)


def _archive(root):
    first = ["2019/01/01;1000 UTC;,2;927,4" + ";" * 15 + ";"]
    second = ["2018-01-01;11:00;-9999;927,5" + ";" * 15 + ";", "2018-01-01;12:00;1,5;" + ";" * 15 + ";"]
    _write(f"{root}/2019", "INMET_SE_SP_A701_SAO-PAULO_01-01-2019_A_31-12-2019.CSV", "A701", first)
    _write(f"{root}/2018", "INMET_SE_SP_A701_SAO PAULO_01-01-2018_A_31-12-2018.csv", "A701", second)
    _write(f"{root}/2018", "INMET_S_PR_A850_CURITIBA_01-01-2018_A_31-12-2018.CSV", "A850", second, "-25,4")
    _write(f"{root}/2018", "INMET_S_PR_A807_OUTRA_01-01-2018_A_31-12-2018.CSV", "A807", second)
    _write(f"{root}/2018", "INMET_SE_SP_C891_OUTRA_01-01-2018_A_31-12-2018.CSV", "C891", second)
    _write(f"{root}/2018", "INMET_SE_SP_A999_NOTES_01-01-2018_A_31-12-2018.txt", "A999", second)


def test_station_files(spark, tmp_path):
    root = str(tmp_path / "some_dir_with_many_parts")
    _archive(root)
    rows = {(r.station_id, r.ts): r for r in sf.read_station_files(spark, root).collect()}
    assert set(rows) == {
        ("A701", dt.datetime(2019, 1, 1, 10)),
        ("A701", dt.datetime(2018, 1, 1, 11)),
        ("A701", dt.datetime(2018, 1, 1, 12)),
        ("A850", dt.datetime(2018, 1, 1, 11)),
        ("A850", dt.datetime(2018, 1, 1, 12)),
    }
    first = rows[("A701", dt.datetime(2019, 1, 1, 10))]
    assert (first.precipitacao_total, first.pressao_atmosferica, first.latitude, first.altitude) == (0.2, 927.4, -23.496294, 785.16)
    assert rows[("A701", dt.datetime(2018, 1, 1, 11))].precipitacao_total == -9999.0
    assert rows[("A701", dt.datetime(2018, 1, 1, 12))].pressao_atmosferica is None
    assert rows[("A850", dt.datetime(2018, 1, 1, 12))].latitude == -25.4
    assert sf.read_station_files(spark, root, select_files=False).select("station_id").distinct().count() == 4


def test_landed_files_give_the_same_rows(spark, tmp_path):
    root = str(tmp_path / "archive")
    _archive(root)
    landed = sf.land(spark, root, str(tmp_path / "landed"))
    direct = sf.read_station_files(spark, root, select_files=False)
    assert sorted(map(str, sf.observations(landed).collect())) == sorted(map(str, direct.collect()))
    keys = {(r.key, r.value) for r in sf.header_pairs(landed).where("file_name like '%2019.CSV'").collect()}
    assert ("DATA DE FUNDACAO", "25/07/06") in keys and ("LATITUDE", "-23.496294") in keys and ("REGIAO", "SE") in keys


def test_unselected_files_are_not_read(spark, tmp_path):
    root = str(tmp_path / "archive")
    _archive(root)

    def files_read(cells):
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        scan = cells._jdf.queryExecution().executedPlan().collectLeaves().head()
        scan.execute().count()
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        return scan.metrics().get("numFiles").get().value()

    cells = sf.scan(spark, root)
    assert files_read(cells) == 5
    assert files_read(cells.where(sf.selected(F.col("file_name")))) == 3
    assert files_read(cells.where(F.col("file_name").contains("A850"))) == 1


def test_cities_use_the_first_file_name(spark):
    names = [("INMET_SE_SP_A701_SAO-PAULO DO SUL_01-01-2019_A_31-12-2019.CSV",), ("INMET_SE_SP_A701_ALTO_01-01-2018_A_31-12-2018.CSV",)]
    assert sf.cities(spark.createDataFrame(names, "file_name string")).first().city_name == "Alto"


def test_tables_round_trip_and_cluster(spark, tmp_path):
    df = spark.createDataFrame([("b", 2, 1.5), ("a", 1, None)], "k string, i int, x double")
    assert sorted(map(tuple, tb.materialise(df, "t", ["k", "i"]).collect())) == [("a", 1, None), ("b", 2, 1.5)]
    path = tb.write_table(df, str(tmp_path / "p"), ["k"], ["i"])
    assert sorted(d for d in os.listdir(path) if d.startswith("k=")) == ["k=a", "k=b"]
    assert tb.import_csv(spark, tb.export_csv(df, str(tmp_path / "c")), df.schema).count() == 2
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def _readings(spark, stations=4, days=40):
    rows = []
    for s in range(stations):
        for year in (2018, 2020):
            for d in range(days):
                for hour in range(9, 23):
                    ts = dt.datetime(year, 3, 1, hour) + dt.timedelta(days=d)
                    base = 1000.0 + 100 * ((d * 7 + hour * 3 + s) % 11) + hour
                    values = [base if c == "radiacao_global" else 20.0 + (d * (i + 1) + hour * 5 + s) % 13 + i for i, c in enumerate(schemas.MEASUREMENTS)]
                    if d == 5 and hour == 12 and s == 0:
                        values[schemas.MEASUREMENTS.index("radiacao_global")] = 9000.0
                        values[schemas.MEASUREMENTS.index("temperatura")] = 5.0
                        values[schemas.MEASUREMENTS.index("vento_direcao")] = -9999.0
                    rows.append((f"A70{s}", ts, *values, -23.0 - 0.2 * s, -46.0, 700.0))
    return spark.createDataFrame(rows, schemas.READING_SCHEMA)


def test_cleaning_rules_meet_in_one_row(spark):
    cleaned = clean(_readings(spark, 2, 10))
    assert cleaned.agg(F.min(F.hour("ts")), F.max(F.hour("ts"))).first()[:] == (10, 21)
    bad = cleaned.where((F.col("station_id") == "A700") & (F.col("ts") == dt.datetime(2018, 3, 6, 12))).first()
    assert bad.radiacao_global is None and bad.temperatura is None and bad.vento_direcao is None
    before = cleaned.where((F.col("station_id") == "A700") & (F.col("ts") == dt.datetime(2018, 3, 6, 11))).first()
    assert before.rad_prox_hora is None
    evening = cleaned.where((F.col("station_id") == "A700") & (F.col("ts") == dt.datetime(2018, 3, 1, 21))).first()
    morning = cleaned.where((F.col("station_id") == "A700") & (F.col("ts") == dt.datetime(2018, 3, 2, 10))).first()
    assert evening.rad_prox_hora == morning.radiacao_global


@pytest.mark.parametrize("impute", ["none", "cascade", "single_pass"])
def test_preparation(spark, impute):
    ready = prepare(_readings(spark), Settings(impute=impute, min_rows=900, max_km=80.0))
    status = {r.station_id: r for r in ready.status.collect()}
    # 40 days x 12 hours in each split; the last row has no target unless it is carried or filled.
    assert {s: r.status for s, r in status.items()} == {f"A70{s}": "train" for s in range(4)}
    assert all(r.n_train == 480 or (impute == "none" and r.n_train >= 478) for r in status.values())
    scaled = ready.scaled
    assert scaled.columns[:3] == ["station_id", "ts", "split"] and "year" not in scaled.columns
    assert {"pca_pressao", "pca_umidade_1", "pca_umidade_2", "pca_temperatura", "pca_ponto_orvalho", "rad_prox_hora"} <= set(scaled.columns)
    assert "temperatura" not in scaled.columns
    median = scaled.where("split = 'train'").groupBy("station_id").agg(F.percentile("rad_prox_hora", 0.5).alias("m"))
    assert all(abs(r.m) < 1e-9 for r in median.collect())
    none_left = [F.count_if(F.col(c).isNull()).alias(c) for c in scaled.columns]
    assert sum(scaled.agg(*none_left).first()) == 0


def test_parameters_map_to_spark():
    assert spark_parameters("rf", {"n_estimators": "150", "max_features": "auto", "min_samples_split": 2, "max_depth": None}) == {
        "numTrees": 150,
        "featureSubsetStrategy": "all",
    }
    assert spark_parameters("xgb", {"eta": "0.3", "gamma": 0.05}) == {"stepSize": 0.3, "minInfoGain": 0.05}
    trials = random_trials({"a": (100, 1000, 100), "b": (0.0, 1.0, 0)}, 50, 3)
    assert trials == random_trials({"a": (100, 1000, 100), "b": (0.0, 1.0, 0)}, 50, 3)
    assert all(t["a"] % 100 == 0 and 100 <= t["a"] <= 1000 and 0 <= t["b"] <= 1 for t in trials)


def test_broadcasts_are_decided_on_rows_and_bytes(spark):
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    df = spark.range(1000).select("id", F.sha2(F.col("id").cast("string"), 512).alias("text"))
    assert hinted(small_side(df))
    assert not hinted(small_side(df, max_rows=999))
    assert not hinted(small_side(df, max_bytes=10_000))
    assert small_side(df, max_bytes=10_000).count() == small_side(df).count() == 1000
    assert small_side(df.limit(0)).count() == 0


def test_replaced_registry_deletes_the_files_of_dropped_models(spark, tmp_path):
    root = str(tmp_path / "store")
    rows = []
    for dataset, day in (("original", "01"), ("original", "02"), ("imputed", "01")):
        path = f"{root}/{dataset}/A701/sk_X_{day}"
        spark.range(1).write.parquet(path)
        rows.append({"dataset": dataset, "station_id": "A701", "algorithm": "X", "timestamp": day, "path": path, "params": "{}"})
    rows.append({**rows[0], "timestamp": "00", "path": None})
    with pytest.raises(FileNotFoundError):
        rg.stored_registry(spark, root)
    rg.store_registry(rg.registry_table(spark, rows), root)
    rg.replace_registry(spark, root, lambda stored: rg.keep_to_checkpoint(stored, "01"))
    assert [os.path.exists(r["path"]) for r in rows[:3]] == [True, False, True]
    kept = rg.replace_registry(spark, root, lambda stored: rg.clear(stored, "imputed"))
    assert [os.path.exists(r["path"]) for r in rows[:3]] == [True, False, False]
    assert sorted(r.timestamp for r in kept.collect()) == ["00", "01"]
    os.makedirs(f"{root}/registry/99999999")
    assert rg.stored_registry(spark, root).count() == 2


def test_positions_follow_the_stored_order(spark, tmp_path):
    df = spark.range(500).select((F.col("id") * 37 % 500).alias("x"))
    path = tb.write_table(df.repartition(5), str(tmp_path / "sorted"), cluster_by=["x"])
    assert all(r.position == r.x + 1 for r in tb.read_positions(spark, path).collect())
    empty = tb.write_table(df.where("x < 0"), str(tmp_path / "none"), cluster_by=["x"])
    assert tb.read_positions(spark, empty).count() == 0


def _entry(timestamp):
    return {"dataset": "original", "station_id": "A701", "algorithm": "X", "timestamp": timestamp, "path": None, "params": "{}"}


def test_a_change_of_an_outdated_registry_is_told(spark, tmp_path):
    root = str(tmp_path / "store")
    first = rg.store_registry(rg.registry_table(spark, [_entry("01")]), root, based_on=-1)
    assert first.number == 0
    rg.store_registry(rg.registry_table(spark, [_entry("02")]), root, based_on=0)
    with pytest.raises(rg.RegistryConflict):
        rg.store_registry(rg.registry_table(spark, [_entry("03")]), root, based_on=0)
    assert [r.timestamp for r in rg.stored_registry(spark, root).collect()] == ["02"]
    assert [r.timestamp for r in first.read(spark).collect()] == ["01"]
    # Rows of the writer that was told are gone; those of one that never committed are not seen.
    assert len([n for n in os.listdir(f"{root}/registry") if n.startswith("rows-")]) == 2
    rg.registry_table(spark, [_entry("04")]).write.parquet(f"{root}/registry/rows-lost")
    assert rg.latest_version(spark, root).number == 1
    assert rg.store_registry(rg.registry_table(spark, [_entry("05")]), root).number == 2


def test_writers_at_once_lose_nothing(spark, tmp_path):
    root = str(tmp_path / "store")
    plain = str(tmp_path / "plain")

    def add(i):
        rg.store_registry(rg.registry_table(spark, [_entry(f"{i:02d}")]), plain)
        return rg.update_registry(spark, root, lambda stored: stored.unionByName(rg.registry_table(spark, [_entry(f"{i:02d}")]))).number

    with ThreadPoolExecutor(5) as pool:
        assert sorted(pool.map(add, range(5))) == list(range(5))
    assert sorted(r.timestamp for r in rg.stored_registry(spark, root).collect()) == [f"{i:02d}" for i in range(5)]
    assert rg.latest_version(spark, plain).number == 4
    assert sorted(os.listdir(f"{root}/registry/versions"))[-1] == "00000004"


def test_commit_by_rename_does_not_overwrite(spark, tmp_path):
    """The way of all file systems but local ones, here through a local one."""
    root = str(tmp_path / "store")
    rg.store_registry(rg.registry_table(spark, [_entry("01")]), root)
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path
    context = jvm.org.apache.hadoop.fs.FileContext.getLocalFSFileContext()
    none = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    (tmp_path / "other").write_text("other")
    with pytest.raises(Py4JJavaError, match="FileAlreadyExistsException"):
        context.rename(path(str(tmp_path / "other")), path(f"{root}/registry/versions/00000000"), none)
    context.rename(path(str(tmp_path / "other")), path(f"{root}/registry/versions/00000001"), none)
    assert rg.latest_version(spark, root) == rg.Version(1, f"{root}/registry/other")
