"""Registry of fitted models and their stored files."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.ml import PipelineModel
from pyspark.ml.base import Model
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sunmesh.operators.sizing import small_side

REGISTRY_SCHEMA = T.StructType(
    [
        T.StructField("dataset", T.StringType()),
        T.StructField("station_id", T.StringType()),
        T.StructField("algorithm", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("params", T.StringType()),
    ]
)

# Pattern of a model file name, and of a station directory.
MODEL_FILE_PATTERN = r"^sk_([A-Za-z]+)_(\d{4}-\d{2}-\d{2}-\d{2}-\d{2}-\d{2})\.dat$"
STATION_PATTERN = r"^[A-Z][0-9]{3}"


def model_file_name(model_class: Column, timestamp: Column) -> Column:
    return F.concat(F.lit("sk_"), model_class, F.lit("_"), timestamp, F.lit(".dat"))


def parse_model_file(file_name: Column) -> tuple[Column, Column]:
    """Model class and timestamp held by a model file name."""
    part = lambda i: F.nullif(F.regexp_extract(file_name, MODEL_FILE_PATTERN, i), F.lit(""))
    return part(1), part(2)


def save_model(model: Model, root: str, dataset: str, station_id: str, algorithm: str, timestamp: str, params: Mapping) -> dict:
    """Store a fitted pipeline model and return its registry row."""
    path = f"{root}/{dataset}/{station_id}/sk_{algorithm}_{timestamp}"
    PipelineModel([model]).write().save(path)
    return {
        "dataset": dataset,
        "station_id": station_id,
        "algorithm": algorithm,
        "timestamp": timestamp,
        "path": path,
        "params": json.dumps(dict(params), sort_keys=True),
    }


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def registry_table(spark: SparkSession, rows: list[dict]) -> DataFrame:
    return spark.createDataFrame([tuple(r[c] for c in REGISTRY_SCHEMA.names) for r in rows], REGISTRY_SCHEMA)


def latest(registry: DataFrame) -> DataFrame:
    return registry.agg(F.max("timestamp").alias("timestamp"))


def keep_to_checkpoint(registry: DataFrame, checkpoint: str, keep: str = "older") -> DataFrame:
    """Registry without the models newer than the checkpoint (``older`` kept) or the older ones (``newer`` kept)."""
    if keep not in ("older", "newer"):
        raise ValueError("keep must be 'older' or 'newer'")
    return registry.where(F.col("timestamp") <= checkpoint if keep == "older" else F.col("timestamp") > checkpoint)


def clear(registry: DataFrame, dataset: str) -> DataFrame:
    """Registry without any model of a data set."""
    return registry.where(F.col("dataset") != dataset)


def parse_params(text: Column) -> Column:
    """JSON parameter text to a map; ``nan`` counts as null."""
    return F.from_json(F.regexp_replace(text, r"\bNaN\b|\bnan\b", "null"), "map<string,string>")


def winners_only(rows: DataFrame, winners: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (predictions, registry entries) of the winning models: the signature is an equi-join key."""
    return rows.join(small_side(winners.select(*keys).distinct()), keys, "left_semi")


def parameter_report(winners: DataFrame, parameters: list[str], keys: Sequence[str] = ("station_id",)) -> DataFrame:
    """One row per winner and one column per named parameter."""
    parsed = winners.withColumn("__params", parse_params(F.col("params")))
    return parsed.select(*keys, "model", *[F.col("__params")[p].alias(p) for p in parameters])


def parameters_long(winners: DataFrame, keys: Sequence[str] = ("station_id",)) -> DataFrame:
    """``(*keys, model, name, value)`` when the parameter names are not known beforehand."""
    return winners.select(*keys, "model", F.explode(parse_params(F.col("params"))).alias("name", "value"))


def _folder(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


class RegistryConflict(RuntimeError):
    """Another writer has stored a version since the one that a change was based on."""


@dataclass(frozen=True)
class Version:
    """A committed registry: its number, from 0 on, and the folder of its rows."""

    number: int
    path: str

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path)


def latest_version(spark: SparkSession, root: str) -> Version | None:
    """The newest version below ``root``; rows of a writer that never committed are not seen."""
    files, folder = _folder(spark, f"{root}/registry/versions")
    if not files.exists(folder):
        return None
    numbers = [int(n) for n in (f.getPath().getName() for f in files.listStatus(folder)) if n.isdigit()]
    if not numbers:
        return None
    _, commit = _folder(spark, _commit_path(root, max(numbers)))
    stream = files.open(commit)
    try:
        name = bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
    return Version(max(numbers), f"{root}/registry/{name}")


def _commit_path(root: str, number: int) -> str:
    return f"{root}/registry/versions/{number:08d}"


def _commit(spark: SparkSession, root: str, name: str, number: int) -> bool:
    """Make the rows in folder ``name`` version ``number``, unless that number is taken.

    The commit file is written whole under a name of its own and then gets its
    number in one step that fails if the number exists: a hard link on a local
    file system, a rename without overwriting on all others. Two writers can't
    both succeed where that rename is atomic, as on HDFS.
    """
    files, written = _folder(spark, f"{root}/registry/versions/{name}.tmp")
    stream = files.create(written, False)
    try:
        stream.write(name.encode())
    finally:
        stream.close()
    jvm = spark._jvm
    _, target = _folder(spark, _commit_path(root, number))
    try:
        if files.getScheme() == "file":
            local = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
            jvm.java.nio.file.Files.createLink(local(target), local(written))
        else:
            no_option = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
            context.rename(written, target, no_option)
        return True
    except Py4JJavaError as error:
        if "FileAlreadyExistsException" not in error.java_exception.getClass().getName():
            raise
        return False
    finally:
        files.delete(written, False)


def store_registry(registry: DataFrame, root: str, based_on: int | None = None) -> Version:
    """Write the registry as the next version below ``root``; readers of the version before are not disturbed.

    The rows are written first and then committed under the next free number, so
    of two writers at once each gets a number of its own. ``based_on`` is the
    number of the version that ``registry`` was derived from (-1: none): if
    another one was committed since, nothing is stored and ``RegistryConflict``
    is raised.
    """
    spark = registry.sparkSession
    name = f"rows-{uuid.uuid4().hex}"
    path = f"{root}/registry/{name}"
    registry.write.mode("errorifexists").parquet(path)
    while True:
        number = based_on
        if number is None:
            newest = latest_version(spark, root)
            number = -1 if newest is None else newest.number
        if _commit(spark, root, name, number + 1):
            return Version(number + 1, path)
        if based_on is not None:
            files, folder = _folder(spark, path)
            files.delete(folder, True)
            raise RegistryConflict(f"version {number + 1} of the registry below {root} was stored by another writer")


def stored_registry(spark: SparkSession, root: str) -> DataFrame:
    """The newest version below ``root``."""
    newest = latest_version(spark, root)
    if newest is None:
        raise FileNotFoundError(f"no registry is stored below {root}")
    return newest.read(spark)


def update_registry(spark: SparkSession, root: str, change: Callable[[DataFrame], DataFrame], attempts: int = 10) -> Version:
    """Store ``change`` of the newest version; if another writer comes first, take its version and change that one.

    No version is lost: each is based on the one before. Without a stored
    registry ``change`` gets an empty one. After ``attempts`` conflicts the last
    one is raised.
    """
    for left in reversed(range(attempts)):
        newest = latest_version(spark, root)
        current = registry_table(spark, []) if newest is None else newest.read(spark)
        try:
            return store_registry(change(current), root, -1 if newest is None else newest.number)
        except RegistryConflict:
            if not left:
                raise
    raise ValueError("attempts must be at least 1")


def replace_registry(spark: SparkSession, root: str, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Store ``change`` of the newest registry and delete the model files that only the one before names.

    The registry is written first, so a failure leaves files without an entry,
    never an entry without files. Paths come to the driver one by one.
    """
    before = None

    def kept(current: DataFrame) -> DataFrame:
        nonlocal before
        before = current
        return change(current)

    after = update_registry(spark, root, kept).read(spark)
    gone = before.where(F.col("path").isNotNull()).join(after, "path", "left_anti").select("path").distinct()
    for row in gone.toLocalIterator():
        files, target = _folder(spark, row.path)
        files.delete(target, True)
    return after
