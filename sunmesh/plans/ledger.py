"""A stored ledger of trials: searches that can be stopped, and go on where they were broken off."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from threading import Event, Timer

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "params string, error double, seconds double"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """``trial, params, error, seconds`` of all finished trials."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [f.getPath() for f in files.listStatus(target)] if files.exists(target) else []
    done = [p for p in done if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    if not done:
        return spark.createDataFrame([], f"trial int, {SCHEMA}")
    rows = spark.read.schema(SCHEMA).option("basePath", path).parquet(*[p.toString() for p in done])
    return rows.select(F.col("trial").cast("int").alias("trial"), "params", "error", "seconds")


def run_trials(
    spark: SparkSession,
    path: str,
    trials: Sequence[Mapping],
    evaluate: Callable[[Mapping], float],
    limit: float | None = None,
    parallelism: int = 4,
) -> DataFrame:
    """Evaluate each parameter set that the ledger at ``path`` lacks, and give the ledger.

    A trial's row is written when it is done, in a folder of its own, so a
    broken run loses only the trials under way. A trial of another parameter set
    under the same number is an error. After ``limit`` seconds no trial begins
    and the jobs of those under way are cancelled; without any finished trial
    the first one is run to its end.
    """
    names = [json.dumps(dict(t), sort_keys=True) for t in trials]
    known = {r.trial: r.params for r in read_ledger(spark, path).collect()}
    for number, params in known.items():
        if number >= len(names) or names[number] != params:
            raise ValueError(f"the ledger at {path} holds another search: trial {number} is {params}")
    context, over, group = spark.sparkContext, Event(), f"trials-{path}"

    def run(number: int) -> None:
        if over.is_set():
            return
        context.setJobGroup(f"{group}-{number}", f"trial {number}", True)
        begin = time.monotonic()
        try:
            error = float(evaluate(trials[number]))
        except Exception:
            if over.is_set():
                return
            raise
        row = spark.createDataFrame([(names[number], error, time.monotonic() - begin)], SCHEMA)
        row.coalesce(1).write.mode("overwrite").parquet(f"{path}/trial={number}")

    def stop() -> None:
        over.set()
        for number in open_:
            context.cancelJobGroup(f"{group}-{number}")

    open_ = [n for n in range(len(trials)) if n not in known]
    timer = Timer(limit, stop) if limit is not None else None
    if timer:
        timer.start()
    try:
        with ThreadPoolExecutor(parallelism) as pool:
            # The pool's threads are reused: each trial sets its own job group.
            list(pool.map(inheritable_thread_target(spark)(run), open_))
    finally:
        if timer:
            timer.cancel()
    if read_ledger(spark, path).isEmpty() and len(trials):
        over.clear()
        group = f"{group}-first"
        run(0)
        context.setLocalProperty("spark.jobGroup.id", None)
    return read_ledger(spark, path)


def best_trial(ledger: DataFrame, trials: Sequence[Mapping]) -> tuple[dict, float]:
    """Parameters and error of the trial with the smallest error; the earlier one of equal ones."""
    best = ledger.agg(F.min(F.struct("error", "trial")).alias("b")).first()["b"]
    return dict(trials[best["trial"]]), best["error"]
