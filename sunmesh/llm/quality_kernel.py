"""Quality classifier: ridge regression on random Fourier features of document statistics, calibrated."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunmesh.llm.common import bounded_batches
from sunmesh.llm.features import QUALITY, quality_statistics
from sunmesh.llm.labelled import SAMPLE_PARTS, SAMPLE_ROWS, calibrator, labelled_sample, part
from sunmesh.sources.tables import materialise

#: Random features, the Gaussian kernel's width in standard deviations per statistic, and the ridge.
FEATURES, WIDTH, RIDGE = 256, 3.0, 1e-3
SEED = 20


@dataclass
class KernelModel:
    """Everything that a score needs; a few hundred kB at most."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    bounds: np.ndarray
    values: np.ndarray

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """The random features, whose dot products approximate the kernel, and a constant."""
        z = np.cos(np.clip((x - self.mean) / self.scale, -8, 8) @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.concatenate([z, np.ones((len(x), 1))], 1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.lifted(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.bounds, self.values)


def _statistics(batches):
    for batch in batches:
        rows = [quality_statistics(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "label", "x"])


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _normal_equations(model: KernelModel):
    def run(batches):
        size = len(model.phases) + 1
        gram, right = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                z = model.lifted(_matrix(batch.column("x")))
                gram += z.T @ z
                right += z.T @ batch.column("label").to_numpy(zero_copy_only=False).astype(float)
        yield pa.RecordBatch.from_arrays([pa.array([gram.tobytes()], pa.binary()), pa.array([right.tobytes()], pa.binary())], names=["gram", "right"])

    return run


def _raw_scores(model: KernelModel):
    def run(batches):
        for batch in batches:
            raw = model.raw(_matrix(batch.column("x"))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(raw)], names=["label", "raw"])

    return run


def fit(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality", rows: int = SAMPLE_ROWS) -> KernelModel:
    """Learn from the labelled documents that ``usable`` admits, at most about ``rows`` of them.

    Four fifths of them give the normal equations, summed by partition; the
    rest calibrates. Without labels every score is the one of an untrained
    model, 0.
    """
    bounded_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, label, usable, rows)
    # Stored before its tasks are fewer: the scan of all documents runs in as many tasks as they have.
    known = materialise(sample.mapInArrow(_statistics, "doc_id bigint, label int, x array<double>"), "statistics").coalesce(SAMPLE_PARTS)
    moments = known.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("i").collect()
    count = len(QUALITY)
    mean, scale = (np.array([r["m"] for r in moments]), np.array([max(r["s"], 1e-6) for r in moments])) if moments else (np.zeros(count), np.ones(count))
    random = np.random.default_rng(SEED)
    model = KernelModel(mean, scale, random.normal(0, 1 / WIDTH, (count, FEATURES)), random.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + 1), np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    learn, check = known.filter(part(F.col("doc_id")) < 80), known.filter(part(F.col("doc_id")) >= 80)
    # The sample is bounded, and so are the sums that its tasks send.
    parts = learn.mapInArrow(_normal_equations(model), "gram binary, right binary").collect()
    size = FEATURES + 1
    gram = sum((np.frombuffer(bytes(p["gram"])).reshape(size, size) for p in parts), np.zeros((size, size)))
    right = sum((np.frombuffer(bytes(p["right"])) for p in parts), np.zeros(size))
    trained = gram[-1, -1]
    if trained:
        model.weights = np.linalg.solve(gram + RIDGE * trained * np.eye(size) / size, right)
        model.bounds, model.values = calibrator(check.mapInArrow(_raw_scores(model), "label int, raw double"))
    return model


def _scores(model, text_at: int):
    def run(batches):
        for batch in batches:
            x = np.array([quality_statistics(t) for t in batch.column(text_at).to_pylist()]).reshape(-1, len(QUALITY))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.value.score(x))], names=[f"c{i}" for i in range(batch.num_columns + 1)])

    return run


def score_quality(docs: DataFrame, model: KernelModel, text: str = "text") -> DataFrame:
    """All columns of ``docs``, whatever their names, and ``score`` from 0 to 1.

    Null and empty texts are scored by their statistics, which are all zero;
    repeated rows have equal scores; no documents give no rows.
    """
    bounded_batches(docs.sparkSession)
    names = docs.columns
    fields = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return plain.mapInArrow(_scores(sent, names.index(text)), f"{fields}, c{len(names)} double").toDF(*names, "score")
