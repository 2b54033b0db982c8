"""Bounded samples of labelled documents, and isotonic calibration, for the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents that a classifier learns from; with more labels, a sample drawn by id.
SAMPLE_ROWS = 20_000
#: Tasks that hold the sample's statistics.
SAMPLE_PARTS = 8


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids have none."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, text, label`` of about ``rows`` labelled documents at most.

    ``usable`` says by ``doc_id`` which labels may be learnt from. Repeated
    labels count once, the larger value wins; null labels and ids are left out.
    The sample is drawn from the ids' hashes, so reruns agree. It is what is
    broadcast, so its bound is the broadcast's.
    """
    known = labels.filter(usable & F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    share = min(1.0, rows / max(1, known.count()))
    drawn = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    return docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")


def part(doc_id: Column) -> Column:
    """A number from 0 to 99 that deals the sample's documents to the steps of learning."""
    return F.pmod(F.xxhash64(doc_id, F.lit("part")), F.lit(100))


def calibrator(scored: DataFrame, score: str = "raw", label: str = "label") -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of the label on a score: bounds and values between which probabilities are interpolated."""
    rows = scored.select(F.col(label).cast("double").alias("label"), array_to_vector(F.array(F.col(score).cast("double"))).alias("features"))
    if rows.isEmpty():
        return np.array([0.0, 1.0]), np.array([0.0, 1.0])
    model = IsotonicRegression().fit(rows)
    return np.array(model.boundaries), np.clip(np.array(model.predictions), 0.0, 1.0)
