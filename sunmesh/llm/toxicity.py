"""Toxicity: gradient-boosted trees over dense features of the text, with isotonic calibration."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunmesh.llm.common import bounded_batches
from sunmesh.llm.features import Lexicon, looks_disguised, plain_word, stems, undisguised
from sunmesh.llm.labelled import SAMPLE_PARTS, SAMPLE_ROWS, calibrator, labelled_sample, part
from sunmesh.sources.tables import materialise

#: Terms of the lexicon, the toxic documents that each was seen in, and its least log-odds.
TERMS, TERM_DOCUMENTS, TERM_ODDS = 4000, 4, 2.5
TREES, DEPTH, STEP, SEED = 20, 3, 0.3, 3
# Insults that the list begins with; what the labels show is added.
SEED_WORDS = ["idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown", "dumb", "idiota", "imbécil", "estúpido", "idiote", "crétin", "débile", "trottel", "abschaum", "dumm"]


@dataclass
class ToxicityModel:
    lexicon: dict[str, float]
    trees: GBTClassificationModel | None
    bounds: np.ndarray
    values: np.ndarray


def _terms(batches):
    for batch in batches:
        terms, labels = [], []
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
            own = set()
            for word in set((text or "").split()):
                spelt = undisguised(word) if looks_disguised(word) else plain_word(word)
                own.update((spelt, *stems(spelt)))
            own.discard("")
            terms += own
            labels += [label] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(labels, pa.int32())], names=["term", "label"])


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Words and beginnings that toxic documents of the sample (``text, label``) hold far oftener than others.

    A term's weight is the logarithm of the odds, smoothed by a half. The list
    is part of the model and has ``TERMS`` entries at most, best first.
    """
    toxic = F.sum("label")
    counts = sample.agg(F.coalesce(toxic, F.lit(0)).alias("t"), F.count("*").alias("n")).first()
    whole, clean = counts["t"], counts["n"] - counts["t"]
    found = sample.select("text", "label").mapInArrow(_terms, "term string, label int").groupBy("term").agg(toxic.alias("t"), F.count("*").alias("n"))
    odds = F.log((F.col("t") + 0.5) / (whole + 1)) - F.log((F.col("n") - F.col("t") + 0.5) / (clean + 1))
    good = found.filter(F.col("t") >= TERM_DOCUMENTS).withColumn("odds", odds).filter(F.col("odds") >= TERM_ODDS)
    best = good.orderBy((F.col("odds") * F.log1p("t")).desc(), "term").limit(TERMS).collect()
    return dict.fromkeys(SEED_WORDS, TERM_ODDS) | {r["term"]: r["odds"] for r in best}


_lexicons: dict[int, Lexicon] = {}


def _features(weights, text_at: int):
    """Append the features; the list's look-ups last as long as the worker."""

    def run(batches):
        key = hash(frozenset(weights.value.items()))
        if key not in _lexicons:
            _lexicons.clear()
            _lexicons[key] = Lexicon(weights.value)
        statistics = _lexicons[key].statistics
        for batch in batches:
            rows = [statistics(t) for t in batch.column(text_at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.list_(pa.float64()))], names=[f"c{i}" for i in range(batch.num_columns + 1)])

    return run


def _with_features(docs: DataFrame, weights: dict[str, float], text: str) -> DataFrame:
    names = docs.columns
    fields = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    return plain.mapInArrow(_features(sent, names.index(text)), f"{fields}, c{len(names)} array<double>").toDF(*names, "_x")


def _raw(scored: DataFrame, trees: GBTClassificationModel) -> DataFrame:
    """The trees' margin for toxic as ``_raw``."""
    model = trees.copy().setFeaturesCol("_features").setRawPredictionCol("_margin").setProbabilityCol("").setPredictionCol("")
    return model.transform(scored.withColumn("_features", array_to_vector("_x"))).withColumn("_raw", vector_to_array("_margin")[1])


def fit(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic", rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Learn from the labelled documents that ``usable`` admits, at most about ``rows`` of them.

    Half of them give the lexicon, others the trees, the rest the calibration,
    so that no step is judged on what the one before has learnt by heart. With
    labels of one kind only there are no trees, and every score is that kind's
    share.
    """
    bounded_batches(docs.sparkSession)
    sample = materialise(labelled_sample(docs, labels, label, usable, rows), "labelled")
    weights = learn_lexicon(sample.filter(part(F.col("doc_id")) < 50))
    rest = _with_features(sample.filter(part(F.col("doc_id")) >= 50), weights, "text").select("doc_id", F.col("label").cast("double").alias("label"), "_x")
    known = materialise(rest.coalesce(SAMPLE_PARTS), "features")
    learn = known.filter(part(F.col("doc_id")) < 85).select("label", array_to_vector("_x").alias("_features")).coalesce(SAMPLE_PARTS)
    kinds = [r["label"] for r in learn.select("label").distinct().collect()]
    if len(kinds) < 2:
        only = kinds[0] if kinds else 0.0
        return ToxicityModel(weights, None, np.array([0.0, 1.0]), np.array([only, only]))
    trees = GBTClassifier(featuresCol="_features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=SEED, maxBins=64).fit(learn)
    check = _raw(known.filter(part(F.col("doc_id")) >= 85), trees)
    return ToxicityModel(weights, trees, *calibrator(check, "_raw"))


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``score`` from 0 to 1, higher for likelier toxic.

    Features: density, number and peak weight of listed words and of listed
    beginnings, share of them near a second person, capitals, shouting,
    punctuation, signs, and disguised words. Null and empty texts have zeros
    for all of them and are scored by that; repeated rows have equal scores; no
    documents give no rows. Columns may have any names but ``_x``, ``_raw``,
    ``_features`` and ``_margin``.
    """
    bounded_batches(docs.sparkSession)
    names = docs.columns
    if model.trees is None:
        return docs.select("*", F.lit(float(model.values[0])).alias("score"))
    scored = _raw(_with_features(docs, model.lexicon, text), model.trees)
    return scored.select(*names, interpolated(F.col("_raw"), model.bounds, model.values).alias("score"))


def interpolated(x: Column, bounds: np.ndarray, values: np.ndarray) -> Column:
    """Linear between the bounds, constant outside: ``numpy.interp`` as an expression."""
    bounds, values = [float(b) for b in bounds], [float(v) for v in values]

    def between(low: int, high: int) -> Column:
        """For ``x`` from bound ``low`` to below bound ``high``: halves, so that the expression's depth is the logarithm of their number."""
        if high - low > 1:
            middle = (low + high) // 2
            return F.when(x < bounds[middle], between(low, middle)).otherwise(between(middle, high))
        a, b, va, vb = bounds[low], bounds[high], values[low], values[high]
        return F.lit(vb) if b <= a else F.lit(va) + (x - a) * ((vb - va) / (b - a))

    inside = between(0, len(bounds) - 1) if len(bounds) > 1 else F.lit(values[0])
    return F.when(x <= bounds[0], values[0]).when(x >= bounds[-1], values[-1]).otherwise(inside)
