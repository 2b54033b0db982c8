"""Extremely randomised trees: forests whose cut points are drawn, not searched.

Each feature is offered in several copies, each on its own random grid of cut
points between the feature's bounds. A node looks at as many random columns as
it would look at features, so the cut points it sees are random too, and the
trees differ although each is grown on all rows. All trees are one job of the
engine's forest.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Copies of each feature, and the cut points of a copy.
COPIES, CUTS = 16, 7


class RandomCuts(Model, HasFeaturesCol, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the vector ``outputCol``: for every copy of every feature, how many of its cut points a value reaches."""

    outputCol = Param(Params._dummy(), "outputCol", "name of the column of cut features", TypeConverters.toString)
    starts = Param(Params._dummy(), "starts", "first cut point of each column", TypeConverters.toListFloat)
    steps = Param(Params._dummy(), "steps", "distance of each column's cut points; 0 if the feature is constant", TypeConverters.toListFloat)

    @classmethod
    def drawn(cls, low: np.ndarray, high: np.ndarray, seed: int, features: str, output: str) -> RandomCuts:
        """Grids of about ``CUTS`` points with random distance and offset between the features' bounds."""
        draw = np.random.default_rng(seed)
        step = np.repeat(high - low, COPIES) / CUTS * draw.uniform(0.6, 1.4, len(low) * COPIES)
        start = np.repeat(low, COPIES) + step * draw.uniform(0, 1, len(step))
        return cls()._set(featuresCol=features, outputCol=output, starts=start.tolist(), steps=step.tolist())

    def _transform(self, df: DataFrame) -> DataFrame:
        starts, steps = self.getOrDefault(self.starts), self.getOrDefault(self.steps)
        value = vector_to_array(F.col(self.getFeaturesCol()))
        reached = [F.floor((F.get(value, F.lit(i // COPIES)) - a) / s) + 1 if s else F.lit(0) for i, (a, s) in enumerate(zip(starts, steps))]
        bounded = [F.least(F.greatest(r, F.lit(0)), F.lit(2 * CUTS)).cast("double") for r in reached]
        return df.withColumn(self.getOrDefault(self.outputCol), array_to_vector(F.array(*bounded)))


class ExtraTreesRegressor(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed):
    """Parameters as the engine's forest has them; ``featureSubsetStrategy`` counts features, not copies.

    Rows must be complete. A constant feature is never cut. The fitted model is
    a pipeline of the drawn cut points and the forest.
    """

    numTrees = Param(Params._dummy(), "numTrees", "number of trees", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "greatest depth of a tree", TypeConverters.toInt)
    minInstancesPerNode = Param(Params._dummy(), "minInstancesPerNode", "fewest rows of a node", TypeConverters.toInt)
    featureSubsetStrategy = Param(Params._dummy(), "featureSubsetStrategy", "features that a node looks at: all, sqrt or onethird", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction", seed=7, numTrees=20, maxDepth=5, minInstancesPerNode=1, featureSubsetStrategy="all"):
        super().__init__()
        self._setDefault(numTrees=20, maxDepth=5, minInstancesPerNode=1, featureSubsetStrategy="all")
        self._set(**self._input_kwargs)

    def columns_looked_at(self, n_features: int) -> int:
        strategy = self.getOrDefault(self.featureSubsetStrategy)
        counts = {"all": n_features, "sqrt": math.ceil(math.sqrt(n_features)), "onethird": math.ceil(n_features / 3)}
        if strategy not in counts:
            raise ValueError(f"featureSubsetStrategy {strategy!r} is not one of {sorted(counts)}")
        return counts[strategy]

    def _fit(self, df: DataFrame) -> PipelineModel:
        features, seed = self.getFeaturesCol(), self.getOrDefault(self.seed)
        bounds = df.agg(Summarizer.min(F.col(features)).alias("low"), Summarizer.max(F.col(features)).alias("high")).first()
        low, high = bounds["low"].toArray(), bounds["high"].toArray()
        cuts = RandomCuts.drawn(low, high, seed, features, f"{features}_cut")
        share = self.columns_looked_at(len(low)) / (len(low) * COPIES)
        forest = RandomForestRegressor(
            featuresCol=f"{features}_cut", labelCol=self.getLabelCol(), predictionCol=self.getPredictionCol(), seed=seed, bootstrap=False,
            featureSubsetStrategy=f"{share:.6f}", **{n: self.getOrDefault(n) for n in ("numTrees", "maxDepth", "minInstancesPerNode")},
        )
        return PipelineModel([cuts, forest.fit(cuts.transform(df))])
