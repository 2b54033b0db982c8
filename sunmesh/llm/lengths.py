"""Exact histogram of encoded document lengths, answering totals, quantiles and truncation for any context limit."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunmesh.llm.common import bounded_batches, running_totals
from sunmesh.llm.encoding import STEP, VOCABULARY, encoder
from sunmesh.sources.tables import materialise


def _counted(vocabulary: str):
    def run(batches):
        lengths = encoder(vocabulary).lengths
        for batch in batches:
            texts = batch.column(0)
            found = np.concatenate([np.zeros(0, np.int64), *(lengths(texts.slice(i, STEP)) for i in range(0, len(texts), STEP))])
            values, counts = np.unique(found, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(counts)], names=["n_tokens", "n_docs"])

    return run


def length_histogram(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per length that occurs, with what all context limits need to know.

    ``n_tokens``, ``n_docs``; ``docs_at_least`` and ``tokens_at_least`` are
    suffix sums over this and longer lengths; ``docs_up_to`` and
    ``tokens_up_to`` the prefix sums; ``truncated_tokens`` is what is left when
    every document is cut at ``n_tokens``; ``quantile`` the share of documents
    that are no longer. Null and empty texts have length 0. No documents give
    no rows. Only ``text`` is read.
    """
    bounded_batches(docs.sparkSession)
    counted = docs.select(F.col("text").cast("string")).mapInArrow(_counted(vocabulary), "n_tokens bigint, n_docs bigint")
    histogram = counted.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs")).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    histogram = materialise(histogram, "histogram")
    summed = running_totals(histogram, [-F.col("n_tokens")], ["n_docs", "tokens"])
    whole = histogram.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_docs", "tokens"))).first()
    all_docs, all_tokens = F.lit(whole["n_docs"]), F.lit(whole["tokens"])
    longer_docs, longer_tokens = F.col("n_docs_before"), F.col("tokens_before")
    up_to = all_docs - longer_docs
    return summed.select(
        "n_tokens",
        "n_docs",
        (longer_docs + F.col("n_docs")).alias("docs_at_least"),
        (longer_tokens + F.col("tokens")).alias("tokens_at_least"),
        up_to.alias("docs_up_to"),
        (all_tokens - longer_tokens).alias("tokens_up_to"),
        (all_tokens - longer_tokens + longer_docs * F.col("n_tokens")).alias("truncated_tokens"),
        (up_to / all_docs).alias("quantile"),
    )


def for_limits(histogram: DataFrame, limits: Sequence[int]) -> DataFrame:
    """Per context limit: documents and tokens that fit whole, and tokens left after cutting at the limit.

    A limit between two lengths has the answer of the next shorter length plus
    the limit's share of the longer documents. No histogram rows give zeros.
    """
    aggregates = []
    for i, limit in enumerate(limits):
        whole = F.when(F.col("n_tokens") <= limit, F.col("n_docs"))
        aggregates += [
            F.coalesce(F.sum(whole), F.lit(0)).alias(f"docs_{i}"),
            F.coalesce(F.sum(whole * F.col("n_tokens")), F.lit(0)).alias(f"tokens_{i}"),
            F.coalesce(F.sum(F.col("n_docs") * F.least("n_tokens", F.lit(limit))), F.lit(0)).alias(f"cut_{i}"),
        ]
    answer = F.array(
        *(
            F.struct(F.lit(int(x)).alias("context_limit"), F.col(f"docs_{i}").alias("docs_whole"), F.col(f"tokens_{i}").alias("tokens_whole"), F.col(f"cut_{i}").alias("truncated_tokens"))
            for i, x in enumerate(limits)
        )
    )
    return histogram.agg(*aggregates).select(F.inline(answer))


def at_quantile(histogram: DataFrame, share: float) -> DataFrame:
    """The smallest length that at least ``share`` of the documents don't exceed, as one row (null without documents)."""
    return histogram.filter(F.col("quantile") >= share).agg(F.min("n_tokens").alias("n_tokens"))
