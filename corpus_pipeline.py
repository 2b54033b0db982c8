"""A training-data pipeline: filter, deduplicate, decontaminate, mix, encode.

``run`` applies the stages to ``documents``; each stage's rows are written as
Parquet in the shared folder and read back as the next one's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sunmesh.llm import decontamination, grammar, jaccard_join, mixing, quality_kernel
from sunmesh.llm.common import table
from sunmesh.llm.labelled import fold
from sunmesh.llm.queries import GOOD
from sunmesh.session import scratch_path
from sunmesh.sources.tables import materialise

#: When two documents are near copies here; op4's query has the rule of its contract.
RULE = jaccard_join.Rule(percent=80, width=5)

#: Words that a worker knows while it encodes: fewer than in op1 alone, as the stages before leave an executor's JVM at its full size.
REMEMBERED = 400_000


def _placed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its columns named by place, and these names: columns that a stage adds then clash with none."""
    places = {name: f"c{i}" for i, name in enumerate(docs.columns)}
    return docs.toDF(*places.values()), places


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    model = quality_kernel.fit(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 4) != 2)
    placed, c = _placed(docs)
    scored = quality_kernel.score_quality(placed, model, c["text"])
    return scored.filter(F.col("score") >= GOOD).drop("score").toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, by shingles of five words and a similarity of 0.8: the one with the smallest id.

    Rows are told apart by number, so those that repeat an id or have none are
    documents like others; of a group's rows with the same id the first stays,
    and one without id only if all are. Documents without words have no copies
    and all stay.
    """
    placed, c = _placed(docs)
    numbered = jaccard_join.in_blocks(placed.withColumn("n", F.monotonically_increasing_id()), c["text"])
    rows = numbered.select(F.col("n").alias("doc_id"), F.col(c["text"]).cast("string").alias("text"), "block", "bytes")
    groups = jaccard_join.similar_in_blocks(rows, RULE).select(F.col("doc_id").alias("n"), "n_shingles", "component_id")
    worded = groups.filter("n_shingles > 0").join(numbered.select("n", F.col(c["doc_id"]).alias("id")), "n")
    first = worded.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "n"))["n"].alias("n"))
    stay = first.select("n").union(groups.filter("n_shingles = 0").select("n"))
    return numbered.join(stay, "n", "left_semi").select(*placed.columns).toDF(*docs.columns)


def benchmark_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    placed, c = _placed(docs)
    found = decontamination.find_contamination(placed, table(spark, sf_dir, "benchmark"), c["text"])
    return found.filter(F.size("spans") == 0).select(*placed.columns).toDF(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    placed, c = _placed(docs)
    numbered = materialise(placed.withColumn("n", F.monotonically_increasing_id()), "numbered")
    known = numbered.select("n", *(F.col(c[name]).alias(name) for name in ("doc_id", "source", "text")))
    copies = mixing.mix(known, row="n").filter("copies > 0").select("n", "copies")
    repeated = numbered.join(copies, "n").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return repeated.select(*placed.columns).toDF(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in grammar shards, and what is read back from them."""
    return grammar.read_digests(spark, grammar.write_grammar(docs, scratch_path(spark, "grammar"), remembered=REMEMBERED))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_clean),
    ("mixing sources to target weights", mixture),
    ("token-ID / binary output", token_ids),
]

#: Classifier and tokenizer are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-").replace("/", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
