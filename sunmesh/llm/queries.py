"""The operators' registered queries, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sunmesh.llm import cross_entropy, decontamination, exact_index, grammar, jaccard_join, learned_partitions, lengths, merkle, mixing, prefix_trie, quality_kernel, toxicity, url_rules
from sunmesh.llm.common import table
from sunmesh.llm.labelled import fold
from sunmesh.session import scratch_path

#: Scores from here on are predicted as good.
GOOD = 0.7


def op1_token_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = grammar.write_grammar(table(spark, sf_dir, "documents"), scratch_path(spark, "grammar"))
    return grammar.read_digests(spark, path)


def op2_redirect_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"))


def op3_toxicity_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) != 0)
    scored = toxicity.score_toxicity(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_heavy_light_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op5_benchmark_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    hit = decontamination.n_hit(F.col("spans"))
    digest = F.sha2(F.encode(F.array_join(F.array_sort("items"), ","), "UTF-8"), 256)
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), digest.alias("items_sha256"), (hit > 0).alias("contaminated"))


def op6_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.length_histogram(table(spark, sf_dir, "documents"))


def op7_extendible_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_index.exact_groups(table(spark, sf_dir, "documents"))


def op8_kernel_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_kernel.fit(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 4) != 2)
    scored = quality_kernel.score_quality(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def op9_fair_queueing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").filter("quality = 1")
    return cross_entropy.score_documents(table(spark, sf_dir, "documents"), good)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = fold(F.col("doc_id"), 5) == 0
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return merkle.manifest(table(spark, sf_dir, "documents"), tampered={"text": F.when(hit, lowered).otherwise(F.col("text"))})


def op12_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = learned_partitions.build_index(table(spark, sf_dir, "embeddings"))
    return learned_partitions.search(index, F.col("vec_id") % 100 == 0)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.ordered_turns(table(spark, sf_dir, "conversations"))
    turns, convs = prefix_trie.branched(turns, fold(F.col("conv_id"), 9), F.col("conv_id") - F.col("conv_id") % 5)
    return prefix_trie.prefix_trie(turns, convs)


QUERIES = {f.__name__: f for f in (
    op1_token_grammar, op2_redirect_rules, op3_toxicity_trees, op4_heavy_light_join, op5_benchmark_automaton,
    op6_length_histogram, op7_extendible_index, op8_kernel_quality, op9_fair_queueing, op10_cross_entropy,
    op11_merkle_manifest, op12_learned_partitions, op13_prefix_trie,
)}

_HOST = "case when instr(url, '://') > 0 then translate(regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else '' end"
_PATH = "case when instr(url, '://') > 0 then regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) else '' end"
_FITS = "((host = '{0}' or ends_with(host, '.{0}')) and starts_with(path, '{1}'))"
_SPACE = r"[\x20\x09-\x0D]"

SQL = {
    # Valid where no page names a canonical or redirect target, as in the given tables; links are tested by hand.
    "op2_redirect_rules": f"""
        with parts as (select page_id, {_HOST} as host, {_PATH} as path, html from pages),
        ruled as (select *, case when {_FITS.format("example.net", "/en/")} then 'example.net/en/'
            when {_FITS.format("example.com", "/de/")} then 'example.com/de/'
            when {_FITS.format("org", "/fr/")} then 'org/fr/' when {_FITS.format("net", "/")} then 'net/' end as rule from parts)
        select page_id, host, path, rule, case when rule in ('example.com/de/', 'net/') then 'block' else 'allow' end as verdict from ruled""",
    "op7_extendible_index": f"""
        with t as (select doc_id, length(coalesce(text, '')) as n, sha256(regexp_replace(coalesce(text, ''), '{_SPACE}', '', 'g')) as text_sha256 from documents),
        g as (select text_sha256, count(*) as group_size, first(doc_id order by n desc, doc_id) as keep_id from t group by text_sha256)
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from t join g using (text_sha256)""",
    "op9_fair_queueing": r"""
        with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size, md5('mix:' || doc_id) as h from documents),
        s as (select source, sum(size)::bigint as source_size from d group by source),
        r as (select *, row_number() over (order by source is null, source) - 1 as rank from s),
        w as (select *, rank % 3 + 1 as weight, 3 * source_size as cap from r),
        l as (select *, (sum(source_size) over () - coalesce(sum(cap) over (order by cap / weight, rank rows between unbounded preceding and 1 preceding), 0))::double
            / sum(weight) over (order by cap / weight, rank rows between current row and unbounded following) as level from w),
        v as (select level from l where cap / weight >= level order by cap / weight, rank limit 1),
        t as (select source, rank, source_size, least(cap::double, v.level * weight) as target from w, v),
        q as (select doc_id, size, source_size, target, rank, turn,
            (sum(size) over (partition by d.source, turn order by h) + turn * source_size)::double / target as finish
            from d join t on d.source is not distinct from t.source, (select unnest([0, 1, 2]) as turn) p),
        c as (select *, sum(size) over (order by finish, rank, turn, doc_id rows unbounded preceding) as running from q)
        select doc_id, size, source_size, target, (sum(case when running <= (select sum(size) from d) then size else 0 end))::bigint as taken
        from c group by doc_id, size, source_size, target""",
}
