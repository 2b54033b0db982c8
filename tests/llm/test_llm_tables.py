import dataclasses
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from compare import compare, connect
from sunmesh.llm import cross_entropy, exact_index, mixing, quality_kernel, toxicity, url_rules
from sunmesh.llm.encoding import encoder
from sunmesh.llm.features import Lexicon, quality_statistics
from sunmesh.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
WEIRD = [None, "", " \n\t", "a b", "a  b", "ab", "A b", "long " * 20000]


def documents(spark):
    rows = [(i, t, "en", s, 5, "x") for i, (t, s) in enumerate(zip(WEIRD * 2, ["b", None, "a", "b"] * 4))] + [(3, "a b", "en", "b", 5, "x"), (None, "z", None, None, None, "x")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score string").repartition(3)


@pytest.mark.parametrize("name", list(SQL))
def test_against_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), SQL[name], connect(SF)) is None


def test_exact_groups(spark):
    docs = documents(spark)
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    plain = [re.sub(r"[\x20\x09-\x0D]", "", t) for _, t in rows]
    sizes = Counter(plain)
    keep = {p: min((-len(t), d is None, d or 0) for (d, t), q in zip(rows, plain) if q == p) for p in sizes}
    expected = sorted(((d, keep[p][2], sizes[p], hashlib.sha256(p.encode()).hexdigest()) for (d, _), p in zip(rows, plain)), key=str)
    for bucket_keys in (1, 4096):
        found = exact_index.exact_groups(docs, bucket_keys).collect()
        assert sorted(((r["doc_id"], r["keep_id"] if r["keep_id"] is not None else 0, r["group_size"], r["text_sha256"]) for r in found), key=str) == expected
        assert sum(r["kept"] for r in found) == len(sizes)
    assert exact_index.exact_groups(docs.limit(0)).count() == 0


def test_directory_splits_full_buckets(spark):
    entries = spark.range(3000).select(F.xxhash64("id").alias("hash"))
    slots, depth = exact_index.directory(entries, 100)
    placed = entries.withColumn("slot", exact_index._slot(depth)).join(slots, "slot").groupBy("depth", "bucket").count()
    assert placed.agg(F.max("count")).first()[0] <= 100 and placed.agg(F.sum("count")).first()[0] == 3000 and depth >= 5


def test_rows_are_found_through_the_directory(spark):
    docs = documents(spark)
    entries = exact_index.hashed_rows(docs)
    index = exact_index.build_index(docs, entries, 1)
    assert index.depth >= 2 and index.buckets.groupBy("depth", "bucket").count().agg(F.max("count")).first()[0] == 1
    assert exact_index.look_up(entries, index).count() == docs.count()
    # A directory with a wrong bucket for every slot, or without some slots, loses rows.
    moved = index.slots.withColumn("bucket", F.col("bucket") + 1)
    one = index.slots.orderBy("slot").limit(1)
    assert exact_index.look_up(entries, dataclasses.replace(index, slots=moved)).count() == 0
    assert 0 < exact_index.look_up(entries, dataclasses.replace(index, slots=one)).count() < docs.count()


def test_mix(spark):
    docs = documents(spark)
    mixed = mixing.mix(docs).collect()
    assert len(mixed) == docs.count() and sum(r["taken"] for r in mixed) <= sum(r["size"] for r in mixed)
    assert all(r["taken"] == r["size"] * r["copies"] and r["copies"] <= 3 for r in mixed)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mix_with_a_source_of_empty_texts(spark):
    empty = [(1, None, "e"), (2, "", "e"), (3, " \n", "e")]
    docs = spark.createDataFrame([*empty, (4, "a b c", "f"), (5, "d e", None)], "doc_id bigint, text string, source string")
    found = {r["doc_id"]: (r["size"], r["source_size"], r["target"], r["copies"], r["taken"]) for r in mixing.mix(docs).collect()}
    assert len(found) == 5 and all(found[d] == (0, 0, 0.0, 1, 0) for d in (1, 2, 3)) and sum(f[4] for f in found.values()) > 0
    taken = corpus_pipeline.mixture(spark, docs, SF).filter("source = 'e'").collect()
    assert sorted(tuple(r) for r in taken) == empty
    assert mixing.mix(docs.filter("source = 'e'")).count() == 3


@pytest.mark.parametrize("seed", range(3))
def test_targets_against_repeated_sharing(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i:02}": rng.choice([0, 1, 10, 500, 9000]) for i in range(11)} | {None: 40}
    names = sorted((k for k in sizes if k), key=str.encode) + [None]
    weight = {n: i % 3 + 1 for i, n in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        level = left / sum(weight[n] for n in free)
        full = {n for n in free if 3 * sizes[n] < level * weight[n]}
        for n in full or free:
            target[n] = 3 * sizes[n] if full else level * weight[n]
        left -= sum(target[n] for n in full)
        free = free - full if full else set()
    found = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")).collect()
    assert {r["source"]: pytest.approx(r["target"], rel=1e-9, abs=1e-9) for r in found} == target


def test_urls_and_aliases(spark):
    link = lambda u: f'<head><LINK href="{u}" rel="canonical"></head>'
    rows = [
        (1, "http://a.com/1", link("https://b.net/x")), (2, "http://c.com/2?q", "<meta content='0; url=//A.com/1#f' http-equiv=refresh>"), (3, "http://x.EXAMPLE.net/en/7", link("/en/8")),
        (4, "https://x.example.net/en/8", ""), (5, "http://d.com/p", link("http://b.net/y")), (6, "http://e.com/p", "<link rel=canonical href='http://d.com/p'>"), (7, "http://e.com/p#top", link("http://example.net/en/q")),
        (8, None, None), (9, "no url", link("http://b.net/x")), (10, "http://net", ""), (11, "http://f.org/fr/", ""), (11, "http://f.org/fr/", ""), (12, "http://notnet/", ""), (13, "http://b.net:80/", None), (14, "http://www.example.com/de/a?b=/en/", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string")
    found = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.judge(pages).collect()}
    assert found == {
        1: ("a.com", "/1", None, "block"), 2: ("c.com", "/2", None, "block"), 3: ("x.example.net", "/en/7", "example.net/en/", "allow"), 4: ("x.example.net", "/en/8", "example.net/en/", "allow"),
        5: ("d.com", "/p", None, "allow"), 6: ("e.com", "/p", None, "allow"), 7: ("e.com", "/p", None, "allow"), 8: ("", "", None, "allow"), 9: ("", "", None, "allow"), 10: ("net", "", None, "allow"),
        11: ("f.org", "/fr/", "org/fr/", "allow"), 12: ("notnet", "/", None, "allow"), 13: ("b.net:80", "/", None, "allow"), 14: ("www.example.com", "/de/a", "example.com/de/", "block"),
    }
    assert url_rules.judge(pages).count() == len(rows) and url_rules.judge(pages.limit(0)).count() == 0


def test_all_links_of_a_page_and_relative_ones(spark):
    link = lambda u: f'<link rel="canonical" href="{u}">'
    moved = lambda u: f'<meta http-equiv="refresh" content="0; url={u}">'
    rows = [
        ("http://a.com/d/p", link("http://x.org/c") + moved("http://y.org/m"), ["http://x.org/c", "http://y.org/m"]),
        ("http://a.com/d/p?q", link("page2.html") + link("../x?u=http://z.org/"), ["http://a.com/d/page2.html", "http://a.com/x?u=http://z.org/"]),
        ("http://a.com/d/e/p#f", moved("?id=3") + moved("./..") + moved("../../../a/./b/"), ["http://a.com/d/e/p?id=3", "http://a.com/d/", "http://a.com/a/b/"]),
        ("https://a.com", link("i.html") + link("?x") + link("/s/../t?a&amp;b"), ["https://a.com/i.html", "https://a.com/?x", "https://a.com/t?a&b"]),
        ("http://a.com/q", link("#top") + link("") + link("mailto:a@b.net") + link("//c.com/r"), ["http://c.com/r"]),
    ]
    pages = spark.createDataFrame([(i, u, h) for i, (u, h, _) in enumerate(rows)], "page_id int, url string, html string")
    assert sorted(tuple(r) for r in url_rules.link_edges(pages).collect()) == sorted((u, to) for u, _, named in rows for to in named)
    # Aliases that are blocked only by such links.
    chains = [
        (1, "http://a.com/1", link("http://b.net/1") + moved("http://c.com/1")), (2, "http://a.com/d/2", link("3?x")), (3, "http://a.com/d/3?x", moved("http://b.net/3")),
        (4, "http://a.com/4", link("http://c.com/4") + link("http://b.net/4")), (5, "http://a.com/5", ""),
    ]
    judged = url_rules.judge(spark.createDataFrame(chains, "page_id int, url string, html string")).collect()
    assert {r["page_id"]: r["verdict"] for r in judged} == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow"}


@pytest.mark.parametrize("name, label, share", [("op8_kernel_quality", "quality", 0.9), ("op3_toxicity_trees", "toxic", 0.9)])
def test_held_out_accuracy(spark, name, label, share):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scored = QUERIES[name](spark, sf).join(labels, "doc_id").filter("held_out")
    counts = {(r["predicted"], r["y"]): r["count"] for r in scored.groupBy("predicted", F.col(label).alias("y")).count().collect()}
    for y in (0, 1):
        assert counts.get((y, y), 0) / max(1, sum(n for (_, t), n in counts.items() if t == y)) >= share


def test_classifiers_on_odd_rows(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(16)] + [(None, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int")
    for module, score in ((quality_kernel, quality_kernel.score_quality), (toxicity, toxicity.score_toxicity)):
        for known in (labels, labels.limit(0), labels.withColumns({"quality": F.lit(1), "toxic": F.lit(1)})):
            scored = score(docs.drop("score"), module.fit(docs, known, F.lit(True))).collect()
            assert len(scored) == docs.count() and all(0 <= r["score"] <= 1 for r in scored)
    assert len(quality_statistics(None)) == len(quality_statistics("Ä b\nc"))
    listed = Lexicon({"moron": 3.0, "lowe*": 1.0}).statistics("You M0RON! lowest m.o.r.o.n")
    assert listed[2] > 1 and listed[3] > 0 and listed[6] == 1.0


def test_cross_entropy(spark):
    rows = [(i, "the cat sat " * (i % 4), 1) for i in range(20)] + [(50 + i, "0 9 8 7 " * 3, 1) for i in range(20)] + [(90, None, 1), (None, "the", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score int").repartition(3)
    good = spark.createDataFrame([(i,) for i in range(20)] + [(1,), (None,)], "doc_id bigint")
    found = {r["doc_id"]: r for r in cross_entropy.score_documents(docs, good).collect()}
    assert len(found) == len(rows) and found[3]["score"] < 0 < found[55]["score"] and found[90]["n_tokens"] == 0
    none = cross_entropy.score_documents(docs, good.limit(0)).collect()
    assert all(r["score"] == 0 for r in none) and cross_entropy.score_documents(docs.limit(0), good).count() == 0


@pytest.mark.parametrize("order, sizes", [(1, {}), (2, {}), (3, {"block_symbols": 50, "slice_symbols": 700}), (3, {})])
def test_cross_entropy_counts_every_id(spark, order, sizes):
    """Against brute force, over many blocks and slices; documents that differ in rare ids alone differ in score."""
    common = "the of and to in is was for that"
    words = sorted(w for w in encoder().tokenizer.get_vocab() if re.fullmatch("[a-z]{4,}", w))[:1500]
    rows = [(i, f"{common} {w} {w}") for i, w in enumerate(words)] + [(7, None), (None, f"{common} {words[5]}"), (3, common)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    good = spark.createDataFrame([(i,) for i in range(0, 1500, 2)], "doc_id bigint")
    found = sorted(((r["doc_id"], r["n_tokens"], r["target_loss"], r["background_loss"]) for r in cross_entropy.score_documents(docs, good, order=order, **sizes).collect()), key=str)
    ids, n = encoder().encode([t for _, t in rows])
    assert len(set(ids.tolist())) > 1022
    lines = [[-1] * (order - 1) + [*own.tolist(), -1] for own in np.split(ids, np.cumsum(n)[:-1])]
    ends = [[tuple(a[: i + 1][-order:]) for i in range(order - 1, len(a))] for a in lines]
    good_lines = [g for g, (d, _) in zip(ends, rows) if d is not None and d < 1500 and d % 2 == 0]
    size = len(set(ids.tolist())) + 1
    mass = sum(map(len, good_lines))
    means = {}
    for name, used in (("target", good_lines), ("all", ends)):
        grams, contexts = Counter(), Counter()
        for line in used:
            for g in line:
                for k in range(1, order + 1):
                    grams[g[-k:]] += 1
                    contexts[k, g[-k:-1]] += 1
        scale = mass / sum(map(len, used))

        def chance(g):
            if len(g) == 1:
                return (grams[g] * scale + 1) / (mass + size)
            context = contexts[len(g), g[:-1]]
            return 0.8 * grams[g] / context + 0.2 * chance(g[1:]) if context else chance(g[1:])

        means[name] = [sum(-math.log2(chance(g)) for g in line) / len(line) for line in ends]
    means = list(zip(means["target"], means["all"]))
    expected = sorted(((d, int(m), *own) for (d, _), m, own in zip(rows, n, means)), key=str)
    assert [f[:2] for f in found] == [e[:2] for e in expected]
    assert np.allclose([f[2:] for f in found], [e[2:] for e in expected], rtol=1e-9)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF)
        docs = spark.createDataFrame(docs.toArrow())
        assert docs.count() > 0.5 * before.count()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == before.columns
            assert docs.join(before, [docs[c].eqNullSafe(before[c]) for c in ("doc_id", "text")], "left_anti").count() == 0
    ids = docs.orderBy("start").collect()
    assert [r["doc_id"] for r in ids] == sorted(r["doc_id"] for r in ids) and ids[0]["start"] == 0


def test_canonical_among_other_words_and_base_addresses(spark):
    rows = [
        ("http://a.com/x/p", '<link rel="alternate canonical" href="q">', ["http://a.com/x/q"]),
        ("http://a.com/x/p", "<link href='/q' rel='canonical alternate'>", ["http://a.com/q"]),
        ("http://a.com/x/p", '<link rel=canonical href=q><link href=r rel=canonical>', ["http://a.com/x/q", "http://a.com/x/r"]),
        ("http://a.com/x/p", '<link rel="canonical-not" href="q"><link data-rel="canonical" href="q"><link rel="not canonicals" href="q">', []),
        ("http://a.com/x/p", '<base href="http://b.com/y/z"><link rel="canonical" href="q">', ["http://b.com/y/q"]),
        ("http://a.com/x/p", '<link rel="canonical" href="q"><base target="_top" href="/w/">', ["http://a.com/w/q"]),
        ("http://a.com/x/p", '<base href="//c.com/"><meta http-equiv="refresh" content="0; url=?a=1&amp;b=2">', ["http://c.com/?a=1&b=2"]),
        ("http://a.com/x/p", '<base href=""><link rel="canonical" href="q">', ["http://a.com/x/q"]),
        ("http://a.com/x/p", '<base href="/v/"><link rel="canonical" href="http://d.com/">', ["http://d.com/"]),
    ]
    for url, html, named in rows:
        found = url_rules.link_edges(spark.createDataFrame([(url, html)], "url string, html string")).collect()
        assert sorted(r.to_url for r in found) == named and all(r.from_url == url for r in found), html
