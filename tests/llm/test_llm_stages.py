"""Every stage of the pipeline against brute force, on rows with nulls, repeats, empty and long texts and columns that clash with what stages add."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm_jaccard import brute
from test_llm_text import brute_contamination

import corpus_pipeline
from sunmesh.llm import quality_kernel, toxicity
from sunmesh.llm.encoding import encoder
from sunmesh.llm.features import quality_statistics
from sunmesh.llm.labelled import fold

SF = "/root/testdata/sf0.001"
#: Names that stages add to their rows, or once did.
CLASHING = ["_n", "n", "id", "copies", "copy", "spans", "items", "n_words", "_score", "score", "size", "_x", "c0", "component_id", "taken"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` int" for c in CLASHING)


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, 3, *range(77, 77 + len(CLASHING))) for d, t, s in rows], SCHEMA).repartition(3)


def kept(docs):
    return sorted(((r["doc_id"], r["text"], r["source"]) for r in docs.collect()), key=str)


def check(spark, stage, rows, expected):
    docs = frame(spark, rows)
    found = stage(spark, docs, SF)
    assert found.columns == docs.columns and [f.dataType for f in found.schema] == [f.dataType for f in docs.schema]
    assert kept(found) == sorted(expected, key=str)
    assert found.select(CLASHING).distinct().collect() in ([], [tuple(range(77, 77 + len(CLASHING)))])
    assert stage(spark, docs.limit(0), SF).count() == 0


@pytest.fixture(scope="module")
def rows(spark):
    real = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60).collect()
    own = [(r["doc_id"], r["text"], r["source"]) for r in real]
    odd = [None, "", " \n\t", "a", "a b", "a b c", "Long word " * 20000]
    return own + own[:4] + [(i % 5 if i % 3 else None, t, [None, "", "src1"][i % 3]) for i, t in enumerate(odd * 2)]


def test_quality(spark, rows):
    model = quality_kernel.fit(frame(spark, rows), spark.read.parquet(f"{SF}/labels.parquet"), fold(F.col("doc_id"), 4) != 2)

    def score(text):
        x = np.clip((np.array(quality_statistics(text)) - model.mean) / model.scale, -8, 8)
        z = np.append(math.sqrt(2 / quality_kernel.FEATURES) * np.cos(x @ model.directions + model.phases), 1.0)
        return np.interp(z @ model.weights, model.bounds, model.values)

    check(spark, corpus_pipeline.quality, rows, [r for r in rows if score(r[1]) >= 0.7])


def test_near_duplicates(spark, rows):
    # Shared shingles of five words at 0.8 and above; the row of each group with the smallest id stays.
    rng = random.Random(2)
    base = [f"w{rng.randrange(500)}" for _ in range(200)]
    copies = [(200 + i, " ".join(base[: 200 - i] + [f"x{i}y{j}" for j in range(i)]), "s") for i in range(0, 60, 4)]
    all_ = rows + copies
    groups = brute([(i, t) for i, (_, t, _) in enumerate(all_)], corpus_pipeline.RULE)
    best = {}
    for i, size, component in groups:
        key = (all_[i][0] is None, all_[i][0] or 0, all_[i][1], all_[i][2] or "")
        if size:
            best[component] = min(best.get(component, key), key)
    docs = frame(spark, all_)
    found = kept(corpus_pipeline.near_duplicates(spark, docs, SF))
    wordless = [all_[i] for i, size, _ in groups if not size]
    assert len(found) == len(best) + len(wordless)
    ids = Counter(d for d, *_ in found)
    assert ids == Counter(k[1] if not k[0] else None for k in best.values()) + Counter(d for d, *_ in wordless)
    assert not Counter(found) - Counter(all_)
    assert corpus_pipeline.near_duplicates(spark, docs, SF).columns == docs.columns


def test_benchmark_clean(spark, rows):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = rows + [(900, f"before, {items[0][1].upper()} after", "s")]
    short = [r for r in rows if len(r[1] or "") < 20000]
    check(spark, corpus_pipeline.benchmark_clean, short, [r for r in short if not brute_contamination(r[1], items)[1]])


def test_mixture(spark, rows):
    sizes = [len((t or "").replace("\x0b", " ").split()) for _, t, _ in rows]
    names = sorted({s for *_, s in rows if s is not None}, key=str.encode) + [None]
    total = {n: sum(z for z, r in zip(sizes, rows) if r[2] == n) for n in names}
    weight, target, free, left = {n: i % 3 + 1 for i, n in enumerate(names)}, {}, set(names), float(sum(sizes))
    while free:
        level = left / sum(weight[n] for n in free)
        full = {n for n in free if 3 * total[n] < level * weight[n]}
        target |= {n: 3 * total[n] if n in full else level * weight[n] for n in full or free}
        left -= sum(target[n] for n in full)
        free = free - full if full else set()
    docs = frame(spark, rows)
    mixed = corpus_pipeline.mixture(spark, docs, SF)
    taken = Counter(kept(mixed))
    own = Counter(rows)
    assert mixed.columns == docs.columns and set(taken) <= set(own) and all(n <= 3 * own[r] for r, n in taken.items())
    assert all(taken[r] <= own[r] for r in own if not (r[1] or "").strip())
    largest = max(sizes)
    for n in names:
        words = sum(len((r[1] or "").split()) * m for r, m in taken.items() if r[2] == n)
        assert abs(words - target[n]) <= largest
    assert corpus_pipeline.mixture(spark, docs.limit(0), SF).count() == 0


def test_token_ids(spark, rows):
    found = corpus_pipeline.token_ids(spark, frame(spark, rows), SF).collect()
    coded = [(d, [*encoder().tokenizer.encode(t or "", add_special_tokens=False).ids, 2]) for d, t, _ in rows]
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found), key=str) == sorted(((d, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, x in coded), key=str)
    at = 0
    for r in sorted(found, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]


def test_normal_equations_and_calibration_against_numpy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_kernel.fit(docs, labels, F.lit(True))
    known = docs.join(labels.filter("quality is not null"), "doc_id").select("doc_id", "text", "quality", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(100)).alias("part")).collect()
    x = np.array([quality_statistics(r["text"]) for r in known])
    y, part = np.array([r["quality"] for r in known], float), np.array([r["part"] for r in known])
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.scale, np.maximum(x.std(axis=0), 1e-6))
    rng = np.random.default_rng(quality_kernel.SEED)
    directions = rng.normal(0, 1 / quality_kernel.WIDTH, (x.shape[1], quality_kernel.FEATURES))
    phases = rng.uniform(0, 2 * np.pi, quality_kernel.FEATURES)
    z = np.c_[math.sqrt(2 / quality_kernel.FEATURES) * np.cos(np.clip((x - model.mean) / model.scale, -8, 8) @ directions + phases), np.ones(len(x))]
    learn = part < 80
    a = z[learn].T @ z[learn] + quality_kernel.RIDGE * learn.sum() * np.eye(z.shape[1]) / z.shape[1]
    weights = np.linalg.solve(a, z[learn].T @ y[learn])
    assert np.allclose(z @ model.weights, z @ weights, atol=1e-6)
    # Pool adjacent violators on the rest, by hand.
    raw, truth = z[~learn] @ model.weights, y[~learn]
    pools = []
    for v in truth[np.argsort(raw)]:
        pools.append([v, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            (a, n), (b, m) = pools[-2:]
            pools[-2:] = [[(a * n + b * m) / (n + m), n + m]]
    assert np.allclose(np.interp(np.sort(raw), model.bounds, model.values), np.repeat([p for p, _ in pools], [n for _, n in pools]), atol=1e-6)


def test_many_calibration_bounds(spark):
    bounds, values = np.sort(np.random.default_rng(0).normal(size=3000)), np.linspace(0, 1, 3000)
    bounds[7] = bounds[8]
    x = np.r_[bounds[::97], np.random.default_rng(1).normal(size=200), -9.0, 9.0]
    found = spark.createDataFrame([(float(v),) for v in x], "x double").select(toxicity.interpolated(F.col("x"), bounds, values)).collect()
    assert np.allclose([r[0] for r in found], np.interp(x, bounds, values))
