import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sunmesh.llm import jaccard_join
from sunmesh.llm.components import connected_components
from sunmesh.llm.jaccard_join import Rule, boundary, similar_components

SCHEMA = "doc_id bigint, text string, class string, key int"


def sets_of(rows, width):
    found = []
    for doc_id, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        found.append({tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} if words else set())
    return found


def brute(rows, rule):
    sets, parent = sets_of(rows, rule.width), list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= rule.percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, row in enumerate(rows):
        if row[0] is not None:
            least[root(i)] = min(least.get(root(i), row[0]), row[0])
    return sorted(((r[0], len(sets[i]), least.get(root(i))) for i, r in enumerate(rows)), key=str)


def collected(spark, rows, rule=Rule()):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(5)
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in similar_components(df, rule).collect()), key=str)


def corpus(seed, n=260):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    passage = " ".join(rng.choice(vocab) for _ in range(70))
    bases = [[rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 5, 8, 10, 14, 20, 26, 40, 90, 150]))] for _ in range(25)]
    rows = []
    for i in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            at = rng.randrange(len(words) + 1)
            words[at : at + rng.choice([0, 1])] = [rng.choice(vocab)] * rng.choice([0, 1])
        text = rng.choice([" ", "\n", "\t "]).join(words)
        if rng.random() < 0.2:
            text += " " + passage
        rows.append((i, text.upper() if rng.random() < 0.1 else text))
    return rows


@pytest.mark.parametrize("seed", [0])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    assert collected(spark, rows) == brute(rows, Rule())


@pytest.mark.parametrize("light", [0, 14])
def test_every_boundary_gives_the_same(spark, monkeypatch, light):
    monkeypatch.setattr(jaccard_join, "boundary", lambda *_: light)
    rows = corpus(7, 160)
    assert collected(spark, rows) == brute(rows, Rule())


def test_crowds_around_the_threshold(spark):
    """Copies of two related texts with one to six changes: many share rare shingles, some link only by a shared change."""
    rng = random.Random(5)
    words = [f"v{i}" for i in range(120)]
    other = words[:30] + [f"u{i}" for i in range(8)] + words[38:]
    rows = []
    for i in range(240):
        text = list(words if i % 3 else other)
        for _ in range(rng.choice([1, 2, 3, 3, 4, 5, 6])):
            text[rng.randrange(0, len(text), 3)] = rng.choice(["p", "q", f"own{i}"])
        rows.append((i, " ".join(text)))
    assert collected(spark, rows) == brute(rows, Rule())


def test_other_rule_and_frequent_shingles(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "FREQUENT", 3)
    monkeypatch.setattr(jaccard_join, "FREQUENT_CELLS", 40)
    rows, rule = corpus(11), Rule(80, 5)
    assert collected(spark, rows, rule) == brute(rows, rule)


def test_edge_cases(spark):
    rows = [(5, None), (6, ""), (7, " \n"), (8, "One"), (3, "one"), (3, "one"), (None, "one"), (9, "a b c"), (10, "A B\tC"), (None, None), (11, "a b"), (12, "x " * 30000), (13, "x " * 20000)]
    assert collected(spark, rows) == brute(rows, Rule())
    assert collected(spark, []) == []


def test_boundary_follows_the_cost():
    import numpy as np

    sizes = np.zeros(jaccard_join.LARGEST_LIGHT + 2, np.int64)
    sizes[7:12] = 1000
    assert boundary(sizes, 0.0, Rule()) < boundary(sizes, 1.0, Rule())


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(50)] + [(5000 + rng.randrange(80), 5000 + rng.randrange(80)) for _ in range(90)] + [(7, 7), (None, 3), (4, None)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    assert {r["node"]: r["component"] for r in connected_components(df).collect()} == {x: root(x) for x in list(parent)}
    assert connected_components(df.filter(F.lit(False))).count() == 0


def stage(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    return sorted((tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()), key=str)


def test_pipeline_stage_drops_copies_from_080_on(spark):
    base = lambda k: [f"w{k}x{i}" for i in range(100)]
    rows = []
    for k, added in enumerate([0, 5, 18, 20, 24, 25, 40]):
        rows += [(2 * k, " ".join(base(k))), (2 * k + 1, " ".join(base(k) + [f"n{k}x{i}" for i in range(added)]))]
    expected = sorted(({d: t for d, t in rows}[d], d) for d, _, least in brute(rows, Rule(80, 5)) if d == least)
    narrow = sum(d == least for d, _, least in brute(rows, Rule()))
    assert len(expected) < narrow
    assert sorted((t, d) for d, t in stage(spark, rows)) == expected


def test_pipeline_stage_goes_by_rows(spark):
    """Repeated ids with different texts, repeated rows and null ids: only near copies leave."""
    text = lambda k, more="": " ".join(f"w{k}x{i}" for i in range(60)) + more
    rows = [
        (1, text(1)), (2, text(1, " a")), (2, text(2)), (3, text(3)), (3, text(4)), (4, text(5)), (4, text(5)),
        (None, text(6)), (None, text(6)), (None, text(3, " b")), (None, text(7)), (5, ""), (5, None), (None, " "),
    ]
    kept = [rows[i] for i in (0, 2, 3, 4, 5, 7, 10, 11, 12, 13)]
    assert stage(spark, rows) == sorted(kept, key=str)


def test_ranks_tell_shared_shingles_at_any_size(spark):
    """Cells grow with the input's bytes, and each block's ranks are those of counts over all blocks."""
    import numpy as np
    import pyarrow as pa
    from sunmesh.llm.shingles import shingle_sets

    rng, rule = random.Random(3), Rule()
    texts = [" ".join(f"w{min(rng.randrange(9) for _ in range(3))}" for _ in range(rng.randrange(80))) for _ in range(90)]
    rows = [(i % 7, text, 1 << 30) for i, text in enumerate(texts)]
    blocks = spark.createDataFrame(rows, "block bigint, text string, bytes bigint")
    order = jaccard_join.count_shingles(blocks, rule)
    assert 2**order.cell_bits >= 8 * 90 * 2**30
    counted = {}
    for b in range(7):
        sets = [tuple(shingle_sets([text], rule.width)[0].tolist()) for block, text, _ in rows if block == b]
        for s in set(sets):
            for shingle in s:
                counted[shingle] = counted.get(shingle, 0) + 1
    assert min(counted.values()) == 1 and max(counted.values()) >= jaccard_join.FREQUENT
    answers = order.answers.toArrow()
    for b in range(7):
        own = shingle_sets([text for block, text, _ in rows if block == b], rule.width)[0]
        ranks = jaccard_join._ranks(own, order.cell_bits, answers.filter(pa.array([x == b for x in answers.column("block").to_pylist()])))
        n = np.array([counted[x] for x in own.tolist()])
        assert (ranks == np.where(n >= jaccard_join.FREQUENT, np.floor(np.log2(n / jaccard_join.FREQUENT)) + 2, n > 1)).all()
    assert order.shared == pytest.approx(sum(n for n in counted.values() if n > 1) / sum(counted.values()))


def stored_bytes(spark):
    from pathlib import Path

    from sunmesh.session import shared_folder

    return sum(p.stat().st_size for p in Path(shared_folder(spark).removeprefix("file://")).rglob("*.parquet"))


def test_steps_leave_the_disk(spark):
    """Of all that is stored only the result stays, and texts are passed block by block without being moved."""
    rows = [(i, " ".join(f"a{i}b{j}" for j in range(400))) for i in range(60)]
    df = spark.createDataFrame([(*r, "x", 1) for r in [*rows, (99, rows[3][1] + " more")]], SCHEMA)
    before, setting = stored_bytes(spark), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    found = similar_components(df)
    assert stored_bytes(spark) - before < 20_000 < sum(len(text) for _, text in rows) / 8
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == {**{i: i for i, _ in rows}, 99: 3}
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == setting
    blocks = jaccard_join.in_blocks(df.select("doc_id", "text"), "text")
    plan = blocks.groupBy("block").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and blocks.count() == 61


def test_pipeline_stage_stores_rows_once(spark):
    """Rows are stored once and the result is small beside them; columns of any type come back as they were."""
    rng = random.Random(8)
    texts = {i: " ".join(f"{rng.randrange(10**9)}" for _ in range(500)) for i in range(40)}
    ids = spark.createDataFrame([*texts.items(), (50, texts[4] + " more")], "id bigint, text string")
    odd = ["named_struct('a', id, 'b', array(id)) as s", "timestamp_seconds(id) as ts", "cast(id as decimal(20, 3)) as dec", "map('k', id) as m", "encode('x', 'UTF-8') as block", "cast(null as string) as bytes", "id % 2 = 0 as n"]
    docs = ids.selectExpr("id as doc_id", "text", *odd).repartition(3)
    before = stored_bytes(spark)
    stayed = corpus_pipeline.near_duplicates(spark, docs, "")
    assert stored_bytes(spark) - before < 1.3 * sum(map(len, texts.values()))
    assert stayed.schema.simpleString() == docs.schema.simpleString()
    key = lambda r: r["doc_id"]
    assert sorted(stayed.collect(), key=key) == sorted(docs.filter("doc_id <> 50").collect(), key=key)
