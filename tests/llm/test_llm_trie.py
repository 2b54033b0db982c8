import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sunmesh.llm import prefix_trie as pt
from sunmesh.llm.queries import QUERIES

SCHEMA = "conv_id bigint, turn bigint, role string, text string, l string, p int, digest double"


def brute_force(rows):
    """Nodes of the rebuilt conversations, by plain dictionaries."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts, key=lambda t: (t[:2], hashlib.sha256(f"{len(t[2].encode())}:{t[2]}{t[3]}".encode()).hexdigest()[:32]))] for c, ts in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    return trie_of(built)


def trie_of(built):
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children, leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, cs in members.items():
        value = (len(cs) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += value
            leaves[node[:d]] += not children[node]
    found = []
    for node, cs in members.items():
        ends = ",".join(map(str, sorted(c for c in cs if len(built[c]) == len(node))))
        found.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), children[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(found, key=str)


def rebuilt_trie(conversations, **sizes):
    c = F.col("conv_id")
    turns, convs = pt.branched(pt.ordered_turns(conversations), F.crc32(F.encode(c.cast("string"), "UTF-8")) % 9, c - c % 5)
    return pt.prefix_trie(turns, convs, **sizes)


def check(spark, rows, **sizes):
    frame = spark.createDataFrame([(*r, "x", 1, 0.5) for r in rows], SCHEMA).repartition(4)
    assert sorted((tuple(r) for r in rebuilt_trie(frame, **sizes).collect()), key=str) == brute_force(rows)


@pytest.mark.parametrize("seed,block_keys", [(0, 3), (1, 20_000)])
def test_trie_against_brute_force(spark, seed, block_keys):
    # Few different turns, so that prefixes are shared deeply and across blocks; a third of all conversations are one.
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(10_000), 150) + list(range(20_000, 20_040)):
        same = rng.random() < 0.35
        for t in range(6 if same else rng.randint(1, 12)):
            rows.append((c, t, "user" if t % 2 == 0 else None, "same é" * t if same else rng.choice([None, "", "a", "bb", f"own {c}"])))
    rows += [(70_000, t, "user", f"long {t}") for t in range(250)] + [(70_001, t, "user", f"long {t}") for t in range(180)]
    check(spark, rows, block_keys=block_keys, piece_bits=4)


def test_order_nulls_and_few_rows(spark):
    rows = [(5, 2, "a", "x"), (5, None, None, None), (5, 1, "a", "ü"), (5, 1, "a", "ü"), (5, 1, "b", "ü"), (6, 3, "a", "x"), (None, 1, "a", "x"), (0, 0, "", ""), (12, 7, "u", "t"), (-4, 1, "u", "long" * 30000)]
    check(spark, [r for r in rows if r[0] is None or r[0] >= 0])
    check(spark, [(0, 0, "a", "b")])
    empty = spark.createDataFrame([], SCHEMA)
    assert rebuilt_trie(empty).count() == 0
    assert rebuilt_trie(spark.createDataFrame([(-4, 1, "u", "long" * 30000, "x", 1, 0.5)], SCHEMA)).count() >= 1


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in QUERIES["op13_prefix_trie"](spark, folder).collect()), key=str) == brute_force(rows)


def test_searches_of_the_sparse_table():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 17, 64):
        values = rng.integers(0, 5, n)
        table = pt._sparse(values)
        at, depth = np.repeat(np.arange(n), 6), np.tile(np.arange(6), n)
        assert pt._last_below(table, at, depth).tolist() == [max((j for j in range(a + 1) if values[j] < d), default=-1) for a, d in zip(at, depth)]
        assert pt._first_below(table, at + 1, depth).tolist() == [min((j for j in range(a + 1, n) if values[j] < d), default=n) for a, d in zip(at, depth)]
        begin, end = np.array([(b, e) for b in range(n) for e in range(b + 1, n + 1)]).T
        assert pt._least(table, begin, end).tolist() == [values[b:e].min() for b, e in zip(begin, end)]
