import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from sunmesh.llm import decontamination, encoding, grammar, lengths, shingles
from sunmesh.llm.encoding import WordEncoder, vocabulary_path
from sunmesh.session import scratch_path

TEXTS = [None, "", " \n", "Hello, world. It's don't!", "<|endoftext|> and <|ENDOFTEXT|>", "é É ſ İ Ǆ", "long " * 30000, "a.b.c ... x.,", "same text", "same text", "日本語 テキスト。", "x y z"]


@pytest.fixture(scope="module")
def encoder():
    return WordEncoder(vocabulary_path())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aAbz'.,!#_-@[{~  \n\t<|>séİſ́")), max_size=30), max_size=3))
def test_words_encode_like_texts(encoder, texts):
    ids, counts = encoder.encode(texts)
    whole = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert list(ids) == sum(whole, []) and list(counts) == list(map(len, whole))


def test_forgetting_changes_nothing():
    small = WordEncoder(vocabulary_path(), remembered=5)
    for _ in range(3):
        ids, _ = small.encode(TEXTS[:6])
        assert list(ids) == sum((small.tokenizer.encode(t or "", add_special_tokens=False).ids for t in TEXTS[:6]), [])


def test_a_stage_may_bound_the_known_words(monkeypatch):
    """The pipeline's last stage asks for fewer words than its workers may know elsewhere; ids are the same."""
    asked, write = [], grammar.write_grammar
    monkeypatch.setattr(grammar, "write_grammar", lambda *args, **kwargs: asked.append(kwargs) or "")
    monkeypatch.setattr(grammar, "read_digests", lambda *args: None)
    monkeypatch.setattr(corpus_pipeline, "scratch_path", lambda *args: "")
    corpus_pipeline.token_ids(None, None, "")
    assert asked[0]["remembered"] <= 400_000 < encoding.REMEMBERED and "remembered" in write.__code__.co_varnames
    texts = [[f"word{i} and{i} more{i}" for i in range(a, a + 50)] for a in range(0, 500, 50)]
    wide = [encoding.encoder().encode(t)[0].tolist() for t in texts]
    assert len(encoding.encoder().codes) >= 1500
    encoding.encoder()._forget()
    small = []
    for t in texts:
        worker = encoding.encoder(remembered=200)
        small.append(worker.encode(t)[0].tolist())
        assert len(worker.codes) <= 200 + 3 * len(t)
    assert small == wide and encoding.encoder().remembered == encoding.REMEMBERED


def test_what_is_held_is_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(encoding, "REMEMBERED_BYTES", 1000)
    small = WordEncoder(vocabulary_path())
    plain = lambda t: small.tokenizer.encode(t, add_special_tokens=False).ids
    for i in range(20):
        texts = [f"{'x' * 500}{i} word.", f"<|endoftext|> {'y' * 5000} {i}", "", None, f"a <| b {i}"]
        ids, counts = small.encode(texts)
        assert list(ids) == sum((plain(t or "") for t in texts), []) and list(counts) == [len(plain(t or "")) for t in texts]
    assert small.codes.held < 2000 and not any(b"<|" in w for w in small.codes)


@pytest.mark.parametrize("n_words", range(7))
@pytest.mark.parametrize("width", [4, 5])
def test_short_batches_of_shingles(n_words, width):
    sets, sizes = shingles.shingle_sets([" ".join(map(str, range(n_words)))], width)
    assert list(sizes) == [0 if not n_words else max(1, n_words - width + 1)] and len(sets) == sizes[0]
    together, own = shingles.shingle_sets(["a b c d e f g", " ".join(map(str, range(n_words))), "h i j k l"], width)
    assert own[1] == sizes[0] and together[own[0] : own[0] + own[1]].tolist() == sets.tolist()


@pytest.mark.parametrize("seed, n", [(0, 30_000), (1, 400_000)])
def test_no_frequent_pair_is_left(seed, n):
    rng = np.random.default_rng(seed)
    ids = (rng.zipf(1.3, n) % 3000).astype(np.uint32)
    ends = np.append(np.sort(rng.choice(np.arange(1, n), 300, replace=False)), n)
    found = grammar.repair(ids, ends)
    s = found["symbols"].astype(np.int64)
    inner = np.ones(len(s) - 1, bool)
    inner[found["symbol_ends"][:-1] - 1] = False
    _, counts = np.unique((s[:-1] << 32 | s[1:])[inner], return_counts=True)
    assert counts.max() < grammar.USES


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 6), min_size=1, max_size=200), min_size=1, max_size=20), st.integers(0, 3))
def test_repair_round_trip(docs, repeat):
    docs = docs * (repeat + 1)
    ids, ends = np.array(sum(docs, []), np.uint32), np.cumsum([len(d) for d in docs])
    found = grammar.repair(ids, ends)
    kinds = {"terminals": "<u4", "rules": "<u4", "lengths": "<u4", "symbols": "<u2", "symbol_ends": "<i8"}
    shard = grammar.Shard({k: found[k].astype(t).tobytes() for k, t in kinds.items()} | {"wide": found["wide"], "token_ends": ends.astype("<i8").tobytes(), "doc_ids": list(range(len(docs)))})
    assert list(shard.ids()) == list(ids)
    for i, doc in enumerate(docs):
        assert list(shard.document(i)) == doc and list(shard.document(i, 2, 9)) == doc[2:9] and list(shard.document(i, len(doc))) == []


def test_wide_symbols():
    rng = np.random.default_rng(0)
    # More symbols than 16 bits from the start, or only when rules are added; pairs that lie apart need a rule each.
    pairs = np.stack([np.arange(40_000), rng.permutation(40_000)], 1)
    many = np.concatenate([rng.permutation(pairs).ravel() for _ in range(8)])
    for ids, wide in ((np.concatenate([np.arange(70_000), np.tile(rng.integers(0, 70_000, 50), 40)]), True), (many, True), (many % 900, False)):
        ids = ids.astype(np.uint32)
        found = grammar.repair(ids, np.array([100, len(ids)]))
        assert found["wide"] == wide and len(found["rules"]) and len(found["symbols"]) < len(ids)
        kinds = {"terminals": "<u4", "rules": "<u4", "lengths": "<u4", "symbols": "<u4" if wide else "<u2", "symbol_ends": "<i8"}
        shard = grammar.Shard({k: found[k].astype(t).tobytes() for k, t in kinds.items()} | {"wide": wide, "token_ends": np.array([100, len(ids)], "<i8").tobytes(), "doc_ids": [0, 1]})
        assert np.array_equal(shard.ids(), ids) and np.array_equal(shard.document(1, 5, 50), ids[105:150])


def test_grammar_files(spark, encoder):
    rows = [(i * 3 - 5, t, "x") for i, t in enumerate(TEXTS)] + [(None, "no id", "y"), (1, "again", "z"), (1, "again", "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, part string").repartition(4)
    path = grammar.write_grammar(docs, scratch_path(spark, "grammar"), shard_ids=2000)
    expected, start = [], 0
    coded = [(d, encoder.tokenizer.encode(t or "", add_special_tokens=False).ids + [2]) for d, t, _ in rows]
    got = sorted((tuple(r) for r in grammar.read_digests(spark, path).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((d for d, _ in coded), key=lambda d: (d is not None, d or 0))
    for doc_id, at, n, crc in got:
        assert at == start
        start += n
        expected.append((doc_id, n, crc))
    assert sorted(expected, key=str) == sorted(((d, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, x in coded), key=str)
    assert [r["ids"] for r in grammar.read_ids(spark, path, 4).collect()] == [x for d, x in coded if d == 4]
    assert sorted(r["ids"] for r in grammar.read_ids(spark, path, 1, 1, 3).collect()) == sorted(x[1:3] for d, x in coded if d == 1)
    assert spark.read.parquet(path).select("part", "shard").distinct().count() == spark.read.parquet(path).count()
    empty = grammar.write_grammar(docs.limit(0), scratch_path(spark, "grammar"))
    assert grammar.read_digests(spark, empty).count() == 0


def test_length_histogram(spark, encoder):
    docs = spark.createDataFrame([(t, 1) for t in TEXTS], "text string, n_tokens int").repartition(3)
    sizes = [len(encoder.tokenizer.encode(t or "", add_special_tokens=False).ids) for t in TEXTS]
    histogram = lengths.length_histogram(docs)
    for r in histogram.collect():
        x = r["n_tokens"]
        assert (r["n_docs"], r["docs_at_least"], r["tokens_at_least"]) == (sizes.count(x), sum(s >= x for s in sizes), sum(s for s in sizes if s >= x))
        assert (r["docs_up_to"], r["tokens_up_to"], r["truncated_tokens"]) == (sum(s <= x for s in sizes), sum(s for s in sizes if s <= x), sum(min(s, x) for s in sizes))
    limits = [0, 1, 7, 10**6]
    for r, limit in zip(lengths.for_limits(histogram, limits).collect(), limits):
        assert tuple(r) == (limit, sum(s <= limit for s in sizes), sum(s for s in sizes if s <= limit), sum(min(s, limit) for s in sizes))
    assert lengths.at_quantile(histogram, 0.5).first()[0] == sorted(sizes)[(len(sizes) + 1) // 2 - 1]
    assert lengths.length_histogram(docs.limit(0)).count() == 0


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_contamination(text, items):
    own, hit, who = words(text), set(), set()
    for item, other in items:
        all_ = words(other)
        n = min(10, len(all_))
        for i in range(len(all_) - n + 1 if n else 0):
            for j in range(len(own) - n + 1):
                if own[j : j + n] == all_[i : i + n]:
                    hit.update(range(j, j + n))
                    who.add(str(item))
    return len(own), len(hit), len(who), hashlib.sha256(",".join(sorted(who)).encode()).hexdigest()


@pytest.mark.parametrize("slices", [1 << 20, 60])
def test_contamination(spark, slices):
    rng = random.Random(4)
    vocab = ["a", "Ab", "c1", "été", "ß", "x"]
    text = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", ", ", "\n", "--"]) for _ in range(n))
    items = [(i, text(rng.choice([0, 3, 9, 10, 12, 25]))) for i in range(12)] + [(3, "A ab C1"), (40, None), (41, "!!")]
    docs = [(i, text(rng.randrange(120)) + (items[rng.randrange(12)][1] if rng.random() < 0.6 else "") + text(5), "n", 7) for i in range(60)] + [(60, None, "n", 7), (61, "", "n", 7), (61, "", "n", 7)]
    frame = spark.createDataFrame(docs, "doc_id int, text string, items string, n_words int")
    plain = frame.toDF("doc_id", "text", "other", "number")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontamination.find_contamination(plain, bench, automaton_bytes=slices)
    for r in found.withColumn("n_hit", decontamination.n_hit(found["spans"])).collect():
        digest = hashlib.sha256(",".join(sorted(r["items"])).encode()).hexdigest()
        assert (r["n_words"], r["n_hit"], len(r["items"]), digest) == brute_contamination(r["text"], items)
        own = words(r["text"])
        for s in r["spans"]:
            assert words(r["text"][s["char_begin"] : s["char_end"]]) == own[s["word_begin"] : s["word_end"]]
    unnamed = spark.createDataFrame([(None, "x y z"), ("null", "a b c")], "item_id string, text string")
    found = decontamination.find_contamination(spark.createDataFrame([("x y z a b c",)], "text string"), unnamed, automaton_bytes=slices).first()
    assert sorted(found["items"], key=str) == [None, "null"]
    assert len(decontamination.find_contamination(frame, bench.limit(0)).columns) == 7
    assert decontamination.find_contamination(frame.limit(0), bench).count() == 0
    assert decontamination.find_contamination(plain, bench.limit(0)).filter("size(items) > 0").count() == 0
