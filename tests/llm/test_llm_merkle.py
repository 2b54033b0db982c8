import hashlib
import random
import zlib

from pyspark.sql import functions as F

from sunmesh.llm import merkle

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, leaf int, tree string, key int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]))


def up(nodes):
    levels = [nodes]
    while len(nodes) > 1:
        nodes = [sha("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
        levels.append(nodes)
    return levels


def siblings_of(levels, place):
    found = []
    for level in levels[:-1]:
        run, at = divmod(place, 16)
        members = level[run * 16 : run * 16 + 16]
        found.append((members[:at], members[at + 1 :]))
        place = run
    return found


def brute_force(rows):
    groups = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {g: up([x for _, _, x in sorted((r[0] is not None, r[0] or 0, leaf(r)) for r in rows if r[1] == g)]) for g in groups}
    over = up([trees[g][-1][0] for g in groups])
    root, expected = over[-1][0], []
    for at, g in enumerate(groups):
        ordered = sorted((r for r in rows if r[1] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        for place, r in enumerate(ordered):
            sides = siblings_of(trees[g], place) + siblings_of(over, at)
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
            node = leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))) if bad else leaf(r)
            flat = [s for left, right in sides for s in left + right]
            for left, right in sides:
                node = sha("".join([*left, node, *right]))
            expected.append((r[0], leaf(r), trees[g][-1][0], root, sha("".join(flat)), node, flat, node == root))
    return sorted(expected, key=str)


def edited():
    hit = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0
    return {"text": F.when(hit, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))}


def check(spark, rows, **sizes):
    docs = spark.createDataFrame([(*r, 1, "x", None) for r in rows], SCHEMA).repartition(5)
    found = merkle.manifest(docs, tampered=edited(), with_siblings=True, **sizes)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "siblings", "verified"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute_force(rows)
    return docs


def test_manifest_against_brute_force(spark):
    # One source of a third of all rows and more than two levels, sources of 1, 16, 17 and 256 rows, and twenty lone ones.
    rng = random.Random(3)
    sizes = {"hot": 1200, None: 16, "": 17, "é": 256, "z": 1, **{f"s{i}": rng.randint(1, 5) for i in range(20)}}
    ids = iter(rng.sample(range(10**6), sum(sizes.values())))
    texts = [None, "", "abc", "ABC dé", "Lower\nUPPER", "Long " * 5000]
    rows = [(next(ids), s, rng.choice([None, "en"]), rng.choice([None, 3]), rng.choice(texts)) for s, n in sizes.items() for _ in range(n)]
    check(spark, rows)


def test_several_superblocks(spark):
    rows = [(i, "a" if i % 3 else f"b{i % 40}", "en", i, f"Text {i}") for i in range(1500)]
    check(spark, rows, block_levels=1)


def test_repeated_null_and_few_rows(spark):
    same = (7, "a", "en", 2, "Ab")
    docs = check(spark, [same] * 40 + [(None, None, None, None, None)] * 3 + [(7, "a", "en", 2, "other"), (None, "a", "de", 1, "")])
    assert merkle.manifest(docs.limit(0)).count() == 0
    check(spark, [(5, None, None, None, "Lone")])
    lone = merkle.manifest(spark.createDataFrame([(5, "s", None, 1, "x", 1, "x", None)], SCHEMA)).first()
    assert lone["leaf"] == lone["subroot"] == lone["root"] == lone["folded_root"] and lone["proof_sha256"] == sha("") and lone["verified"]
