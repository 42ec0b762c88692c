import random

import numpy as np
import xxhash

from runstore.llm import simhash

DOCS = "doc_id long, text string, fp string"


def slow_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fp, distance=4):
    label = list(range(len(fp)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fp)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fp))]


def test_fingerprint():
    for t in [None, "", " \t ", "One", "a B c", "a b c d", "É é\x85É x y", "the cat sat on the mat " * 9, "a\t\tb\x0bc\x0c\r\nd  e ", "\x1ca\x1db c d e", " lead and trail "]:
        assert simhash.fingerprint(t) == slow_fingerprint(t)


def test_a_long_text():
    words = [f"w{i % 977}" for i in range(400_000)]
    got = simhash.shingle_hashes(" ".join(words), 4)
    assert len(got) == len(words) - 3
    assert [int(got[i]) for i in (0, 65535, 65536, 399_996)] == [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in (0, 65535, 65536, 399_996)]


def test_spark_agrees_with_xxhash(spark):
    from pyspark.sql import functions as F

    got = spark.createDataFrame([("the cat sat é",)], "t string").select(F.xxhash64("t")).first()[0]
    assert got & (1 << 64) - 1 == xxhash.xxh64_intdigest("the cat sat é".encode(), 42)


def test_trie_forest_random():
    rng = random.Random(3)
    for size, flips in ((300, 3), (900, 9), (40, 1)):
        base = [rng.getrandbits(64) for _ in range(max(1, size // 12))]
        fp = set()
        while len(fp) < size:
            x = rng.choice(base)
            for _ in range(rng.randrange(flips + 1)):
                x ^= 1 << rng.randrange(64)
            fp.add(x)
            if flips == 1 and len(fp) >= 30:
                break
        fp = sorted(fp)
        got = simhash.trie_forest(np.array(fp, np.uint64), np.zeros(len(fp), np.int64), 4, most=64)
        assert got.tolist() == slow_components(fp)


def test_block_masks_leave_some_block_whole():
    masks = simhash.block_masks(4, 2)
    rng = random.Random(5)
    for _ in range(200):
        x = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(x & m == 0 for m in masks)


def test_near_duplicates(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(400)]
    rows = []
    for g in range(30):
        text = rng.choices(vocabulary, k=200)
        for _ in range(rng.choice([1, 2, 9])):
            own = list(text)
            own[rng.randrange(200)] = rng.choice(vocabulary)
            rows.append(" ".join(own))
    rows += ["", None, " ", "same", "same", "SAME"]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(100 + i, t, "x") for i, t in enumerate(rows)] + [(None, "same", "x"), (100, rows[0], "x")], DOCS)
    want = slow_components([slow_fingerprint(t) for t in rows])
    for tile in (4096, 3):
        out = simhash.near_duplicates(docs, tile=tile).collect()
        assert len(out) == len(rows) + 2
        for r in out:
            if r.doc_id is None:
                assert r.component_id is None and r.fingerprint == f"{slow_fingerprint('same'):016x}"
            else:
                assert r.fingerprint == f"{slow_fingerprint(rows[r.doc_id - 100]):016x}"
                assert r.component_id == 100 + want[r.doc_id - 100]
    assert simhash.near_duplicates(docs.filter("doc_id < 0")).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 99)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 99, 99: 99}
