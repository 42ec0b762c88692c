import hashlib
import random
from collections import Counter

import numpy as np

from runstore.llm import passages, suffixes
from runstore.llm._common import minimizers, sliding

DOCS = "doc_id long, text string, rid string, pos string"


def slow_kept(texts, n=200):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + n] for d in data for i in range(len(d) - n + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - n + 1):
            if seen[d[i : i + n]] > 1:
                gone[i : i + n] = True
        runs = int((gone[1:] < gone[:-1]).sum())
        kept = bytes(b for b, g in zip(d, gone, strict=False) if not g)
        out.append((len(d), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def test_sliding_and_minimizers():
    x = np.random.default_rng(1).integers(1, 9, 50).astype(np.uint64)
    assert sliding(x, 7, np.minimum, 99).tolist() == [x[i : i + 7].min() for i in range(44)]
    valid = np.ones(50, bool)
    valid[10:20] = False
    want = {}
    for i in range(44):
        for j in range(i, i + 7 if valid[i] else i):
            if x[j] == x[i : i + 7].min():
                want[j] = (want.get(j, (i, i))[0], i)
    got = minimizers(x, valid, 7)
    assert {p: (a, b) for p, a, b in zip(*(g.tolist() for g in got), strict=True)} == want


def test_suffix_order():
    rng = random.Random(1)
    for text in [b"banana", b"a", b"aaaaaaa", b"mississippi" * 3, bytes(rng.choices(b"ab", k=400)), bytes(rng.choices(range(256), k=500)), b"\0\0\1\0\0", b"abc" * 60]:
        t = np.frombuffer(text, np.uint8)
        got = suffixes.suffix_order(t, depth=600).tolist()
        assert got == sorted(range(len(text)), key=lambda i: text[i:])
        lcp = suffixes.common_prefixes(t, np.array(got), 16)
        assert all(x % 8 == 0 and (text[a : a + x] == text[b : b + x] or max(a, b) + x > len(text)) for x, a, b in zip(lcp[1:], got, got[1:], strict=False))


def texts(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé ", k=rng.randrange(1, 9)))
    body = lambda n: " ".join(word() for _ in range(n))
    passage = [body(80) for _ in range(6)]
    out = []
    for _ in range(60):
        x = [body(rng.randrange(5, 60))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passage)
            a = rng.randrange(150)
            x += [p[a : a + rng.randrange(100, 400)], body(rng.randrange(3, 40))]
        out.append(" ".join(x))
    out += [None, "", "short", "x" * 199, "y" * 200, "z" * 201, "q" * 900, out[3], out[3], out[5][:150], "ab" * 700, passage[0] + passage[0], "é" * 150 + "ab" * 120]
    return out


def test_without_repeats(spark, monkeypatch):
    for seed, most in ((1, 2048), (2, 3)):
        t = texts(seed)
        docs = spark.createDataFrame([(i, x, "", "") for i, x in enumerate(t)], DOCS).repartition(3)
        want = dict(enumerate(slow_kept(t)))
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.without_repeats(docs, most=most).collect()}
        assert {i: (got[i], want[i]) for i in want if got[i] != want[i]} == {}
    assert suffixes.without_repeats(docs.limit(0)).count() == 0
    long = max(t[:60], key=lambda x: len(x or ""))
    twice = spark.createDataFrame([(1, long, "", ""), (1, long, "", ""), (None, "w" * 30, "", "")], DOCS)
    assert sorted(r.n_removed for r in suffixes.without_repeats(twice).collect()) == [0] + [len(long.encode())] * 2


def test_long_texts_in_parts(spark):
    rng = random.Random(9)
    a = "".join(rng.choices("abcdefgh ", k=2_300_000))
    b = "".join(rng.choices("abcdefgh ", k=1000)) + a[1_048_000:1_049_600] + "!" + a[2_290_000:]
    docs = spark.createDataFrame([(1, a, "", ""), (2, b, "", "")], DOCS)
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffixes.without_repeats(docs).collect()}
    assert got == {1: (11600, 2), 2: (11600, 2)}


def test_chain_follows_the_best_path():
    # two collinear segments, one crossing, one far away
    got = passages.chain([0, 30, 32, 400], [20, 60, 40, 450], [100, 131, 0, 900], 0.1, 25)
    assert [0, 1] in got and [2] in got and [3] in got


def slow_chain_score(first, last, other, cost):
    n = len(first)
    end = [o + b - a for a, b, o in zip(first, last, other, strict=True)]
    score = {}
    for j in sorted(range(n), key=lambda j: first[j]):
        best = max([0.0] + [score[i] - cost * (first[j] - last[i] + other[j] - end[i]) for i in score if last[i] <= first[j] and end[i] <= other[j]])
        score[j] = last[j] - first[j] + best
    return max(score.values())


def test_chain_scores():
    rng = random.Random(2)
    for _ in range(60):
        n = rng.randrange(1, 14)
        first = [rng.randrange(100) for _ in range(n)]
        last = [f + rng.randrange(1, 15) for f in first]
        other = [rng.randrange(100) for _ in range(n)]
        paths = passages.chain(first, last, other, 0.1, 10**9)
        assert sorted(i for p in paths for i in p) == list(range(n))
        value = lambda p: sum(last[i] - first[i] for i in p) - 0.1 * sum(first[b] - last[a] + other[b] - (other[a] + last[a] - first[a]) for a, b in zip(p, p[1:], strict=False))
        assert abs(max(map(value, paths)) - slow_chain_score(first, last, other, 0.1)) < 1e-9


def test_shared_passages(spark):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(4000)]
    body = lambda n: rng.choices(vocabulary, k=n)
    passage = [body(70) for _ in range(4)]

    def edited(p):
        p = list(p)
        p[rng.randrange(10, 60)] = "changed"
        del p[rng.randrange(10, 60)]
        return p

    rows = {}
    for i in range(12):
        rows[i] = body(80) + edited(passage[i % 3]) + body(90)
    for i in range(12, 20):
        rows[i] = body(240)
    rows[20], rows[21] = body(50) + passage[3] + body(20) + passage[3], passage[3]
    data = [(i, " ".join(w), "", "") for i, w in rows.items()] + [(50, None, "", ""), (51, "", "", ""), (None, " ".join(rows[0]), "", ""), (7, " ".join(rows[7]), "", "")]
    docs = spark.createDataFrame(data, DOCS).repartition(4)
    out = passages.shared_passages(docs).collect()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
        assert r.similarity >= 0.8 and r.last_word - r.first_word >= 40
    assert set(by) == {*range(12), 20, 21, None}
    for i in range(12):
        assert any(r.first_word <= 84 and r.last_word >= 144 for r in by[i])
    assert {(r.first_word, r.last_word) for r in by[21]} | {(0, 70)} == {(0, 70)}
    assert passages.shared_passages(docs.limit(0)).count() == 0
