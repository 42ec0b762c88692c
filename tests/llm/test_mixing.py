from collections import Counter

import math
import random

import pytest
from pyspark.sql import functions as F

from runstore.llm import mixing

DOCS = "doc_id long, text string, source string, weight int, tie string"


def filled(sizes, weights=(1, 2, 3), most=3):
    """Targets by resharing the excess until none is above its ceiling."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, full, left = dict.fromkeys(names, 0.0), set(), float(sum(sizes.values()))
    while left > 1e-9 and len(full) < len(names):
        open_ = [s for s in names if s not in full]
        total = sum(w[s] for s in open_)
        for s in open_:
            target[s] += left * w[s] / total
        left = 0
        for s in open_:
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                full.add(s)
    return target


def test_targets_and_budgets(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randrange(40)), rng.choice(["a"] * 30 + ["b", "é", "z", None]), 1, "x") for i in range(3000)]
    rows += [(None, "x y", "b", 1, "x"), (7, None, "a", 1, "x"), (8, "p q", "a", 1, "x"), (8, "p q", "a", 1, "x")]
    out = mixing.mix_sources(spark.createDataFrame(rows, DOCS), buckets=16).collect()
    assert len(out) == len(rows)
    sizes, taken, largest = {}, {}, {}
    for r in out:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        largest[r.source] = max(largest.get(r.source, 0), r.size)
        assert r.taken in {0, r.size, 2 * r.size, 3 * r.size}
    want = filled(sizes)
    for r in out:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6
    again = mixing.mix_sources(spark.createDataFrame(rows[::-1], DOCS).repartition(5), buckets=64)
    assert sorted(map(str, again.collect())) == sorted(map(str, out))


def test_weights_prefer_good_documents(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"), F.when(F.col("id") < 3000, "s").otherwise("t").alias("source"))
    quality = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, 4.0).otherwise(0.25).alias("weight"))
    out = mixing.mix_sources(docs, weights=(1, 2), quality=quality).filter("source = 's' and copies > 0").groupBy((F.col("doc_id") % 2).alias("odd")).count().collect()
    n = {r.odd: r["count"] for r in out}
    assert n[0] > 1.5 * n[1]


def test_empty_and_blank(spark):
    assert mixing.mix_sources(spark.createDataFrame([], DOCS)).count() == 0
    out = mixing.mix_sources(spark.createDataFrame([(1, "", "a", 1, ""), (2, None, None, 1, "")], DOCS)).collect()
    assert [(r.size, r.target, r.taken) for r in out] == [(0, 0.0, 0)] * 2
    one = mixing.mix_sources(spark.createDataFrame([(1, "x " * 50_000, "a", 1, "")], DOCS)).first()
    assert (one.size, one.target, one.taken) == (50_000, 50_000.0, 50_000)


def test_materialised(spark):
    docs = spark.createDataFrame([(i, "w " * (i + 1), "ab"[i % 2]) for i in range(20)], "doc_id long, text string, source string")
    plan = mixing.mix_sources(docs)
    n = {r.doc_id: r.copies for r in plan.collect()}
    got = mixing.materialised(docs, plan).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in got} == {k: v for k, v in n.items() if v}
    assert math.isclose(sum(n.values()), sum(r["count"] for r in got))


def test_materialised_rows(spark):
    """Each row as often as it is taken, untouched: clashing columns, null ids, and equal rows with unlike copies."""
    rows = [(1, "a b c", "x", 5, "t1"), (1, "a b c", "x", 6, "t2"), (1, "d e", "x", 7, "t3"), (None, "f g", "x", 8, "t4"), (None, "f g", "y", 9, "t5"), (3, None, "y", 0, "t6"), (4, "h " * 5, "z", 1, "t7")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies long, tie string")
    plan = mixing.mix_sources(docs)
    out = mixing.materialised(docs, plan)
    assert out.columns == docs.columns
    got = Counter(tuple(r) for r in out.collect())
    assert set(got) <= set(rows)
    taken = Counter()
    for r in plan.collect():
        taken[r.doc_id, r.tie] += r.copies
    have = Counter()
    for r, n in got.items():
        have[r[0], r[1]] += n
    text = {(r.doc_id, r.tie): r.text for r in docs.selectExpr("doc_id", "xxhash64(text) tie", "text").collect()}
    assert have == Counter({(k[0], text[k]): n for k, n in taken.items() if n})
    assert mixing.materialised(docs.limit(0), plan).count() == 0
