"""The pipeline against a brute-force version of its decisions, on a small table."""

import re

from pyspark.sql import functions as F

import corpus_pipeline
from runstore.llm import decontam, langid, pii
from runstore.llm._common import words
from runstore.llm.mixing import quality_weights
from tests.llm.test_mixing import filled
from tests.llm.test_search import slow_align
from tests.llm.test_similar import slow_groups
from tests.llm.test_spans import base


def slow_leak(text, items):
    w = words([text])[0].tolist()
    grams = {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
    return any(any(tuple(x[i : i + 3]) in grams for i in range(len(x) - 2)) and slow_align(x, w) >= len(x) for x in items)


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = [words([r.text])[0].tolist() for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    texts = {r.doc_id: r.text for r in docs.collect()}
    net = langid.learned(docs, langid.third(docs.doc_id) != 1)
    score = langid.judged(net, list(texts.values()))[1]
    kept = [i for i, s in zip(texts, score, strict=True) if s >= corpus_pipeline.OVER_CHANCE / len(net.languages)]
    first = corpus_pipeline.identify(spark, docs, sf_dir)
    assert first.columns == docs.columns and sorted(r.doc_id for r in first.collect()) == sorted(kept)
    assert len(kept) >= 0.99 * len(texts)

    group = slow_groups([texts[i] for i in sorted(kept)])
    kept = [i for k, i in enumerate(sorted(kept)) if group[k] == k]
    second = corpus_pipeline.deduplicate(spark, first, sf_dir)
    assert second.columns == docs.columns and sorted(r.doc_id for r in second.collect()) == kept

    kept = [i for i in kept if not slow_leak(texts[i], bench)]
    third = corpus_pipeline.decontaminate(spark, second, sf_dir)
    assert third.columns == docs.columns and sorted(r.doc_id for r in third.collect()) == kept

    fourth = corpus_pipeline.redact(spark, third, sf_dir)
    assert fourth.columns == docs.columns
    rows = fourth.collect()
    assert sorted(r.doc_id for r in rows) == kept
    sizes, want, source = {}, {}, {}
    for r in rows:
        spans = [x.split(":") for x in base(texts[r.doc_id])]
        assert r.n_chars == len(r.text) and not base(r.text)
        assert sum(r.text.count(f"[{k.upper()}]") for k in pii.KINDS) >= (len(spans) > 0)
        if not spans:
            assert r.text == texts[r.doc_id]
        want[r.doc_id] = len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        sizes[r.source] = sizes.get(r.source, 0) + want[r.doc_id]
        source[r.doc_id] = r.source
    target = filled(sizes)
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id: r.size for r in out} == want and len(out) == len(kept)
    taken = {}
    for r in out:
        assert abs(r.target - target[r.source]) < 1e-6 and r.source_size == sizes[r.source] and r.taken == r.copies * r.size <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, t in target.items():
        assert abs(taken[s] - t) <= max(n for i, n in want.items() if source[i] == s) / 2 + 1e-6


def test_empty_and_odd_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = docs.limit(3).unionByName(docs.limit(1)).unionByName(spark.createDataFrame([(None, None, None, None, None), (5, "", None, "s", 0)], docs.schema))
    for table in (docs.limit(0), odd):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            table = stage(spark, table, sf_dir)
            assert table.columns == docs.columns, name
        assert corpus_pipeline.mix(spark, table, sf_dir).count() == table.count()
    assert quality_weights(spark.read.parquet(f"{sf_dir}/labels.parquet")).count() > 0


def test_further_columns_and_long_texts(spark, sf_dir):
    """Columns whose names the stages use themselves come out untouched; a text of two million characters passes through."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(40)
    long = docs.limit(1).withColumn("text", F.concat(F.repeat("text", F.ceil(2_000_000 / F.greatest(F.lit(1), F.length("text"))).cast("int")), F.lit(" a@b.com"))).withColumn("doc_id", F.lit(10**9))
    docs = docs.join(docs.limit(1), "doc_id", "left_anti").unionByName(long)  # the text itself would be a near-duplicate
    extra = docs.select("*", *[F.lit(f"own {c}").alias(c) for c in ("rid", "sig", "row", "spans", "base", "text_", "tie", "copies", "n", "words")])
    table = extra
    for name, stage in corpus_pipeline.STAGES[:-1]:
        table = stage(spark, table, sf_dir)
        assert table.columns == extra.columns, name
    rows = table.collect()
    assert rows and all(r[c] == f"own {c}" for r in rows for c in ("rid", "sig", "row", "spans", "base", "text_", "tie", "copies", "n", "words"))
    (r,) = [r for r in rows if r.doc_id == 10**9]
    assert r.text.endswith(" [EMAIL]") and r.n_chars == len(r.text)
    assert corpus_pipeline.mix(spark, table, sf_dir).count() == len(rows)


def test_clean_in_blocks(spark, sf_dir):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    bad = {r.doc_id for r in decontam.leaks(docs, bench).collect()}
    got = {r.doc_id for r in decontam.clean(docs, bench, block_bytes=2000).collect()}
    assert got == {r.doc_id for r in docs.collect()} - bad
