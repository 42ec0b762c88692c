"""Links by similarity against all pairs by brute force."""

import random
import re

import numpy as np

import corpus_pipeline
from runstore.llm import similar
from runstore.llm.simhash import shingle_hashes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def slow_groups(texts, least=0.8):
    """Least index of each component over pairs with that Jaccard similarity."""
    sets = [set(shingle_hashes(t, 5).tolist()) for t in texts]
    label = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if label[i] != label[j] and (len(a & sets[j]) >= least * len(a | sets[j])):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


def texts():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(3000)]
    line = rng.choices(vocabulary, k=30)
    out = []
    for size in (1, 2, 7, 60):
        for _ in range(4):
            base = rng.choices(vocabulary, k=rng.randrange(60, 200))
            for _ in range(size):
                own = list(base)
                for _ in range(rng.randrange(5)):
                    own[rng.randrange(len(own))] = rng.choice(vocabulary)
                out.append(" ".join(own))
    out += [" ".join(line + rng.choices(vocabulary, k=40)) for _ in range(60)]
    out += ["", None, " ", "same", "SAME", out[0], out[1].upper()]
    rng.shuffle(out)
    return out


def test_groups_against_all_pairs(spark):
    t = texts()
    docs = spark.createDataFrame([(i, x, "en", "s", 0) for i, x in enumerate(t)] + [(None, t[0], "en", "s", 0)], DOCS).repartition(3)
    docs = docs.unionByName(docs.filter("doc_id = 3")).withColumn("rid", docs.lang)
    want = dict(enumerate(slow_groups(t)))
    assert len(set(want.values())) < len(t) - 60
    assert {r.doc_id: r.component_id for r in similar.groups(docs, tile=8).collect()} == want
    kept = sorted(r.doc_id for r in corpus_pipeline.deduplicate(spark, docs, "").filter("doc_id is not null").collect())
    assert kept == sorted(set(want.values()))
    assert similar.groups(docs.limit(0)).count() == 0


def test_rows_that_share_an_id_keep_their_texts(spark):
    t = texts()[:2]
    rows = [(7, t[0], "en", "a", 1), (7, t[1], "en", "b", 2), (8, t[1], "en", "c", 3), (None, t[0], "en", "d", 4), (None, t[0], "en", "d", 4)]
    out = similar.one_of_each(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r.doc_id or 0, r.text, r.source) for r in out) == sorted([(0, t[0], "d"), (0, t[0], "d"), (7, t[0], "a"), (7, t[1], "b")])


def test_recall_near_the_limit(spark):
    """Pairs at 0.8 to 0.9: those that brute force links, and no others."""
    rng = random.Random(21)
    vocabulary = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(3000)]
    t = []
    for _ in range(400):
        base = rng.choices(vocabulary, k=rng.randrange(40, 300))
        at = sorted(rng.sample(range(len(base)), max(1, len(base) // rng.randrange(40, 60))))
        t += [" ".join(base), " ".join(rng.choice(vocabulary) if i in at else w for i, w in enumerate(base))]
    want = slow_groups(t)
    linked = [i for i in range(1, len(t), 2) if want[i] == i - 1]
    got = {r.doc_id: r.component_id for r in similar.groups(spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")).collect()}
    assert len(linked) > 150
    assert all(got[i] in (i, want[i]) for i in got)
    assert sum(got[i] == want[i] for i in linked) >= 0.99 * len(linked)


def test_many_texts_just_below_the_limit(spark):
    """Edited copies of a text that is not there: no pair is a link, a few are, and no task emits its pairs."""
    rng = random.Random(31)
    vocabulary = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(3000)]
    base = rng.choices(vocabulary, k=150)
    t = []
    for _ in range(150):
        own = list(base)
        for i in rng.sample(range(150), rng.randrange(2, 5)):
            own[i] = rng.choice(vocabulary)
        t.append(" ".join(own))
    want = slow_groups(t)
    got = {r.doc_id: r.component_id for r in similar.groups(spark.createDataFrame(list(enumerate(t)), "doc_id long, text string"), tile=40).collect()}
    assert 1 < len(set(want)) < len(t) and got == dict(enumerate(want))


def test_trie_pairs_against_all_pairs():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, (2, 20), np.uint64)
    fp = np.concatenate([base] * 9, axis=1)
    for _ in range(25):
        fp[rng.integers(0, 2, fp.shape[1]), np.arange(fp.shape[1])] ^= np.uint64(1) << rng.integers(0, 63, fp.shape[1]).astype(np.uint64)
    group = np.sort(rng.integers(0, 3, fp.shape[1]))
    label = rng.integers(0, 40, fp.shape[1])
    order = np.lexsort((fp[1], fp[0], group))
    fp, group, label = fp[:, order], group[order], label[order]
    a, b = similar.trie_pairs(fp, group, label, 32, most=64)
    want = {(i, j) for i in range(len(group)) for j in range(i + 1, len(group)) if group[i] == group[j] and label[i] != label[j] and sum((int(w[i]) ^ int(w[j])).bit_count() for w in fp) <= 32}
    assert len(want) > 50 and set(zip(a.tolist(), b.tolist(), strict=True)) == want


def test_shingle_sets():
    for t in ("", "one", "A b\tc", "a b c d e", "a  b c d e f É é a b c d e f", "x " * 50):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c < "\x7f" else c for c in t))
        grams = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        assert len(similar.shingle_sets([t, "other"], 5)[0]) == len(grams)
    a, b = similar.shingle_sets(["p q r s t u", "z P Q r s T u"], 5)
    assert len(set(a.tolist()) & set(b.tolist())) == 2


def test_groups_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.orderBy("doc_id").select("doc_id", "text").collect()
    want = {r.doc_id: rows[k].doc_id for r, k in zip(rows, slow_groups([r.text for r in rows]), strict=True)}
    assert {r.doc_id: r.component_id for r in similar.groups(docs).collect()} == want
