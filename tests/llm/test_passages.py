"""No two documents that share a passage may miss each other, whoever holds parts of it."""

import random

import numpy as np

from runstore.llm import _common, passages
from runstore.llm._common import words

DOCS = "doc_id long, text string, rid string, pos string"


def written(spark, rows):
    return spark.createDataFrame([(i, None if w is None else " ".join(w), "", "") for i, w in rows], DOCS).repartition(4)


def covered(out):
    held = {}
    for r in out:
        assert r.similarity >= 0.8 and r.last_word - r.first_word >= 40
        held.setdefault(r.doc_id, set()).update(range(r.first_word, r.last_word))
    return held


def bodies(seed, n=6000):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(n)]
    return rng, lambda n: rng.choices(vocabulary, k=n)


def test_halves_held_by_others(spark):
    """Each half of a passage lies in documents of its own, too: the documents that hold it whole still meet."""
    for length, n in ((76, 1), (60, 1), (60, 8), (52, 3)):
        rng, body = bodies(length + n)
        half = length // 2
        rows, whole = [], []
        for group in range(6):
            passage = body(length)
            for _ in range(n):
                rows.append((len(rows), body(20) + passage[:half] + body(20)))
                rows.append((len(rows), body(20) + passage[half:] + body(20)))
            for _ in range(2):
                whole.append((len(rows), 15))
                rows.append((len(rows), body(15) + passage + body(25)))
        got = covered(passages.shared_passages(written(spark, rows)).collect())
        for i, at in whole:
            assert set(range(at, at + length)) <= got.get(i, set()), (length, n, i)


def test_second_copy_in_the_chosen_document(spark):
    rng, body = bodies(5)
    passage = body(70)
    for k in range(4):  # whichever hashes lowest
        rows = [(0, body(50) + passage + body(20) + passage), (1, body(k) + passage), (2, body(30))]
        got = covered(passages.shared_passages(written(spark, rows)).collect())
        assert set(got) == {0, 1}
        assert got[0] >= set(range(50, 120)) | set(range(140, 210)) and got[1] >= set(range(k, k + 70))


def shared_windows(texts, n=40):
    """Which windows of n words lie in two documents, by brute force."""
    held = {}
    for i, t in enumerate(texts):
        for p in range(len(t) - n + 1):
            held.setdefault(tuple(t[p : p + n]), set()).add(i)
    out = {}
    for i, t in enumerate(texts):
        for p in range(len(t) - n + 1):
            if len(held[tuple(t[p : p + n])]) > 1:
                out.setdefault(i, set()).update(range(p, p + n))
    return out


def test_against_all_windows(spark):
    """200 documents of lines that many share, in random order: any run of 40 words that two hold is found in both, and nothing where there is no passage."""
    rng, body = bodies(9)
    lines = [body(rng.randrange(8, 34)) for _ in range(40)]
    texts = []
    for _ in range(200):
        parts = [rng.choice(lines) if rng.random() < 0.85 else body(rng.randrange(10, 40)) for _ in range(rng.randrange(3, 12))]
        texts.append([w for p in parts for w in p])
    want = shared_windows(texts)
    assert len(want) > 60
    got = covered(passages.shared_passages(written(spark, list(enumerate(texts)))).collect())
    lost = {i: sorted(x - got.get(i, set())) for i, x in want.items() if x - got.get(i, set())}
    assert lost == {}
    short = shared_windows(texts, 25)  # a passage of 40 words at 0.8 has a run of fewer words, but in this table lines are whole
    assert set(got) <= set(short)


def test_edited_copies_are_found(spark):
    """Recall of passages of 60 to 90 words with a tenth of their words replaced."""
    rng, body = bodies(12)
    rows = []
    for _ in range(120):
        passage = body(rng.randrange(60, 91))
        for _ in range(2):
            own = [rng.choice(body(1)) if rng.random() < 0.05 else w for w in passage]
            rows.append((len(rows), body(20) + own + body(20)))
    got = covered(passages.shared_passages(written(spark, rows)).collect())
    assert len(got) >= 0.97 * len(rows)


def test_long_texts_ties_and_clashing_columns(spark):
    rng, body = bodies(3)
    long, passage = body(200_000), body(60)
    data = [(1, " ".join(long[:150_000] + passage + long[150_000:]), "", ""), (2, " ".join(passage), "", ""), (2, " ".join(passage), "", ""), (3, None, "", ""), (4, "", "", "")]
    out = passages.shared_passages(spark.createDataFrame(data, DOCS)).collect()
    assert {r.doc_id for r in out} == {1, 2} and sum(r.doc_id == 2 for r in out) == 2
    assert any(r.first_word <= 150_000 and r.last_word >= 150_060 for r in out)


def test_uncovered():
    assert passages.uncovered([0, 100], [], 5, 40) == [(0, 100)]
    assert passages.uncovered([0, 100], [(0, 100)], 5, 40) == []
    assert passages.uncovered([0, 200], [(50, 150)], 5, 10) == [(0, 60), (140, 200)]
    assert passages.uncovered([10, 60, 90, 150], [(5, 58), (85, 120)], 5, 8) == [(112, 150)]


def test_long_keys_of_equal_texts_agree():
    word = words(["a b c d e f g h i j k l m n o p q r s t u v w x y z " * 3])[0]
    a, b = passages.long_keys(word, 5, 8, 40), passages.long_keys(word.copy(), 5, 8, 40)
    assert len(a) == 4 and all(np.array_equal(x[1], y[1]) for x, y in zip(a, b, strict=True))


def test_chosen_ranges():
    assert passages.chosen([(0, 50), (10, 90), (85, 95)], [], 5) == [1, 0, 2]
    assert passages.chosen([(0, 50), (10, 90), (85, 95)], [(0, 100)], 1) == []
    rng = random.Random(4)
    for _ in range(200):
        ranges = [(a, a + rng.randrange(1, 20)) for a in (rng.randrange(60) for _ in range(8))]
        done = [(a, a + rng.randrange(1, 9)) for a in (rng.randrange(60) for _ in range(3))]
        held, want = {w for s, e in done for w in range(s, e)}, []
        for i in sorted(range(8), key=lambda i: (ranges[i][0] - ranges[i][1], ranges[i], i)):
            new = set(range(*ranges[i])) - held
            if len(new) >= 4:
                want.append(i)
                held |= new
        assert passages.chosen(ranges, done, 4) == want


def test_runs_apart_by_other_words(spark):
    """Two runs that meet the thresholds, with 21 unlike words between: too unlike as one passage, and each is found alone."""
    rng, body = bodies(21)
    rows = []
    for _ in range(30):
        a, b = body(40), body(40)
        for _ in range(2):
            rows.append((len(rows), body(30) + a + body(21) + b + body(30)))
    got = covered(passages.shared_passages(written(spark, rows)).collect())
    for i, _ in rows:
        assert got.get(i, set()) >= set(range(30, 70)) | set(range(91, 131)), i


def test_run_that_the_chosen_document_breaks(spark):
    """A holds B's 124 words and the run of C with 20 words in its midst: C and B share the run whole, whichever hashes lowest."""
    rng, body = bodies(22)
    rows = []
    for _ in range(30):
        run, rest = body(44), body(80)
        for text in (run[:22] + body(20) + run[22:] + rest, run + rest, body(30) + run + body(30)):
            rows.append((len(rows), body(10) + text + body(10)))
    out = passages.shared_passages(written(spark, rows)).collect()
    got = covered(out)
    for i in range(1, 90, 3):
        assert got.get(i, set()) >= set(range(10, 134)) and got.get(i + 1, set()) >= set(range(40, 84)), i
        assert any({r.doc_id, r.other_id} == {i, i + 1} for r in out), i


def test_parts_of_an_alignment_that_meet_the_thresholds():
    """Against all pairs of agreeing words."""
    rng = random.Random(2)
    for t in range(200):
        n, least = rng.randrange(1, 90), rng.choice([5, 10, 40])
        one = np.cumsum([rng.choice([1, 1, 1, 1, 1, 2, 3, 1 if t % 2 else 9]) for _ in range(n)])
        two = np.cumsum([rng.choice([1, 1, 1, 1, 2, 1]) for _ in range(n)])
        want: set[int] = set()
        for p in range(n):
            for q in range(p, n):
                x, y = one[q] - one[p] + 1, two[q] - two[p] + 1
                if min(x, y) >= least and (q - p + 1) / max(x, y) >= 0.8:
                    want |= set(range(p, q + 1))
        got: set[int] = set()
        for s, e, o, p, similarity in passages.alike(one, two, least, 0.8, block=n + 1):
            assert similarity >= 0.8 and min(e - s, p - o) >= least
            got |= set(range(int(one.searchsorted(s)), int(one.searchsorted(e))))
        assert got == want


def test_windows_that_cross_two_equal_runs(spark):
    """A1 and A2 hold words 0-50 and 30-80 of what B and C share in part: no word of B is open, yet its words 20-60 are shared with C alone."""
    rng, body = bodies(23)
    rows = []
    for _ in range(12):
        passage = body(80)
        for text in (passage[:50], passage[30:], passage, passage[18:62]):
            rows.append((len(rows), body(20) + text + body(20)))
    got = covered(passages.shared_passages(written(spark, rows)).collect())
    for i in range(0, len(rows), 4):
        assert got.get(i + 2, set()) >= set(range(20, 100)) and got.get(i + 3, set()) >= set(range(20, 64)), i


def test_open_starts():
    """Against every place, one by one."""
    rng = random.Random(6)
    for _ in range(300):
        runs = sorted(rng.sample(range(200), 4))
        done = [(a, a + rng.randrange(30, 90)) for a in (rng.randrange(150) for _ in range(rng.randrange(4)))]
        want = {x for s, e in zip(runs[::2], runs[1::2], strict=True) for x in range(max(0, s - 7), e - 28 + 1) if not any(a <= x and x + 40 <= b for a, b in done)}
        got = passages.open_starts(runs, done, 8, 5, 40)
        assert {x for s, e in got for x in range(s, e)} == want


def test_runs_of_one_word(spark):
    """43 and 41 times the same word, in two documents that share nothing else: its last two words are found, too."""
    rng, body = bodies(24)
    rows = [(0, body(60) + ["ingth"] * 43), (1, body(30) + ["ingth"] * 41 + body(30))]
    got = covered(passages.shared_passages(written(spark, rows)).collect())
    assert got == {0: set(range(60, 103)), 1: set(range(30, 71))}


def test_tidy_tables_leave_no_shuffle_files(spark):
    def shuffles():
        return spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()

    before = shuffles()
    out = _common.stored(spark.range(1000).repartition(3, "id"), tidy=True)
    assert shuffles() == before and out.count() == 1000
