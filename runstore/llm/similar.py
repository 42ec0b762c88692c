"""SimHash near-duplicates at a Jaccard similarity: tries of long fingerprints propose, whole sets of shingles decide.

Two sets at a similarity s differ in a bit of their fingerprints with a probability of acos(2 s / (1 + s)) / pi at most: at 0.8 in
19 of 128 bits, so no split of the bits into blocks brings all such pairs together at less than the cost of all pairs. Nodes
(distinct sets) therefore meet in buckets of equal bands of min-wise hashes: `bands` of `rows` each, which a pair at 0.8 misses
altogether with a probability of (1 - 0.8 ** 4) ** 16 = 0.0002. Within its buckets the tries of the fingerprints are walked
together, pairs of trie nodes go beyond the error budget (the expected bits and 3.3 deviations: one pair of 2000 at exactly 0.8
exceeds it), and what is left is confirmed on the whole sets, so a link is never wrong.

First each node is compared with one node of each of its buckets, that which shares most buckets with others (of a text and its
edited copies as a rule the text), which joins a large group of copies at the cost of a few pairs for each member. Then, in the
buckets that still hold several components, the tries are walked, but for pairs of trie nodes that lie in one component; pairs are
confirmed inside the task that proposes them, on the sets of its bucket, and no more leave it than join its components, so
a group of texts that are nearly as similar as asked costs time, not rows. Large buckets are dealt in tiles. Equal sets are one node
from the start.

Nulls and edges: texts without words are equal; a text of fewer words than a shingle is one shingle; a long text is hashed whole,
in numpy arrays of some 40 bytes a word; equal sets are told by a 64-bit hash of them; a row whose id is null takes no part, and
stays; rows that share an id but not the text are rows of their own; of a group, the row with the least id stays (ties: the
least hash of its text, then any of equal rows); an empty table gives an empty result; other columns pass through untouched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bit_map, chunks, grams, in_bit_map, mix64, passing, runs_of_words, stored
from .simhash import components, tiles, trie_pairs

WIDE = 2  # words of 64 bits in a fingerprint
_SPACE = np.ones(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = False
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def shingle_sets(texts: list[str], shingle: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles; only A-Z are folded, and only ASCII white space parts words."""
    data = [t.encode(errors="replace") for t in texts]
    word, owner = runs_of_words(_FOLD[np.frombuffer(b" ".join([*data, b""]), np.uint8)], _SPACE, [len(d) + 1 for d in data])
    g = grams(word, owner, shingle)
    cut = np.searchsorted(owner, np.arange(len(texts) + 1))
    out = []
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        n = min(shingle, b - a)
        h = np.sort(g[a : b - shingle + 1] if n == shingle else grams(word[a:b], owner[a:b], n)[:1] if n else g[:0])
        new = np.ones(len(h), bool)
        np.not_equal(h[1:], h[:-1], out=new[1:])
        out.append(h[new])
    return out


def wide_fingerprint(h: np.ndarray) -> list[int]:
    """WIDE words of 64 bits, each bit 1 if set in over half the hashes."""
    ones = np.zeros(64 * WIDE)
    for i in range(0, len(h), 65536):
        x = np.stack([h[i : i + 65536], *(mix64(h[i : i + 65536] + np.uint64(k)) for k in range(1, WIDE))], axis=1)
        bits = np.unpackbits(x.astype(">u8").view(np.uint8), axis=1)
        ones += np.ones(len(bits), np.float32) @ bits.astype(np.float32)  # counts, exact below 2 ** 24
    return np.packbits(ones * 2 > len(h)).view(">u8").tolist()


def factors(n: int) -> np.ndarray:
    """n odd numbers, fixed by a rule."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)


def band_keys(h: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A hash of each band of min-wise hashes."""
    by = factors(bands * rows)
    least = np.full(bands * rows, np.iinfo(np.uint64).max)
    for i in range(0, len(h), 4096):
        np.minimum(least, np.multiply.outer(by, h[i : i + 4096]).min(axis=1), out=least)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for c in least.reshape(bands, rows).T:
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + c)
    return key


def budget(similarity: float) -> int:
    """Bits in which fingerprints of sets as similar as asked differ, and 3.3 deviations."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    n = 64 * WIDE
    return math.ceil(n * p + 3.3 * math.sqrt(n * p * (1 - p)))


def _signed(x: list[int]) -> pa.Array:
    return pa.array(np.array(x, np.uint64).view(np.int64))


def whole_sets(sigs: DataFrame, docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """sig, words: the whole sets of some nodes. nodes: sig, rid (of the row that stands for it)."""
    shared = bit_map(nodes.join(sigs, "sig", "left_semi").select("rid"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in chunks([batch.filter(in_bit_map(shared.value, batch.column("rid")))]):
                some = shingle_sets(texts, shingle)
                yield pa.RecordBatch.from_arrays([_signed([xxhash.xxh64_intdigest(h.tobytes(), 42) for h in some]), pa.array([h.tobytes() for h in some], pa.binary())], names=["sig", "words"])

    whole = docs.select("rid", "text").mapInArrow(fetch, "sig long, words binary").join(sigs, "sig", "left_semi").dropDuplicates(["sig"])
    return stored(whole)  # a plain table: a hub's pairs can then be split in the joins


def alike(one: np.ndarray, others: list[np.ndarray], ratio: Fraction) -> np.ndarray:
    """Which sets are as similar to one as asked, counted exactly."""
    size = np.array([len(x) for x in others])
    if not len(one):
        return size == 0
    flat = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, flat), len(one) - 1)
    upto = np.concatenate([[0], np.cumsum(one[at] == flat)])
    end = np.cumsum(size)
    same = upto[end] - upto[end - size]
    return same * (ratio.numerator + ratio.denominator) >= ratio.numerator * (len(one) + size)


def confirmed(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, shingle: int, ratio: Fraction) -> DataFrame:
    """a, b: the pairs whose whole sets are as similar as asked."""
    pairs = stored(pairs)
    whole = whole_sets(stored(pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct()), docs, nodes, shingle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [bool(alike(np.frombuffer(x, np.uint64), [np.frombuffer(y, np.uint64)], ratio)[0]) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    one, two = (whole.select(F.col("sig").alias(x), F.col("words").alias(f"w{x}")) for x in "ab")
    return stored(pairs.join(one, "a").join(two, "b").select("a", "b", "wa", "wb").mapInArrow(run, "a long, b long"))


def forest(a: np.ndarray, b: np.ndarray, label: np.ndarray, sets: list[bytes], ratio: Fraction) -> list[tuple[int, int]]:
    """Of the pairs that are as similar as asked enough to join their components: at most one for each row. Pairs come by a."""
    label, out = label.copy(), []
    cut = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1], [True]])) if len(a) else []
    for lo, hi in zip(cut, cut[1:], strict=False):
        i, js = int(a[lo]), b[lo:hi]
        js = js[label[js] != label[i]]
        for k in range(0, len(js), 256):
            some = js[k : k + 256]
            some = some[label[some] != label[i]]
            if not len(some):
                continue
            for j in some[alike(np.frombuffer(sets[i], np.uint64), [np.frombuffer(sets[j], np.uint64) for j in some.tolist()], ratio)].tolist():
                if label[j] != label[i]:
                    out.append((i, j))
                    label[label == label[j]] = label[i]
    return out


def groups(docs: DataFrame, **options) -> DataFrame:
    """rid, doc_id, component_id (the least doc_id reachable over links), first (the rid that stands for its group), for each row whose id is not null."""
    with passing():
        return stored(_groups(docs, **options), keep=True)


def _groups(docs: DataFrame, *, shingle: int = 5, similarity: float = 0.8, bands: int = 16, rows: int = 4, tile: int = 4096) -> DataFrame:
    ratio = Fraction(str(similarity))
    most = budget(similarity)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    docs = docs.withColumn("rid", F.xxhash64("doc_id", "text"))

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            sets = shingle_sets(texts, shingle)
            fp = np.array([wide_fingerprint(h) for h in sets], np.uint64).reshape(-1, WIDE).view(np.int64)
            columns = [part.column("rid"), part.column("doc_id"), _signed([xxhash.xxh64_intdigest(h.tobytes(), 42) for h in sets]), pa.array([len(h) for h in sets], pa.int64()), *(pa.array(fp[:, i]) for i in range(WIDE)), pa.array([band_keys(h, bands, rows).view(np.int64) for h in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["rid", "doc_id", "sig", "n", *words_, "bands"])

    words_ = [f"f{i}" for i in range(WIDE)]
    told = stored(docs.mapInArrow(described, f"rid long, doc_id long, sig long, n long, {', '.join(f'{w} long' for w in words_)}, bands array<long>"))
    nodes = stored(told.groupBy("sig").agg(F.min(F.struct("doc_id", "rid")).alias("least"), *(F.first(c).alias(c) for c in ("n", *words_, "bands"))))  # equal sets have equal columns
    slim = nodes.select("sig", F.col("least.doc_id").alias("doc_id"), F.col("least.rid").alias("rid"), "n", *words_)
    band = nodes.select("sig", F.explode("bands").alias("v"))
    held = stored(band.groupBy("v").agg(F.min("sig").alias("low"), F.max("sig").alias("top"), F.count("*").alias("k")).filter("low <> top").select("v", "k"))
    members = stored(band.join(held, "v"))
    crowd = stored(members.groupBy("sig").agg(F.sum("k").alias("crowd")))
    hub = stored(members.select("sig", "v").join(crowd, "sig").groupBy("v").agg(F.max(F.struct("crowd", "sig"))["sig"].alias("hub")))

    def in_reach(pairs: DataFrame) -> DataFrame:
        """Pairs whose fingerprints lie within the budget, and whose sizes allow the similarity."""
        x, y = (slim.select(F.col("sig").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("n", *words_))) for s in "ab")
        apart = sum((F.bit_count(F.col(f"{w}_a").bitwiseXOR(F.col(f"{w}_b"))) for w in words_[1:]), F.bit_count(F.col(f"{words_[0]}_a").bitwiseXOR(F.col(f"{words_[0]}_b"))))
        fits = F.least("n_a", "n_b") * ratio.denominator >= F.greatest("n_a", "n_b") * ratio.numerator
        return pairs.join(x, "a").join(y, "b").filter((apart <= most) & fits).select("a", "b")

    first = members.join(hub, "v").filter("sig <> hub").select(F.col("sig").alias("a"), F.col("hub").alias("b")).distinct()
    near = confirmed(in_reach(first), docs, slim, shingle, ratio)
    label = stored(components(near))

    rooted = stored(slim.join(label.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig")))
    sized = members.filter("k > 2").join(rooted.select("sig", "root", "n", *words_), "sig")  # of two, one was compared with the other
    several = stored(sized.groupBy("v").agg(F.min("root").alias("low"), F.max("root").alias("top")).filter("low <> top").select("v"))
    sized = stored(sized.join(several, "v"))
    whole = whole_sets(stored(sized.select("sig").distinct()), docs, slim, shingle)
    dealt = tiles(sized, ["v"], "sig", tile, F.col("k")).join(whole, "sig")
    columns = ["v", "lo", "hi", "mine", "sig", "root", "n", *words_, "words"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(rows_: np.ndarray, sets: list[bytes]) -> pa.RecordBatch:
            group = np.cumsum(np.any(np.diff(rows_[:3], axis=1, prepend=rows_[:3, :1]) != 0, axis=0))
            fp = rows_[7:].view(np.uint64)
            order = np.lexsort((*fp[::-1], group))
            x, fp, group = rows_[:, order], fp[:, order], group[order]
            across = x[1] != x[2]
            a, b = trie_pairs(fp, group, x[5], most)
            ok = ~(across[a] & (x[3][a] == x[3][b]))  # a tile of two parts compares them only with each other
            ok &= np.minimum(x[6][a], x[6][b]) * ratio.denominator >= np.maximum(x[6][a], x[6][b]) * ratio.numerator
            a, b = a[ok], b[ok]
            by = np.lexsort((b, a))
            links = forest(a[by], b[by], x[5], [sets[i] for i in order.tolist()], ratio)
            one, two = (np.array([x[4][p[i]] for p in links], np.int64) for i in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(one, two)), pa.array(np.minimum(one, two))], names=["a", "b"])

        held: list[np.ndarray] = []
        sets: list[bytes] = []
        for batch in batches:
            held.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(batch.num_columns - 1)]))
            sets += batch.column(batch.num_columns - 1).to_pylist()
            if len(sets) < 8192:
                continue
            now = np.concatenate(held, axis=1)
            same = np.all(now[:3] == now[:3, -1:], axis=0)
            cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            if cut:
                yield found(now[:, :cut], sets[:cut])
            held, sets = [now[:, cut:]], sets[cut:]
        if sets:
            yield found(np.concatenate(held, axis=1), sets)

    keys = ["v", "lo", "hi"]
    more = dealt.select(*columns).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(walk, "a long, b long").distinct()
    late = stored(more)
    named = rooted.select("sig", "doc_id", "rid", "root")
    if not late.isEmpty():  # links between components of the first step, which are nodes now
        of = named.select("sig", "root")
        between = late.join(of.select(F.col("sig").alias("a"), F.col("root").alias("x")), "a").join(of.select(F.col("sig").alias("b"), F.col("root").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        again = stored(components(between))
        named = named.join(again.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("sig", "doc_id", "rid", F.coalesce("top", "root").alias("root"))
    named = stored(named)
    least = stored(named.groupBy("root").agg(F.min(F.struct("doc_id", "rid")).alias("least")))
    of = stored(named.join(least, "root").select("sig", F.col("least.doc_id").alias("component_id"), F.col("least.rid").alias("first")))
    return told.select("rid", "doc_id", "sig").join(of, "sig").select("rid", "doc_id", "component_id", "first")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each group, as it is; rows with a null id stay."""
    named = groups(docs, **options)
    kept = named.filter("rid = first").groupBy("rid").agg(F.count("*").alias("n"))
    row = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("rid"), F.col("doc_id").isNull().alias("no_id"))
    out = row.filter("not no_id").join(kept, "rid", "left_semi")
    if not kept.filter("n > 1").isEmpty():
        out = out.dropDuplicates(["rid"])
    return out.select("row.*").unionByName(row.filter("no_id").select("row.*"))
