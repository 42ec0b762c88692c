"""Benchmark decontamination: rare word n-grams as seeds, Smith-Waterman alignment as the verdict.

The benchmark is dealt into blocks of bounded size (`block_bytes` of text). For each block two passes read the corpus: the
first counts, over all documents, in how many each of the block's n-grams occurs; the second looks up the block's seeds in
each document and aligns what they point at. A seed is an n-gram that is among the rarer half of its item's, or the rarest of
`window` neighbouring ones, so every stretch of an item has seeds, however often it was copied into the corpus. Only a block
goes to the executors; documents are never shuffled, so hot passages and sources cost no skew.

An alignment scores +2 for a matching word, -1 for a differing, added or missing one; score = best local alignment / what
the item scores against itself. Documents with a score of `threshold` or more are reported. No alignment scores more than twice the
item's words that the document has at all, so items with too few of them are not aligned: a common opening, or a template, costs a look-up.

Nulls and edges: null texts and texts without words match nothing, nor do items without words or with a null id; items of
fewer than n words are matched as a whole, by an n-gram of their length; ties report the first place; repeated rows are
reported each, repeated items once; of several texts with one id the one that scores best is reported; a long text is worked on
whole, in arrays of some 60 bytes a word; other columns, whatever their names, are ignored (`clean` passes them on); an empty
table on either side gives an empty result. A passage needs one intact n-gram of the item's seeds to be seen.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Shared, chunks, grams, sliding, words

HIT = "doc_id long, item_id long, score double, n_matched int, first_word int, last_word int"
_BITS = np.uint64((1 << 22) - 1)


def align(item: np.ndarray, passages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment of an item with each row of passages (0: no word): score, and the column at which it ends."""
    n, width = passages.shape
    h = np.zeros((n, width + 1), np.int32)
    best, end = np.zeros(n, np.int32), np.zeros(n, np.int64)
    ramp = np.arange(width + 1, dtype=np.int32)
    for w in item:
        new = np.zeros_like(h)
        np.maximum(h[:, :-1] + np.where(passages == w, 2, -1), h[:, 1:] - 1, out=new[:, 1:])
        np.maximum(new, 0, out=new)
        h = np.maximum.accumulate(new + ramp, axis=1) - ramp  # words of the passage that the item lacks
        at = h.argmax(axis=1)
        top = h[np.arange(n), at]
        end = np.where(top > best, at, end)
        best = np.maximum(best, top)
    return best, end


class Block:
    """A part of the benchmark in arrays: the items' words end to end, and the places of their n-grams by hash."""

    def __init__(self, items: list[tuple[int, str]], n: int) -> None:
        self.n = n
        ids, texts, seen = [], [], set()
        for item_id, text in items:
            w = words([text])[0]
            if len(w) and (item_id, w.tobytes()) not in seen:
                seen.add((item_id, w.tobytes()))
                ids.append(item_id)
                texts.append(w)
        self.ids = np.array(ids, np.int64)
        self.size = np.array([len(w) for w in texts], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.words = np.concatenate([np.zeros(0, np.uint64), *texts])
        item = np.repeat(np.arange(len(ids)), self.size)
        place = np.arange(len(item)) - self.begin[item]
        g = grams(self.words, item, n)
        self.short = sorted({int(m) for m in self.size if m < n})
        for m in self.short:  # shorter items have one n-gram, of all their words
            at = self.begin[self.size == m]
            g[at] = grams(self.words, item, m)[at]
        some = g != 0
        self.gram, self.item, self.place = g[some], item[some], place[some]
        self.index()

    def index(self) -> None:
        order = np.argsort(self.gram, kind="stable")
        self.gram, self.item, self.place = self.gram[order], self.item[order], self.place[order]
        self.hashes, first = np.unique(self.gram, return_index=True)
        self.first = np.append(first, len(self.gram))
        self.maybe = np.zeros(int(_BITS) + 1, bool)
        self.maybe[self.hashes & _BITS] = True

    def keep_seeds(self, hashes: np.ndarray, counts: np.ndarray, window: int) -> None:
        """Leave the rarer half of each item's n-grams, and the rarest of any `window` neighbours; counts of the hashes (sorted), 0 for others."""
        if not len(self.gram):
            return
        order = np.lexsort((self.place, self.item))
        gram, item = self.gram[order], self.item[order]
        count = np.zeros(len(gram), np.int64)
        if len(hashes):
            at = np.minimum(np.searchsorted(hashes, gram), len(hashes) - 1)
            count = np.where(hashes[at] == gram, counts[at], 0)
        by_rarity = np.lexsort((gram, count))
        rare = np.empty(len(gram), np.int64)
        rare[by_rarity] = np.cumsum(np.concatenate([[0], gram[by_rarity][1:] != gram[by_rarity][:-1]]))
        start = np.flatnonzero(np.diff(item, prepend=-1))
        size = np.diff(np.append(start, len(item)))
        within = np.lexsort((rare, item))
        keep = np.zeros(len(gram), bool)
        keep[within] = np.arange(len(item)) - np.repeat(start, size) < np.repeat((size + 1) // 2, size)
        keep |= rare == np.repeat(np.where(size <= window, np.minimum.reduceat(rare, start), -1), size)
        least = sliding(rare, window, np.minimum, np.iinfo(np.int64).max)
        for shift in range(window):  # the windows that a place lies in, one after another
            i = np.arange(len(least))[item[: len(least)] == item[window - 1 :]] if len(least) else np.zeros(0, np.int64)
            keep[i + shift] |= rare[i + shift] == least[i]
        kept = np.isin(self.gram, np.unique(gram[keep]))
        self.gram, self.item, self.place = self.gram[kept], self.item[kept], self.place[kept]
        self.index()

    def hits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words and owners of the texts; places of the n-grams that the block has too, and which of its hashes they are."""
        w, owner = words(texts)
        at, of = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n in {self.n, *self.short}:
            g = grams(w, owner, n)
            place = np.flatnonzero(self.maybe[g & _BITS])
            if not len(place) or not len(self.hashes):
                continue
            which = np.minimum(np.searchsorted(self.hashes, g[place]), len(self.hashes) - 1)
            same = (self.hashes[which] == g[place]) & (g[place] != 0)
            at.append(place[same])
            of.append(which[same])
        return w, owner, np.concatenate(at), np.concatenate(of)


def blocks(benchmark: DataFrame, n: int, block_bytes: int) -> Iterator[Block]:
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("item_id is not null and text is not null")
    size = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    parts = -(-size // block_bytes)
    for k in range(parts):
        mine = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k) if parts > 1 else rows
        yield Block(sorted((r.item_id, r.text) for r in mine.toLocalIterator()), n)


def counted(docs: DataFrame, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """The block's n-grams that occur in docs, and in how many of its rows each does."""
    shared = Shared(docs.sparkSession, block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = shared.value
        total = np.zeros(len(b.hashes), np.int64)
        for _, texts in chunks(batches):
            _, owner, at, of = b.hits(texts)
            once = np.unique(np.stack([owner[at], of]), axis=1)[1]
            np.add.at(total, once, 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], names=["g", "n"])

    out = docs.select(F.col("text").cast("string")).mapInArrow(run, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).toArrow()  # at most a row for each n-gram of the block
    g, n = (out.column(c).to_numpy() for c in ("g", "n"))
    order = np.argsort(g)
    return block.hashes[g[order]], n[order]


def seen_together(b: Block, texts: list[str], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the texts, where each text begins, and item, text, shift of the seeds whose pair can reach the threshold, in that order."""
    word, owner, at, of = b.hits(texts)
    first = np.searchsorted(owner, np.arange(len(texts) + 1))
    many = b.first[of + 1] - b.first[of]
    where = np.repeat(b.first[of], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    item, doc, shift = b.item[where], np.repeat(owner[at], many), np.repeat(at, many) - b.place[where]
    order = np.lexsort((shift, item, doc))
    item, doc, shift = item[order], doc[order], shift[order]
    pair = np.flatnonzero((np.diff(item, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))
    good = np.zeros(len(pair), bool)
    for lo, hi in zip(*(x.tolist() for x in runs(doc[pair])), strict=True):
        d, items = int(doc[pair[lo]]), item[pair[lo:hi]]
        has = np.unique(word[first[d] : first[d + 1]])
        for i in range(0, len(items), 1 << 14):
            some = items[i : i + (1 << 14)]
            size = b.size[some]
            ends = np.cumsum(size)
            x = b.words[np.repeat(b.begin[some], size) + np.arange(ends[-1]) - np.repeat(ends - size, size)]
            near = np.minimum(np.searchsorted(has, x), len(has) - 1)
            good[lo + i : lo + i + len(some)] = np.add.reduceat(has[near] == x, ends - size, dtype=np.int64) >= threshold * size
    keep = np.repeat(good, np.diff(np.append(pair, len(item))))
    return word, first, item[keep], doc[keep], shift[keep]


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each run of equal values."""
    begin = np.flatnonzero(np.diff(x, prepend=x[0] - 1)) if len(x) else np.zeros(0, np.int64)
    return begin, np.append(begin[1:], len(x)) if len(x) else begin


def found_in(b: Block, texts: list[str], threshold: float) -> dict[tuple[int, int], tuple[float, int, int, int, int]]:
    """(text, item): score, place, matched words, first and last word of the best passage, where it reaches the threshold."""
    word, first, item, doc, shift = seen_together(b, texts, threshold)
    work: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    begin, end = runs(doc * (len(b.ids) + 1) + item)
    for lo, hi in zip(begin.tolist(), end.tolist(), strict=True):
        which, d, places = int(item[lo]), int(doc[lo]), shift[lo:hi].tolist()
        m = int(b.size[which])
        slack = 4 + m // 4
        group = [places[0], places[0]]
        for x in [*places[1:], None]:
            if x is not None and x - group[1] <= slack and x - group[0] <= 2 * m:
                group[1] = x
                continue
            work[which].append((d, max(int(first[d]), group[0] - slack), min(int(first[d + 1]), group[1] + m + slack)))
            group = [x, x]
    found: dict[tuple[int, int], tuple] = {}
    for which, parts in work.items():
        own, item_id = b.words[b.begin[which] : b.begin[which] + b.size[which]], int(b.ids[which])
        parts.sort(key=lambda x: x[2] - x[1])
        for i in range(0, len(parts), 256):
            some = parts[i : i + 256]
            width = max(hi - lo for _, lo, hi in some)
            grid = np.zeros((len(some), width), np.uint64)
            for r, (_, lo, hi) in enumerate(some):
                grid[r, : hi - lo] = word[lo:hi]
            score, end_ = align(own, grid)
            for r, ((d, lo, _), s, e) in enumerate(zip(some, score.tolist(), end_.tolist(), strict=True)):
                share = s / (2 * len(own))
                if share >= threshold and (share, -lo) > found.get((d, item_id), (0.0,))[:2]:
                    begin_ = lo + e - int(align(own[::-1], grid[r : r + 1, :e][:, ::-1])[1][0])  # backwards, the alignment ends where it begins
                    found[d, item_id] = (share, -lo, matched(own, word[begin_ : lo + e]), begin_ - int(first[d]), lo + e - 1 - int(first[d]))
    return found


def matched(item: np.ndarray, passage: np.ndarray) -> int:
    """Most matching words in any best alignment of the two: scores are counted in steps of `unit`, with a match's own 1 below."""
    unit = 1 << 20
    h = np.zeros(len(passage) + 1, np.int64)
    ramp = unit * np.arange(len(passage) + 1)
    best = 0
    for w in item:
        new = np.zeros_like(h)
        np.maximum(h[:-1] + np.where(passage == w, 2 * unit + 1, -unit), h[1:] - unit, out=new[1:])
        h = np.maximum.accumulate(np.maximum(new, 0) + ramp) - ramp
        best = max(best, int(h.max()))
    return best % unit


def leaks(docs: DataFrame, benchmark: DataFrame, *, n: int = 3, window: int = 4, threshold: float = 0.5, block_bytes: int = 1 << 24) -> DataFrame:
    """doc_id, item_id, score, n_matched, first_word, last_word: for each document and item above the threshold its best passage."""
    spark = docs.sparkSession
    out = spark.createDataFrame([], HIT)
    for block in blocks(benchmark, n, block_bytes):
        block.keep_seeds(*counted(docs, block), window)
        out = out.union(_aligned(docs, Shared(spark, block), threshold))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, *, n: int = 3, window: int = 4, threshold: float = 0.5, block_bytes: int = 1 << 24) -> DataFrame:
    """The rows of docs, as they are, that hold no passage of the benchmark."""
    kind, whole = docs.schema, docs
    for block in blocks(benchmark, n, block_bytes):
        block.keep_seeds(*counted(whole, block), window)
        shared = Shared(docs.sparkSession, block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch, texts in chunks(batches):
                keep = np.ones(len(texts), bool)
                keep[[d for d, _ in found_in(shared.value, texts, threshold)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, kind)
    return docs


def _aligned(docs: DataFrame, shared: Shared, threshold: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            if found := found_in(shared.value, texts, threshold):
                ids = batch.column("doc_id")
                cols = zip(*((ids[d].as_py(), i, s, m, a, z) for (d, i), (s, _, m, a, z) in sorted(found.items())), strict=True)
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in HIT.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, HIT)
