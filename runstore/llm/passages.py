"""Fuzzy passages that documents share: k-mer seeds, collinear chains, alignment.

Seeds are hashes of `k` neighbouring words, thinned to the least of each `window` (so any shared run of k + window - 1 words has
one). Each seed that two documents hold is joined to one of its documents, the one with the least key: a passage in n
documents so gives n - 1 links, not n * n, and every document of the group is linked to it. For each pair of documents
the matches on one diagonal become segments; segments that rise in both documents are chained, the best predecessor (score
less the cost of the words between) being a prefix maximum in a Fenwick tree; chains are cut where more than `gap` words
lie between. Along each chain the words are aligned: segments by place, the gaps between them by longest common
subsequence, the ends outwards past short differences. A passage counts from `least_words` words and a `similarity` of 0.8.
The chosen document's own repeats of a seed are matched with its first place, so that its second copies count, too.

Where an alignment as a whole falls short of that, its parts that meet both bounds count.

Seeds alone can miss a pair: if other documents hold each half of a passage, either half may be joined to one of them, and
no chain is long enough. So a second round takes every stretch of seeds that others hold and joins it by longer keys, to the
document with the greatest key: all its windows of `least_words` words, windows of half as many (thinned), and pairs of seeds some
way apart. Left out are only windows inside a run that equals, word for word, words of the document that the first round joined them to: those are
represented there; and windows that no other document can hold, as the seeds in them aren't all held. So all documents that hold a window
of `least_words` words share it with the chosen one, or equal one that does, and
any two documents with such a run are linked, whoever holds parts of it or is linked otherwise. No link is dropped: of a pair, only
further passages go that cover no new word of either document.

Seed tables hold no text; words are fetched only for documents of a chain or an open stretch (a bit map picks them).

Nulls and edges: null, empty and short texts share nothing; a null id is reported as null; rows are told apart by a hash of
id and text, so rows that repeat both are one document, reported each; a text of any length is worked on whole, by one task, in
numpy arrays of some 60 bytes a word; ties between documents go to the least key, between chains to the first place; words are
lower-cased runs of letters and digits; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import bit_map, chunks, grams, grouped, in_bit_map, minimizers, mix64, passing, stored, words

PIECE = "rid long, arid long, chains array<array<int>>"
ALIGNED = "rid long, first_word int, last_word int, arid long, other_first int, other_last int, similarity double, equal array<int>"


KIND = 1 << 16  # a key's place and its kind, in one number: words of a window, or beyond least_words the distance of a pair of seeds


def key() -> Column:
    return F.xxhash64("doc_id", "text")


def seeds(docs: DataFrame, k: int, window: int) -> DataFrame:
    """rid, pos, h, first: whether the document has h for the first time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            word, owner = words(texts)
            if len(word) < k + window:
                continue
            g = np.maximum(grams(word, owner, k), np.uint64(1))
            last = len(word) - (k + window - 1)
            valid = np.zeros(len(g), bool)
            valid[: last + 1] = owner[: last + 1] == owner[k + window - 2 :]
            at = minimizers(g, valid, window)[0]
            own, h = owner[at], g[at]
            order = np.lexsort((at, h, own))
            first = np.ones(len(at), bool)
            first[order[1:]] = (h[order[1:]] != h[order[:-1]]) | (own[order[1:]] != own[order[:-1]])
            begin = np.searchsorted(owner, np.arange(len(texts)))
            rid = batch.column("rid").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(rid[own]), pa.array((at - begin[own]).astype(np.int32)), pa.array(h.view(np.int64)), pa.array(first)], names=["rid", "pos", "h", "first"])

    return docs.select(key().alias("rid"), F.col("text").cast("string")).mapInArrow(run, "rid long, pos int, h long, first boolean")


def chain(first: list[int], last: list[int], other: list[int], cost: float, gap: int) -> list[list[int]]:
    """Chains of segments, best first, each a list of indexes. Segment i covers words first[i]..last[i], and as many from other[i] on."""
    n = len(first)
    end = [o + b - a for a, b, o in zip(first, last, other, strict=True)]
    rank = {x: i + 1 for i, x in enumerate(sorted(set(end)))}
    ends = sorted(rank)
    tree = [(-1.0, -1)] * (len(ends) + 1)
    score, back = [0.0] * n, [-1] * n
    by_first, by_last = sorted(range(n), key=first.__getitem__), sorted(range(n), key=last.__getitem__)
    done = 0
    for j in by_first:
        while done < n and last[by_last[done]] <= first[j]:
            i = by_last[done]
            done += 1
            value, at = (score[i] + cost * (last[i] + end[i]), i), rank[end[i]]
            while at <= len(ends):
                tree[at] = max(tree[at], value)
                at += at & -at
        lo, hi = 0, len(ends)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if ends[mid] <= other[j] else (lo, mid)
        best, at = (-1.0, -1), lo
        while at:
            best = max(best, tree[at])
            at -= at & -at
        score[j] = float(last[j] - first[j])
        if best[1] >= 0 and best[0] - cost * (first[j] + other[j]) > 0:
            score[j] += best[0] - cost * (first[j] + other[j])
            back[j] = best[1]
    used, out = [False] * n, []
    for j in sorted(range(n), key=lambda j: (-score[j], first[j])):
        path: list[int] = []
        while j >= 0 and not used[j]:
            used[j] = True
            if path and max(first[path[-1]] - last[j], other[path[-1]] - end[j]) > gap:
                out.append(path[::-1])
                path = []
            path.append(j)
            j = back[j]
        if path:
            out.append(path[::-1])
    return out


def chained(rows: list[np.ndarray], k: int, window: int, cost: float, gap: int, least: int) -> list[tuple[int, int, list[int]]]:
    """(rid, arid, segments) of each chain; rows: rid, arid, pos, apos and the words that match there, sorted by the first two."""
    rows = [x[(rows[0] != rows[1]) | (rows[2] != rows[3])] for x in rows]  # but a place with itself
    rid, arid, pos, apos, size = rows
    if not len(rid):
        return []
    group = np.cumsum(np.concatenate([[0], (rid[1:] != rid[:-1]) | (arid[1:] != arid[:-1])]))
    diagonal = pos.astype(np.int64) - apos
    order = np.lexsort((pos, diagonal, group))
    group, diagonal, pos, apos, rid, arid, size = (x[order] for x in (group, diagonal, pos, apos, rid, arid, size))
    line = np.cumsum(np.concatenate([[0], (group[1:] != group[:-1]) | (diagonal[1:] != diagonal[:-1])])).astype(np.int64) << 36
    reach = np.maximum.accumulate(line + pos + size)
    new = np.ones(len(pos), bool)
    new[1:] = line[1:] + pos[1:] > reach[:-1] + window - k  # equal words hold a seed in every window
    begin = np.flatnonzero(new)
    stop = np.append(begin[1:], len(pos)) - 1
    first, last, other, of = pos[begin].tolist(), (reach - line)[stop].tolist(), apos[begin].tolist(), group[begin]
    out = []
    cut = np.flatnonzero(np.diff(of, prepend=-1)).tolist() + [len(of)]
    for a, b in zip(cut, cut[1:], strict=False):
        paths = [[0]] if b - a == 1 else chain(first[a:b], last[a:b], other[a:b], cost, gap)
        for path in paths:
            if last[a + path[-1]] - first[a + path[0]] >= least:
                out.append((int(rid[begin[a]]), int(arid[begin[a]]), [x for i in path for x in (first[a + i], last[a + i], other[a + i])]))
    return out


def stretches(rid: np.ndarray, pos: np.ndarray, k: int, gap: int, least: int) -> list[tuple[int, None, list[int]]]:
    """(rid, None, begins and ends) of the runs of seeds, at most `gap` words apart, that span `least` words or more. rid is sorted."""
    order = np.lexsort((pos, rid))
    rid, pos = rid[order], pos[order].astype(np.int64)
    new = np.ones(len(pos), bool)
    new[1:] = (rid[1:] != rid[:-1]) | (pos[1:] - pos[:-1] - k > gap)
    begin = np.flatnonzero(new)
    stop = np.append(begin[1:], len(pos)) - 1
    long = pos[stop] + k - pos[begin] >= least
    begin, stop = begin[long], stop[long]
    cut = np.flatnonzero(np.concatenate([[True], rid[begin][1:] != rid[begin][:-1], [True]])) if len(begin) else []
    return [(int(rid[begin[a]]), None, np.stack([pos[begin[a:b]], pos[stop[a:b]] + k], axis=1).ravel().tolist()) for a, b in zip(cut, cut[1:], strict=False)]


def uncovered(runs: list[int], done: list[tuple[int, int]], least: int, around: int) -> list[tuple[int, int]]:
    """The parts of the runs that `done` leaves open by `least` words or more, with up to `around` words of their run on either side."""
    out: list[tuple[int, int]] = []
    done = sorted(done)
    j = 0
    for s, e in zip(runs[::2], runs[1::2], strict=True):
        at, i = s, j
        while i < len(done) and done[i][0] < e:
            if done[i][0] - at >= least:
                out.append((max(s, at - around), min(e, done[i][0] + around)))
            at = max(at, done[i][1])
            j = i if done[i][1] <= e else j
            i += 1
        if e - at >= least:
            out.append((max(s, at - around), e))
    merged: list[tuple[int, int]] = []
    for s, e in sorted(out):
        if merged and s <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
        else:
            merged.append((s, e))
    return merged


def open_starts(runs: list[int], done: list[tuple[int, int]], window: int, k: int, n: int) -> list[tuple[int, int]]:
    """Ranges of the places from which n words may be shared that lie in none of the ranges `done` whole; runs: first and last place of held seeds.

    The seeds of n shared words are all held, and there is one in each window: so one in the first window, one in the last and no gap between.
    """
    found = [(max(0, s - window + 1), e - (n - k - window + 1) + 1) for s, e in zip(runs[::2], runs[1::2], strict=True)]
    out: list[tuple[int, int]] = []
    inside = [(s, e - n + 1) for s, e in sorted(done) if e - s >= n]
    j = 0
    for at, end in sorted(x for x in found if x[0] < x[1]):
        at = max(at, out[-1][1]) if out else at
        while j < len(inside) and inside[j][1] <= at:
            j += 1
        i = j
        while i < len(inside) and inside[i][0] < end:
            if inside[i][0] > at:
                out.append((at, inside[i][0]))
            at = max(at, inside[i][1])
            i += 1
        if at < end:
            out.append((at, end))
    return out


def common(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """Places, in either, of a longest common subsequence."""
    rows = [np.zeros(len(b) + 1, np.int32)]
    for x in a:
        row = rows[-1].copy()
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], rows[-1][:-1] + (b == x)))
        rows.append(row)
    i, j, at, bt = len(a), len(b), [], []
    while i and j and rows[i][j]:
        if rows[i - 1][j] == rows[i][j]:
            i -= 1
        elif rows[i][j - 1] == rows[i][j]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            at.append(i)
            bt.append(j)
    return at[::-1], bt[::-1]


_SKIPS = sorted(((x, y) for x in range(5) for y in range(5) if x or y), key=lambda s: (max(s), sum(s), s))


def outwards(a: list[int], b: list[int], again: int = 4) -> tuple[list[int], list[int]]:
    """The agreeing words from the start of either document on: past up to 4 differing words, if `again` agree after them."""
    i = j = 0
    top, best = 0, 0
    score = 0
    at: list[int] = []
    bt: list[int] = []
    while True:
        while i < len(a) and j < len(b) and a[i] == b[j]:
            at.append(i)
            bt.append(j)
            i, j, score = i + 1, j + 1, score + 1
        if score > top:
            top, best = score, len(at)
        for x, y in _SKIPS:
            if (run := a[i + x : i + x + again]) == b[j + y : j + y + again] and len(run) == again:
                i, j, score = i + x, j + y, score - max(x, y)
                break
        else:
            return at[:best], bt[:best]


def matched(segments: list[int], a: np.ndarray, b: np.ndarray, a0: int, b0: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the agreeing words of a chain in either document; a and b are the words from a0 and b0 on."""
    part = [(segments[i] - a0, segments[i + 1] - a0, segments[i + 2] - b0) for i in range(0, len(segments), 3)]
    at, bt = part[0][0], part[0][2]
    x, y = outwards(a[:at][::-1].tolist(), b[:bt][::-1].tolist())
    one, two = [at - 1 - np.array(x[::-1], np.int64)], [bt - 1 - np.array(y[::-1], np.int64)]
    for s, e, o in part:
        over = max(at - s, bt - o, 0)
        s, o = s + over, o + over
        if e <= s:
            continue
        if s > at and o > bt:
            x, y = common(a[at:s], b[bt:o])
            one.append(at + np.array(x, np.int64))
            two.append(bt + np.array(y, np.int64))
        n = min(e - s, len(a) - s, len(b) - o)
        same = np.flatnonzero(a[s : s + n] == b[o : o + n])
        one.append(s + same)
        two.append(o + same)
        at, bt = e, o + e - s
    x, y = outwards(a[at:].tolist(), b[bt:].tolist())
    one.append(at + np.array(x, np.int64))
    two.append(bt + np.array(y, np.int64))
    return np.concatenate(one) + a0, np.concatenate(two) + b0


def alike(one: np.ndarray, two: np.ndarray, least: int, similarity: float, block: int = 2048) -> list[tuple[int, int, int, int, float]]:
    """Ranges in either document and similarity: as few as cover every agreeing word that some range of `least` words or more and this similarity holds.

    A range begins and ends with agreeing words. Where the whole alignment falls short, its parts are tried, in blocks of agreeing words that overlap by half.
    """

    def ranged(p: int, q: int) -> tuple[int, int, int, int, float]:
        x, y = int(one[q] - one[p]) + 1, int(two[q] - two[p]) + 1
        return int(one[p]), int(one[p]) + x, int(two[p]), int(two[p]) + y, (q - p + 1) / max(x, y)

    n = len(one)
    if n < similarity * least or min(one[-1] - one[0], two[-1] - two[0]) + 1 < least:
        return []
    if (whole := ranged(0, n - 1))[4] >= similarity:
        return [whole]
    reach = np.full(n, -1)  # the last agreeing word of the longest range from each on
    for begin in range(0, max(1, n - block // 2), block // 2):
        end = min(n, begin + block)
        for p in range(begin, end):
            x, y = one[p:end] - one[p] + 1, two[p:end] - two[p] + 1
            q = np.flatnonzero((np.arange(1, end - p + 1) / np.maximum(x, y) >= similarity) & (np.minimum(x, y) >= least))
            if len(q):
                reach[p] = max(reach[p], p + int(q[-1]))
    out = []
    at = p = 0
    while p < n:  # of the ranges that hold the first word not covered yet, the one that reaches furthest
        best = -1
        while p < n and (p <= at or best < 0):
            if reach[p] >= at and (best < 0 or reach[p] > reach[best]):
                best = p
                at = max(at, p)
            p += 1
        if best >= 0:
            out.append(ranged(best, int(reach[best])))
            at = int(reach[best]) + 1
            p = best + 1
    return out


def equal_runs(one: np.ndarray, two: np.ndarray, least: int) -> list[int]:
    """Begins and ends, in the first document, of the runs of `least` words or more that agree word for word."""
    new = np.flatnonzero(np.concatenate([[True], (np.diff(one) != 1) | (np.diff(two) != 1)]))
    size = np.diff(np.append(new, len(one)))
    new, size = new[size >= least], size[size >= least]
    return np.stack([one[new], one[new] + size], axis=1).ravel().tolist()


def thinned(g: np.ndarray, alone: np.ndarray, n: int, window: int) -> np.ndarray:
    """Places of the least of each `window` of a stretch's hashes of n words; of a stretch with fewer, its least."""
    m = len(alone) - (n + window - 2)
    valid = np.zeros(len(g), bool)
    valid[: max(0, m)] = alone[: max(0, m)] == alone[n + window - 2 :]
    at = minimizers(np.maximum(g, np.uint64(1)), valid, window)[0]
    cut = np.flatnonzero(np.diff(alone, prepend=-1, append=-1)) if len(alone) else np.zeros(1, np.int64)
    few = [(a, b - n + 1) for a, b in zip(cut.tolist(), cut[1:].tolist(), strict=False) if n <= b - a < n + window - 1]
    return np.sort(np.concatenate([at, *(a + np.flatnonzero(g[a:b] == g[a:b].min()) for a, b in few)])) if few else at


def long_keys(word: np.ndarray, k: int, window: int, least: int, alone: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(places, hashes, words) of the keys of stretches: their windows, thinned windows of half the length, and pairs of seeds, either half of them.

    alone: the number of each word's stretch, rising; None: all are one.
    """
    alone = np.zeros(len(word), np.int64) if alone is None else alone

    def hashes(n: int) -> np.ndarray:
        g = grams(word, alone, n)
        m = max(0, len(word) - n + 1)
        return np.where(np.concatenate([alone[:m] == alone[n - 1 :][:m], np.zeros(len(word) - m, bool)]), np.maximum(g, np.uint64(1)), np.uint64(0))

    out = []
    whole, half, seed = hashes(least), hashes(least // 2), hashes(k)
    at = np.flatnonzero(whole)
    out.append((at, whole[at] ^ np.uint64(least), least))
    at = thinned(half, alone, least // 2, window)
    out.append((at, half[at] ^ np.uint64(least // 2), least // 2))
    at = thinned(seed, alone, k, window)
    far = at + least // 2 + window + k - 2  # the last word of the window of seeds in which the mate is sought
    at = at[far < len(word)]
    at = at[alone[at] == alone[at + least // 2 + window + k - 2]]
    ahead = np.lib.stride_tricks.sliding_window_view(seed, window)[at + least // 2] if len(at) else np.zeros((0, window), np.uint64)
    mate = at + least // 2 + (ahead.argmin(axis=1) if len(at) else at)
    pair = mix64(seed[at] + mix64(seed[mate]))
    out.append((at, pair, k))
    out.append((mate, pair ^ np.uint64(1), k))
    return out


def fetched(docs: DataFrame, rids: DataFrame) -> DataFrame:
    """rid, words (the low half of each word's hash, 4 bytes a word) of the rows that the bit map of `rids` names."""
    shared = bit_map(rids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks([batch.filter(in_bit_map(shared.value, batch.column(0)))]):
                word, owner = words(texts)
                cut = np.searchsorted(owner, np.arange(len(texts) + 1))
                small = (word >> np.uint64(32)).astype(np.uint32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([small[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary())], names=["rid", "words"])

    return docs.select(key().alias("rid"), "text").mapInArrow(run, "rid long, words binary")


def add(held: list[tuple[int, int]], s: int, e: int) -> None:
    """Join s..e to the ranges held, which are apart from each other and in order."""
    i = bisect.bisect_left(held, (s, s))
    i -= i > 0 and held[i - 1][1] >= s
    j = i
    while j < len(held) and held[j][0] <= e:
        s, e = min(s, held[j][0]), max(e, held[j][1])
        j += 1
    held[i:j] = [(s, e)]


def left(held: list[tuple[int, int]], s: int, e: int) -> int:
    """How many words of s..e the ranges held leave open."""
    i = bisect.bisect_left(held, (s, s))
    i -= i > 0 and held[i - 1][1] > s
    n = e - s
    while i < len(held) and held[i][0] < e:
        n -= min(e, held[i][1]) - max(s, held[i][0])
        i += 1
    return n


def chosen(ranges: list[tuple[int, int]], done: list[tuple[int, int]], least: int) -> list[int]:
    """Which ranges, the longest first, cover `least` words or more that neither `done` nor those chosen before cover."""
    held: list[tuple[int, int]] = []
    for s, e in done:
        add(held, s, e)
    out = []
    for i in sorted(range(len(ranges)), key=lambda i: (ranges[i][0] - ranges[i][1], ranges[i], i)):
        if left(held, *ranges[i]) >= least:
            out.append(i)
            add(held, *ranges[i])
    return out


def verified(docs: DataFrame, pieces: DataFrame, least_words: int, similarity: float, margin: int, said: DataFrame | None = None) -> DataFrame:
    """ALIGNED: the passages that the chains (PIECE, a row for each pair) become once their words are aligned.

    Of a pair, what covers no word of either document that `said` (ALIGNED) or a longer chain of the pair does not cover is left out.
    """
    word = fetched(docs, pieces.select(F.explode(F.array("rid", "arid")).alias("rid")).distinct())
    ends = ["first_word", "last_word", "other_first", "other_last"]
    first = said is None
    if first:
        pieces = pieces.withColumn("links", F.lit(None).cast("array<array<int>>"))
    else:
        link = said.select("rid", "arid", F.array(*ends).alias("x"))
        link = link.union(said.select("arid", "rid", F.array(*ends[2:], *ends[:2])))
        pieces = pieces.join(link.groupBy("rid", "arid").agg(F.collect_list("x").alias("links")), ["rid", "arid"], "left")

    def cut(begin: str, end: str, name: str) -> list[Column]:
        low = F.greatest(F.lit(0), F.array_min(F.expr(f"transform(chains, x -> {begin})")) - margin)
        return [F.substr(F.col("words"), low * 4 + 1, (F.array_max(F.expr(f"transform(chains, x -> {end})")) + margin - low) * 4).alias(name), low.alias(f"{name}0")]

    end = "x[size(x) - 2]"
    x = pieces.join(word, "rid").select("rid", "arid", "chains", "links", *cut("x[0]", end, "a"))
    x = x.join(word.withColumnRenamed("rid", "arid"), "arid").select("rid", "arid", "chains", "links", "a", "a0", *cut("x[2]", f"x[size(x) - 1] + {end} - x[size(x) - 3]", "b"))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x.slice(i, 64) for x in batches for i in range(0, x.num_rows, 64)):
            out = []
            for rid, arid, chains, links, a, a0, b, b0 in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
                mine: list[tuple[int, int]] = []
                theirs: list[tuple[int, int]] = []
                for s, e, o, p in links or ():
                    add(mine, s, e)
                    add(theirs, o, p)
                for v in sorted(chains, key=lambda v: (v[0] - v[-2], v)):
                    s, e, o, p = v[0], v[-2], v[2], v[-1] + v[-2] - v[-3]
                    if not left(mine, s, e) and not left(theirs, o, p):
                        continue
                    low, other_low = max(a0, s - margin), max(b0, o - margin)
                    one, two = matched(v, a[low - a0 : e + margin - a0], b[other_low - b0 : p + margin - b0], low, other_low)
                    if rid == arid:  # a copy repeats what comes before it, and no word repeats itself
                        one, two = one[one > two], two[one > two]
                    for s, e, o, p, x in alike(one, two, least_words, similarity):
                        if left(mine, s, e) or left(theirs, o, p):
                            i, j = np.searchsorted(one, (s, e))
                            out.append((rid, s, e, arid, o, p, x, equal_runs(one[i:j], two[i:j], least_words) if first else []))
                            add(mine, s, e)
                            add(theirs, o, p)
            if out:
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in ALIGNED.split(", ")])

    return stored(x.mapInArrow(align, ALIGNED), tidy=True)


def shared_passages(docs: DataFrame, **options) -> DataFrame:
    """doc_id, first_word, last_word, other_id, n_others, similarity: the passages of each document that others hold too.

    last_word is exclusive. Of a group, each document names the one that it was joined to; that one gets a row for each of
    its ranges, with the least id and the number of the documents joined there, and the best similarity; a further copy
    in that one document gets the row of the copy it repeats. Options: those of `linked_passages`.
    """
    with passing():
        return stored(linked_passages(docs, **options), keep=True)


def linked_passages(docs: DataFrame, *, k: int = 5, window: int = 8, least_words: int = 40, similarity: float = 0.8, gap: int = 25, cost: float = 0.1, margin: int = 64, least_chain: int = 11) -> DataFrame:
    """The rows of `shared_passages`, over stored tables. Chains of fewer than least_chain words, or in the second round 0.7 least_words, are not aligned."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, 1):
            runs = stretches(rows[0], rows[2], k, gap, least_words - 2 * window)
            whole = {r: x for r, _, x in stretches(rows[0], rows[2], 0, window, 0)}  # without a window that holds no seed
            found = chained([*rows, np.full(len(rows[0]), k)], k, window, cost, gap, least_chain) + [(r, None, y) for r, _, x in runs for y in (x, whole[r])]
            if found:
                yield pieces_of(found)

    def pieces_of(found: list[tuple]) -> pa.RecordBatch:
        pairs: dict[tuple, list[list[int]]] = {}
        for rid, arid, x in found:
            pairs.setdefault((rid, arid), []).append(x)
        columns = [r for r, _ in pairs], [a for _, a in pairs], list(pairs.values())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int32()))), strict=True)], names=["rid", "arid", "chains"])

    seed = seeds(docs, k, window)
    held = seed.filter("first").groupBy("h").agg(F.min("rid").alias("arid"), F.min_by("pos", "rid").alias("apos"), F.max("rid").alias("top")).filter("arid <> top").drop("top")
    with passing():
        held = stored(held, tidy=True)  # a plain table: a hot seed can then be split in the join
        match = seed.select("rid", "pos", "h").join(held, "h").select("rid", "arid", "pos", "apos")
        linked = stored(match.repartition("rid").sortWithinPartitions("rid", "arid").mapInArrow(link, PIECE), keep=True, tidy=True)
    pieces = linked.filter("arid is not null")
    found = verified(docs, pieces, least_words, similarity, margin)

    # what equals words of the chosen document is represented there
    done = found.filter("size(equal) > 0").groupBy("rid").agg(F.flatten(F.collect_set("equal")).alias("done"))
    runs = linked.filter("arid is null").select("rid", F.col("chains")[0].alias("runs"), F.col("chains")[1].alias("whole")).join(done, "rid", "left")

    def left_open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r, x, w, d in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held = list(zip(d[::2], d[1::2], strict=True)) if d else []
                starts = [open_starts(w, held, window, k, n) for n in (least_words, least_words // 2)]
                wide = uncovered([v for p in sorted([*uncovered(x, held, 1, least_words), *((s, e + least_words - 1) for s, e in starts[0])]) for v in p], [], 1, 0)
                if wide:
                    rows.append((r, *([v for p in y for v in p] for y in (wide, *starts))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] + [pa.list_(pa.int32())] * 3, strict=True)], names=["rid", "ranges", "whole", "half"])

    def inside(ranges: list[int], n: int) -> np.ndarray:
        step = np.zeros(n + 1, np.int32)
        np.add.at(step, np.minimum(ranges[::2], n).astype(np.int64), 1)
        np.add.at(step, np.minimum(ranges[1::2], n).astype(np.int64), -1)
        return np.cumsum(step)[:n] > 0

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 64) for b in batches for i in range(0, b.num_rows, 64)):  # some keys a word: few texts at a time
            part: list[tuple[np.ndarray, ...]] = []
            for rid, ranges, whole, half, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                word = np.frombuffer(data, np.uint32)
                may = inside(whole, len(word)), inside(half, len(word))
                for s, e in zip(ranges[::2], ranges[1::2], strict=True):
                    at = np.arange(max(0, s - window), min(e + window, len(word)))  # a stretch begins with a seed, up to a window after what is shared
                    part.append((word[at], at, np.full(len(at), rid), np.full(len(at), len(part)), may[0][at], may[1][at]))
            if not part:
                continue
            word, place, rids, alone, *may = (np.concatenate(c) for c in zip(*part, strict=True))
            (a, x, n), (b, y, m), (c, z, _), (mate, _, _) = long_keys(mix64(word.astype(np.uint64) + np.uint64(1)), k, window, least_words, alone)
            a, x, b, y = a[may[0][a]], x[may[0][a]], b[may[1][b]], y[may[1][b]]  # no other document can hold the rest
            at, h = np.concatenate([a, b, c]), np.concatenate([x, y, z]).view(np.int64)
            kind = np.concatenate([np.full(len(a), n), np.full(len(b), m), least_words + mate - c])
            own, at = rids[at], place[at] * KIND + kind
            order = np.lexsort((at, h, own))
            first = np.ones(len(own), bool)
            first[order[1:]] = (h[order[1:]] != h[order[:-1]]) | (own[order[1:]] != own[order[:-1]])
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(h), pa.array(at), pa.array(first)], names=["rid", "h", "at", "first"])

    def link_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rid, arid, at, other in grouped(batches, 1):
            pos, apos, n, m = at // KIND, other // KIND, at % KIND, other % KIND
            pair = n > least_words  # a pair of seeds: its first and, so many words on, its second
            size = np.where(pair, k, n)
            rows = [rid, arid, pos, apos, size], [rid[pair], arid[pair], (pos + n - least_words)[pair], (apos + m - least_words)[pair], size[pair]]
            rows = [np.concatenate(c) for c in zip(*rows, strict=True)]
            order = np.lexsort((rows[1], rows[0]))
            if chains := chained([c[order] for c in rows], k, window, cost, gap, least_chain):
                yield pieces_of(chains)

    with passing():
        open_ = stored(runs.mapInArrow(left_open, "rid long, ranges array<int>, whole array<int>, half array<int>"), tidy=True)
        text = fetched(docs, open_.select("rid")).dropDuplicates(["rid"])
        keys = stored(open_.join(text, "rid").select("rid", "ranges", "whole", "half", "words").mapInArrow(keyed, "rid long, h long, at long, first boolean"), tidy=True)
        again = keys.filter("first").groupBy("h").agg(F.max("rid").alias("arid"), F.max_by("at", "rid").alias("other"), F.min("rid").alias("low")).filter("arid <> low").drop("low")
        again = stored(again, tidy=True)
        match = keys.join(again, "h").select("rid", "arid", "at", "other")
        more = stored(match.repartition("rid").sortWithinPartitions("rid", "arid").mapInArrow(link_again, PIECE), keep=True, tidy=True)
    found = stored(found.union(verified(docs, more, least_words, similarity, margin, found)).drop("equal").distinct(), tidy=True)

    ids = docs.select(key().alias("rid"), "doc_id")
    names = ids.distinct()
    named = stored(found.join(names, "rid").withColumnRenamed("doc_id", "own_id"))
    repeat, named = named.filter("rid = arid"), named.filter("rid <> arid")
    mine = named.select("rid", "first_word", "last_word", F.col("arid").alias("orid"), F.lit(1).cast("long").alias("n_others"), "similarity")
    mine = mine.join(names.select(F.col("rid").alias("orid"), F.col("doc_id").alias("other_id")), "orid").drop("orid")
    theirs = named.groupBy("arid", "other_first", "other_last").agg(F.min("own_id").alias("other_id"), F.count("*").alias("n_others"), F.max("similarity").alias("similarity"))
    theirs = stored(theirs.select(F.col("arid").alias("rid"), F.col("other_first").alias("first_word"), F.col("other_last").alias("last_word"), "n_others", "similarity", "other_id"))
    copy = repeat.select(F.col("rid"), *(F.col(c).alias(f"c_{c}") for c in ("first_word", "last_word", "other_first", "other_last", "similarity"))).join(theirs.drop("similarity"), "rid").filter("c_other_first < last_word and first_word < c_other_last")
    copy = copy.groupBy("rid", F.col("c_first_word").alias("first_word"), F.col("c_last_word").alias("last_word")).agg(F.max("n_others").alias("n_others"), F.max("c_similarity").alias("similarity"), F.min("other_id").alias("other_id"))
    out = mine.unionByName(theirs).unionByName(copy)
    return out.join(ids, "rid").select("doc_id", "first_word", "last_word", "other_id", "n_others", F.round("similarity", 6).alias("similarity"))
