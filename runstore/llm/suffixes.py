"""Exact repeats: every byte covered by a `LENGTH`-byte string that starts anywhere else goes.

Finding what to compare: a window of LENGTH bytes is represented by its anchors, the least of its GRAM-byte grams by hash.
Equal windows have equal anchors at equal places, so a window can repeat only where the hash of an anchor of it does. Per
anchor a hash of its context (all bytes of the windows whose anchor it is) is kept, too. Anchors whose hash and context
occur twice are covered as a whole. Of the other anchors with a repeated hash, one context per (hash, context hash) goes on.

Comparing: the contexts of one anchor hash meet in a task, which builds a suffix array by two-stage sorting: only
suffixes smaller than their successors are sorted directly; the larger ones are induced by one scan over the buckets
of first bytes. Then the common prefixes of neighbours are computed; windows of at least LENGTH common bytes that start
at different places repeat. The contexts of an anchor hash with more than `most` of them are not given to one task: each is cut into
pieces of 16 windows, by their places around the anchor, and the pieces are grouped anew by the bytes that all their
windows hold. Groups that are still as large are cut into single windows, whose groups need no comparing.

Rows are told apart by a hash of id and text; rows that repeat both are documents of their own, and so repeat each other.
Nulls and edges: a null text is empty, a null id is reported as null; texts shorter than LENGTH lose nothing; a long text is read
in overlapping parts of a megabyte, and put together as ranges; bytes are judged on the input, never on what is left; an
empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import minimizers, mix64, passing, powers, stored

LENGTH, GRAM = 200, 100
BACK = LENGTH - GRAM  # an anchor lies at most so far behind a window's start
_PART = 1 << 20


def key() -> Column:
    return F.xxhash64("doc_id", "text")


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[tuple[int, int, int, int, int]]]]:
    """About _PART bytes at once, and for each piece in them: row key, its place there, its place in the text, and the range of anchors it answers for."""
    held: list[bytes] = []
    about: list[tuple[int, int, int, int, int]] = []
    size = 0
    for batch in batches:
        rids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
        for i in range(batch.num_rows):
            data = texts[i].as_py()
            for lo in range(0, len(data) if data and len(data) >= LENGTH else 0, _PART):
                begin = max(0, lo - BACK)
                piece = data[begin : lo + _PART + LENGTH]
                about.append((int(rids[i]), size, begin, lo, min(lo + _PART, len(data))))
                held.append(piece)
                size += len(piece)
                if size >= _PART:
                    yield np.frombuffer(b"".join(held), np.uint8), about
                    held, about, size = [], [], 0
    if held:
        yield np.frombuffer(b"".join(held), np.uint8), about


def prefix_hash(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums, and the factors that move a difference of them to place 0."""
    p, q = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[:-1], out=total[1:])
    return total, q


def anchors(docs: DataFrame) -> DataFrame:
    """rid, s, n, at, h, c: n bytes from s on are an anchor's context, it lies `at` bytes in; h is the hash of its gram, c of the context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, about in parts(batches):
            total, q = prefix_hash(data)
            n = len(data) - GRAM + 1
            v = np.maximum(mix64((total[GRAM:] - total[:n]) * q[:n]), np.uint64(1))
            place = np.array([x[1] for x in about])
            end = np.append(place[1:], len(data))
            valid = np.zeros(n, bool)
            answer = np.zeros(n, bool)
            for (_, at, begin, lo, hi), stop in zip(about, end.tolist(), strict=True):
                valid[at : max(at, stop - LENGTH + 1)] = True
                answer[at + lo - begin : at + hi - begin] = True
            p, first, last = minimizers(v, valid, BACK + 1)
            p, first, last = p[answer[p]], first[answer[p]], last[answer[p]]
            own = np.searchsorted(place, p, side="right") - 1
            low, high = first, last + LENGTH
            c = mix64((total[high] - total[low]) * q[low] + (p - low).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (high - p).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
            rid, begin = np.array([x[0] for x in about], np.int64), np.array([x[2] for x in about])
            move = begin[own] - place[own]
            yield pa.RecordBatch.from_arrays([pa.array(rid[own]), pa.array(low + move), pa.array((high - low).astype(np.int32)), pa.array((p - low).astype(np.int32)), pa.array(v[p].view(np.int64)), pa.array(c.view(np.int64))], names=["rid", "s", "n", "at", "h", "c"])

    return docs.select(key().alias("rid"), F.col("text").cast("binary")).mapInArrow(run, "rid long, s long, n int, at int, h long, c long")


def suffix_order(t: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Starts of the suffixes of t in order, at least by their first `depth` bytes."""
    n = len(t)
    step = np.diff(t.astype(np.int16), append=-1)
    where = np.where(step != 0, np.arange(n), n - 1)
    rises = step[np.minimum.accumulate(where[::-1])[::-1]] > 0  # smaller than its successor
    padded = np.concatenate([t, np.zeros(depth, np.uint8)])
    size = np.bincount(t, minlength=256)
    first = np.concatenate([[0], np.cumsum(size)])
    head = first[:-1].copy()
    order = np.empty(n, np.int64)
    own = np.flatnonzero(rises)
    view = np.ndarray((n,), f"S{depth}", padded, strides=(1,))
    own = own[np.argsort(view[own], kind="stable")]
    cut = np.searchsorted(t[own], np.arange(257))
    order[head[t[n - 1]]] = n - 1  # the end of the text is smaller than any byte
    head[t[n - 1]] += 1
    for c in range(256):
        if not size[c]:
            continue
        begin, seen = first[c], first[c]
        while seen < head[c]:  # larger suffixes of this bucket, and those that they induce in it
            before = order[seen : head[c]] - 1
            seen = head[c]
            before = before[before >= 0]
            before = before[t[before] == c]
            order[head[c] : head[c] + len(before)] = before
            head[c] += len(before)
        smaller = own[cut[c] : cut[c + 1]]
        order[head[c] : first[c + 1]] = smaller
        before = np.concatenate([order[begin : head[c]], smaller]) - 1
        before = before[before >= 0]
        before = before[t[before] > c]
        to = t[before]
        by = np.argsort(to, kind="stable")
        before, to = before[by], to[by]
        many = np.bincount(to, minlength=256)
        offset = np.arange(len(to)) - np.repeat(np.cumsum(many) - many, many)
        order[head[to] + offset] = before
        head += many
    return order


def common_prefixes(t: np.ndarray, order: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """Bytes (in eights, up to `most`) that each suffix shares with the one before it in the order; zeros follow the text."""
    padded = np.concatenate([t, np.zeros(most + 8, np.uint8)])
    eight = np.ndarray((len(t) + most,), np.uint64, padded, strides=(1,))
    out = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    for k in range(0, most, 8):
        live = live[eight[order[live] + k] == eight[order[live - 1] + k]]
        out[live] += 8
    return out


def repeats(groups: np.ndarray, rids: np.ndarray, starts: np.ndarray, contexts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which contexts hold windows that occur at another place of their group, and the range that these windows cover."""
    size = np.array([len(c) + 1 for c in contexts])
    begin = np.cumsum(size) - size
    t = np.frombuffer(b"\0".join([*contexts, b""]), np.uint8)
    order = suffix_order(t)
    of = np.searchsorted(begin, order, side="right") - 1
    keep = order - begin[of] + LENGTH < size[of]
    order, of = order[keep], of[keep]
    by = np.argsort(groups[of], kind="stable")
    order, of = order[by], of[by]
    if not len(order):
        none = np.zeros(0, np.int64)
        return none, none, none
    same = (common_prefixes(t, order) >= LENGTH) & (np.diff(groups[of], prepend=groups[of[0]] - 1) == 0)
    run = np.cumsum(~same) - 1
    start = np.flatnonzero(~same)
    _, number = np.unique(rids, return_inverse=True)
    place = (number[of].astype(np.int64) << 36) + starts[of] + order - begin[of]
    twice = (np.minimum.reduceat(place, start) != np.maximum.reduceat(place, start))[run]
    who, at = of[twice], (starts[of] + order - begin[of])[twice]
    low, high = np.full(len(contexts), np.iinfo(np.int64).max), np.full(len(contexts), -1)
    np.minimum.at(low, who, at)
    np.maximum.at(high, who, at)
    hit = np.flatnonzero(high >= 0)
    return hit, low[hit], high[hit] + LENGTH


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rid, s, e of what repeats; batches: h, rid, start, context, sorted by h."""

    def answer(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        h, rid, start = (np.array([r[i] for r in rows], np.int64) for i in range(3))
        hit, s, e = repeats(np.unique(h, return_inverse=True)[1], rid, start, [r[3] for r in rows])
        return pa.RecordBatch.from_arrays([pa.array(rid[hit]), pa.array(s), pa.array(e)], names=["rid", "s", "e"])

    held: list[tuple[int, int, int, bytes]] = []
    size = 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if size >= _PART // 2 and row[0] != held[-1][0]:
                yield answer(held)
                held, size = [], 0
            held.append(row)
            size += len(row[3])
    if held:
        yield answer(held)


def _pieces(width: int):
    """A function that cuts contexts (h, rid, start, at, context; `at` is the anchor's place in the context) into pieces of `width` windows: h then hashes what all of a piece's windows hold, c the piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for h, rid, start, at, context in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total, q = prefix_hash(np.frombuffer(context, np.uint8))
                last = len(context) - LENGTH
                cut = [0, *(x for x in range(1, last + 1) if (at - x + 1) % width == 0), last + 1]  # between windows, by their distance from the anchor
                begin, end = np.array(cut[:-1]), np.array(cut[1:]) - 1
                near = ((at - begin) // width).astype(np.uint64)
                low, high = at - near.astype(np.int64) * width, at - near.astype(np.int64) * width - width + 1 + LENGTH
                core = mix64((total[np.minimum(high, len(context))] - total[np.maximum(low, 0)]) * q[np.maximum(low, 0)] + near)
                c = mix64((total[end + LENGTH] - total[begin]) * q[begin] + (at - begin).astype(np.uint64) * np.uint64(1 << 20) + (end - begin).astype(np.uint64))
                for i, (x, y) in enumerate(zip(begin.tolist(), end.tolist(), strict=True)):
                    out.append((int(core[i].view(np.int64)) ^ h, int(c[i].view(np.int64)), rid, start + x, at - x, context[x : y + LENGTH]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            columns = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=["h", "c", "rid", "start", "at", "context"])

    return run


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        ranges = batch.column(2)
        for i, (doc_id, data) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            data = data or b""
            x = ranges[i].values
            if x is None:
                out.append((doc_id, len(data), 0, 0, hashlib.sha256(data).hexdigest()))
                continue
            s, e = (np.asarray(x.field(k)) for k in (0, 1))
            order = np.argsort(s, kind="stable")
            s, e = s[order], np.maximum.accumulate(np.minimum(e[order], len(data)))
            new = np.flatnonzero(np.concatenate([[True], s[1:] > e[:-1]]))
            first, last = s[new], e[np.append(new[1:], len(s)) - 1]
            kept = hashlib.sha256()
            for a, b in zip([0, *last.tolist()], [*first.tolist(), len(data)], strict=True):
                kept.update(data[a:b])
            out.append((doc_id, len(data), int((last - first).sum()), len(new), kept.hexdigest()))
        kinds = [pa.int64()] * 4 + [pa.string()]
        columns = list(zip(*out, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def covered(docs: DataFrame, most: int = 4096) -> DataFrame:
    """rid, s, e: ranges of bytes that windows with another occurrence cover (ranges may overlap)."""
    with passing():
        at = stored(anchors(docs))
        held = at.groupBy("h").agg(F.count("*").alias("times"), F.min("c").alias("low"), F.max("c").alias("high")).filter("times > 1")
        held = stored(held.select("h", (F.col("low") == F.col("high")).alias("one")))  # a plain table: a hot h can then be split in the join
        shared = stored(at.join(held, "h"), keep=True)
    end = (F.col("s") + F.col("n")).alias("e")
    mixed = shared.filter("not one")
    kinds = stored(mixed.groupBy("h", "c").agg(F.count("*").alias("times"), F.min("rid").alias("rid"), F.min_by("s", "rid").alias("s"), F.min("n").alias("n"), F.min("at").alias("at")))
    twice = mixed.join(kinds.filter("times > 1").select("h", "c").hint("merge"), ["h", "c"])  # a merge join can split the copies of one context
    out = shared.filter("one").select("rid", "s", end).unionByName(twice.select("rid", "s", end))
    text = docs.select(key().alias("rid"), F.col("text").cast("binary").alias("text"))
    context = kinds.join(text, "rid").select("h", "rid", F.col("s").alias("start"), "at", F.substr("text", (F.col("s") + 1).cast("int"), F.col("n")).alias("context"))
    large = stored(kinds.groupBy("h").agg(F.count("*").alias("times")).filter(F.col("times") > most).select("h"))
    for width in (16, 1):
        if large.isEmpty():
            break
        context = stored(context)
        out = out.unionByName(_sorted(context.join(large, "h", "left_anti")))
        piece = stored(context.join(large, "h").select("h", "rid", "start", "at", "context").mapInArrow(_pieces(width), "h long, c long, rid long, start long, at int, context binary"))
        ranges = [F.min("rid") != F.max("rid"), F.min("start") != F.max("start")]
        held = piece.groupBy("h").agg((ranges[0] | ranges[1]).alias("again"), (F.min("c") == F.max("c")).alias("one")).filter("again").select("h", "one")
        shared = stored(piece.join(stored(held), "h"))
        mixed = shared.filter("not one")
        kinds = stored(mixed.groupBy("h", "c").agg((ranges[0] | ranges[1]).alias("again"), F.min("rid").alias("rid"), F.min_by("start", "rid").alias("start"), F.min("at").alias("at"), F.min("context").alias("context")))
        again = shared.filter("one").drop("one", "c").unionByName(mixed.join(kinds.filter("again").select("h", "c").hint("merge"), ["h", "c"]).drop("one", "c"))
        out = out.unionByName(again.select("rid", F.col("start").alias("s"), (F.col("start") + F.length("context")).alias("e")))
        context = kinds.select("h", "rid", "start", "at", "context")
        large = stored(kinds.groupBy("h").agg(F.count("*").alias("times")).filter(F.col("times") > most).select("h"))
    return out.unionByName(_sorted(context))


def _sorted(context: DataFrame) -> DataFrame:
    return context.select("h", "rid", "start", "context").repartition("h").sortWithinPartitions("h").mapInArrow(_compared, "rid long, s long, e long")


def without_repeats(docs: DataFrame, *, most: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with passing():
        found = stored(covered(docs, most), keep=True)
    ranges = found.groupBy("rid").agg(F.collect_list(F.struct("s", "e")).alias("ranges"))
    rows = docs.select(key().alias("rid"), "doc_id", F.col("text").cast("binary").alias("text")).join(ranges, "rid", "left")
    return rows.select("doc_id", "text", "ranges").mapInArrow(_kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
