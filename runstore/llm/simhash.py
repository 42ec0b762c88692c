"""SimHash near-duplicates: fingerprints of word shingles, linked at a Hamming distance by a self-join of binary tries.

Equal fingerprints are one node. Of `distance` + r blocks of the 64 bits, any two linked fingerprints agree on r whole
blocks, so nodes meet in buckets (blocks chosen, their bits). A bucket of more than `tile` nodes is dealt in tiles: its
nodes fall in parts, and each pair of parts meets in a task of its own. Inside a task all buckets are walked together:
pairs of trie nodes go down bit by bit, each differing bit adds to the pair's error, and pairs beyond the budget go. Pairs
of trie nodes that already lie in one component are left, as no link of theirs can change a component; a bucket so gives at
most one edge per node. Components come from alternating large-star and small-star steps on stored tables.

Nulls and edges: a null or blank text has fingerprint zero, linked like any other; a row whose id is null keeps its
fingerprint, takes no part in links, and has a null component; repeated rows and ids agree; a long text is hashed whole, in pieces of
65536 shingles; an empty table gives an empty result; other columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import passing, stored


_GAP = re.compile(rb"[\x09-\x0d\x20]{2,}|[\x09-\x0d]")


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """Hash of each shingle of the text, repeated ones too; a shorter text is one shingle."""
    data = _GAP.sub(b" ", (text or "").encode(errors="replace").lower()).strip(b" ")  # bytes: only A-Z change, and only ASCII white space parts
    if not data:
        return np.empty(0, np.uint64)
    gap = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    begin, end = np.append(0, gap + 1)[: max(1, len(gap) + 2 - shingle)], np.append(gap, len(data))[min(shingle - 1, len(gap)) :]
    digest = xxhash.xxh64_digest
    out = []
    for i in range(0, len(begin), 65536):  # so that a long text is never a list of all its shingles
        out.append(np.frombuffer(b"".join([digest(data[a:b], 42) for a, b in zip(begin[i : i + 65536].tolist(), end[i : i + 65536].tolist(), strict=True)]), ">u8"))
    return np.concatenate(out).astype(np.uint64)


def fingerprint(text: str | None, shingle: int = 4) -> int:
    h = shingle_hashes(text, shingle).astype(">u8").view(np.uint8).reshape(-1, 8)
    if not len(h):
        return 0
    ones = np.zeros(64)
    for i in range(0, len(h), 65536):
        ones += np.ones(len(h[i : i + 65536]), np.float32) @ np.unpackbits(h[i : i + 65536], axis=1).astype(np.float32)  # counts, exact below 2 ** 24
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, fp: one row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (the least index of each component) after the edges a-b."""
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return label
        a, b = a[open_], b[open_]
        np.minimum.at(label, np.maximum(x, y)[open_], np.minimum(x, y)[open_])
        while not np.array_equal(nxt := label[label], label):
            label = nxt


def trie_forest(fp: np.ndarray, group: np.ndarray, distance: int, most: int = 1 << 20) -> np.ndarray:
    """Least index of each node's component, over links inside a group. fp is sorted within each group, and distinct there; groups are together."""
    n = len(fp)
    label = np.arange(n)
    for turn in (0, 16, 32, 48):  # neighbours in a few orders join most components cheaply
        turned = (fp << np.uint64(turn)) | (fp >> np.uint64(64 - turn)) if turn else fp
        order = np.lexsort((turned, group))
        a, b = order[:-1], order[1:]
        close = (group[a] == group[b]) & (np.bitwise_count(fp[a] ^ fp[b]) <= distance)
        label = merged(label, a[close], b[close])
    start = np.flatnonzero(np.diff(group, prepend=group[0] - 1))
    stop = np.append(start[1:], n)
    keep = stop - start > 1
    stack = [(63, (start[keep], stop[keep], start[keep], stop[keep], np.zeros(keep.sum(), np.int8)))]
    while stack:
        bit, front = stack.pop()
        if len(front[0]) > most:
            cut = len(front[0]) // 2
            stack += [(bit, tuple(x[:cut] for x in front)), (bit, tuple(x[cut:] for x in front))]
            continue
        changes = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])
        al, ah, bl, bh, err = front
        one = (changes[al] == changes[ah - 1]) & (changes[bl] == changes[bh - 1]) & (label[al] == label[bl])
        front = tuple(x[~one] for x in front)
        al, ah, bl, bh, err = front
        small = ((ah - al) * (bh - bl) <= 64) | (bit < 0)
        if small.any():
            sal, sah, sbl, sbh = (x[small] for x in front[:4])
            count = (sah - sal) * (sbh - sbl)
            for i in range(0, len(count), 1 << 15):
                c = count[i : i + (1 << 15)]
                who = np.repeat(np.arange(i, i + len(c)), c)
                k = np.arange(len(who)) - np.repeat(np.cumsum(c) - c, c)
                wide = (sbh - sbl)[who]
                a, b = sal[who] + k // wide, sbl[who] + k % wide
                close = (a < b) & (np.bitwise_count(fp[a] ^ fp[b]) <= distance)
                label = merged(label, a[close], b[close])
            front = tuple(x[~small] for x in front)
            al, ah, bl, bh, err = front
        if not len(al):
            continue
        ones = np.concatenate([[0], np.cumsum((fp >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)])
        am, bm = ah - (ones[ah] - ones[al]), bh - (ones[bh] - ones[bl])
        self_ = al == bl
        parts = [(al, am, bl, bm, err, None), (am, ah, bm, bh, err, None), (al, am, bm, bh, err + 1, None), (am, ah, bl, bm, err + 1, ~self_)]
        new = []
        for a0, a1, b0, b1, e, where in parts:
            ok = (a1 > a0) & (b1 > b0) & (e <= distance) & ~((a0 == b0) & (a1 - a0 == 1))
            ok = ok & where if where is not None else ok
            new.append(tuple(x[ok] for x in (a0, a1, b0, b1, e)))
        stack.append((bit - 1, tuple(np.concatenate(x) for x in zip(*new, strict=True))))
    return label


def trie_pairs(fp: np.ndarray, group: np.ndarray, label: np.ndarray, distance: int, most: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Pairs a < b of a group whose labels differ and whose fingerprints lie within the distance. fp: words of 64 bits, highest first, sorted within each group; groups are together."""
    n = fp.shape[1]
    top = 64 * len(fp) - 1
    changes = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])
    start = np.flatnonzero(np.diff(group, prepend=group[0] - 1)) if n else np.zeros(0, np.int64)
    stop = np.append(start[1:], n) if n else start
    stack = [(top, (start, stop, start, stop, np.zeros(len(start), np.int16)))]
    out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while stack:
        bit, front = stack.pop()
        if len(front[0]) > most:
            cut = len(front[0]) // 2
            stack += [(bit, tuple(x[:cut] for x in front)), (bit, tuple(x[cut:] for x in front))]
            continue
        al, ah, bl, bh, _ = front
        one = (changes[al] == changes[ah - 1]) & (changes[bl] == changes[bh - 1]) & (label[al] == label[bl])
        front = tuple(x[~one] for x in front)
        al, ah, bl, bh, err = front
        small = ((ah - al) * (bh - bl) <= 64) | (bit < 0)
        sal, sah, sbl, sbh = (x[small] for x in front[:4])
        count = (sah - sal) * (sbh - sbl)
        done = 0
        while done < len(count):  # runs of node pairs with about `most` pairs of leaves in all
            upto = max(done + 1, int(np.searchsorted(np.cumsum(count[done:]), most, side="right")) + done)
            c = count[done:upto]
            who = np.repeat(np.arange(done, upto), c)
            k = np.arange(len(who)) - np.repeat(np.cumsum(c) - c, c)
            wide = (sbh - sbl)[who]
            a, b = sal[who] + k // wide, sbl[who] + k % wide
            some = (a < b) & (label[a] != label[b])
            a, b = a[some], b[some]
            close = sum(np.bitwise_count(w[a] ^ w[b]).astype(np.int16) for w in fp) <= distance
            out_a.append(a[close])
            out_b.append(b[close])
            done = upto
        front = tuple(x[~small] for x in front)
        al, ah, bl, bh, err = front
        if not len(al):
            continue
        word = fp[(top - bit) // 64]
        ones = np.concatenate([[0], np.cumsum((word >> np.uint64(bit % 64)) & np.uint64(1), dtype=np.int64)])
        am, bm = ah - (ones[ah] - ones[al]), bh - (ones[bh] - ones[bl])
        self_ = al == bl
        parts = [(al, am, bl, bm, err, None), (am, ah, bm, bh, err, None), (al, am, bm, bh, err + 1, None), (am, ah, bl, bm, err + 1, ~self_)]
        new = []
        for a0, a1, b0, b1, e, where in parts:
            ok = (a1 > a0) & (b1 > b0) & (e <= distance) & ~((a0 == b0) & (a1 - a0 == 1))
            ok = ok & where if where is not None else ok
            new.append(tuple(x[ok] for x in (a0, a1, b0, b1, e)))
        stack.append((bit - 1, tuple(np.concatenate(x) for x in zip(*new, strict=True))))
    return np.concatenate(out_a), np.concatenate(out_b)


def block_masks(distance: int, whole: int) -> list[int]:
    """Masks of every choice of `whole` blocks out of distance + whole blocks of 64 bits."""
    n = distance + whole
    cut = [round(64 * i / n) for i in range(n + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(cut, cut[1:], strict=False)]
    return [sum(c) for c in combinations(block, whole)]


def tiles(rows: DataFrame, bucket: list[str], by: str, tile: int, size: Column) -> DataFrame:
    """Add mine, lo, hi: a bucket of `size` rows falls in parts of about `tile`, and each row meets every part of its bucket in a tile (lo, hi) of its own."""
    rows = rows.withColumn("parts", F.ceil(size / tile).cast("int"))
    rows = rows.withColumn("mine", F.pmod(F.xxhash64(by), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.withColumn("lo", F.least("mine", "other")).withColumn("hi", F.greatest("mine", "other")).drop("other", "parts")


def near_edges(nodes: DataFrame, distance: int = 4, tile: int = 4096) -> DataFrame:
    """a, b (b < a): edges whose components are those of all links. nodes: fp (distinct), rep (its id, distinct)."""
    n = nodes.count()
    whole = 1 if n <= 1 << 25 else 2 if n <= 1 << 32 else 3  # so that a bucket of evenly spread fingerprints stays small
    masks = [m - (1 << 64) if m >> 63 else m for m in block_masks(distance, whole)]
    keyed = nodes.select("fp", "rep", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("j", "v"))
    large = keyed.groupBy("j", "v").agg(F.count("*").alias("k")).filter(F.col("k") > tile)
    large = stored(large)  # a plain table: a hot bucket can then be split in the join
    keyed = tiles(keyed.join(large, ["j", "v"], "left"), ["j", "v"], "fp", tile, F.coalesce("k", F.lit(1))).select("j", "v", "lo", "hi", "fp", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def edges(rows: np.ndarray) -> pa.RecordBatch:
            fp, rep = rows[4].view(np.uint64), rows[5]
            group = np.cumsum(np.any(np.diff(rows[:4], axis=1, prepend=rows[:4, :1]) != 0, axis=0))
            order = np.lexsort((fp, group))
            label = trie_forest(fp[order], group[order], distance)
            root = rep[order].copy()
            np.minimum.at(root, label, rep[order])  # a component is named by its least id
            a, b = rep[order], root[label]
            return pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], names=["a", "b"])

        for batch in batches:
            held.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(6)]))
            if sum(x.shape[1] for x in held) < 65536:
                continue
            rows = np.concatenate(held, axis=1)
            same = np.all(rows[:4] == rows[:4, -1:], axis=0)
            cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0  # the last bucket may go on in the next batch
            if cut:
                yield edges(rows[:, :cut])
            held = [rows[:, cut:]]
        if held and (rows := np.concatenate(held, axis=1)).shape[1]:
            yield edges(rows)

    keys = ["j", "v", "lo", "hi"]
    return keyed.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root (the least node reachable) for all nodes of the edges a-b, by alternating large and small stars."""
    edges = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(rounds):
        with passing():
            both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))  # a plain table: the join can split a hub's edges
            large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
            large = stored(large)
            least = stored(large.groupBy("a").agg(F.min("b").alias("m")))
            small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            edges = stored(small.union(least.select("a", F.col("m").alias("b"))).distinct(), keep=True)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the stars did not settle")
    roots = edges.select("b").distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select("b", "b"))


def near_duplicates(docs: DataFrame, *, shingle: int = 4, distance: int = 4, tile: int = 4096) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id (the least doc_id reachable over links)."""
    rows = stored(fingerprints(docs, shingle))
    nodes = stored(rows.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    root = components(near_edges(nodes, distance, tile))
    named = nodes.join(root, nodes.rep == root.node, "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    out = rows.filter("doc_id is not null").join(named, "fp").unionByName(rows.filter("doc_id is null").withColumn("component_id", F.lit(None).cast("long")))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
