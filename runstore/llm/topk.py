"""Exact top-k by inner product: KD-trees per shard, searched best first.

Every Arrow batch of vectors is a shard: median splits on the widest axis down to leaves of `leaf` vectors, with a tight box
at each node. No vector of a box scores more than sum(max(q * low, q * high)), so a query opens nodes by falling bound and stops
when the bound lies below its kth best score so far. That kth score goes from shard to shard of a task, and starts from the kth
best over one bounded sample of the vectors, which is a valid floor. The scaled vectors and the queries are stored once. Queries come in
blocks of `block` rows, and `block_bytes` bytes at most; only a block goes to the executors. Each task leaves at most k rows per query; a ranking per query merges them.

Nulls and edges: rows with a null id, a null vector, or null or non-finite components take no part, neither as queries nor as
candidates; vectors meet only vectors of their length; a row is its query's own if it has its id; if an id has several
vectors, the least one is the query, all are candidates of others, and the id's best score counts; ties go to the smaller id;
fewer than k candidates are all returned; other columns, whatever their names, are ignored; an empty table gives an empty result.
Scores are exact integers (doubles where all sums stay below 2 ** 53, then 64 bits, then Python's); one beyond 64 bits is given as
the largest or smallest that fits.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ._common import stored

OUT = "query_id long, vec_id long, score long"


def scaled(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id, v: floor(scale * x) of each component, for the rows that take part."""
    x = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v")).filter("vec_id is not null and v is not null")
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return x.filter(~bad).select("vec_id", F.transform("v", lambda c: F.floor(c * scale)).alias("v"))


class Tree:
    """Nodes in an array: box, and either two children or a range of rows."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf: int) -> None:
        order = np.argsort(ids, kind="stable")
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.kids: list[tuple[int, int]] = []
        self.part: list[np.ndarray] = []
        todo = [(order, -1, 0)]
        while todo:
            mine, parent, side = todo.pop()
            me = len(self.kids)
            x = rows[mine]
            low, high = x.min(axis=0), x.max(axis=0)
            self.low.append(low)
            self.high.append(high)
            self.kids.append((-1, -1))
            self.part.append(mine)
            if parent >= 0:
                a, b = self.kids[parent]
                self.kids[parent] = (me, b) if side == 0 else (a, me)
            if len(mine) > leaf and (high > low).any():
                axis = int((high - low).argmax())
                half = np.argpartition(x[:, axis], len(mine) // 2)
                self.part[me] = mine[:0]
                todo += [(np.sort(mine[half[len(mine) // 2 :]]), me, 1), (np.sort(mine[half[: len(mine) // 2]]), me, 0)]
        self.ids, self.rows = ids, rows
        self.box_low, self.box_high = np.array(self.low), np.array(self.high)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Most that any vector of each node can score with each query."""
        return np.maximum(q, 0) @ self.box_high.T + np.minimum(q, 0) @ self.box_low.T

    def search(self, q: np.ndarray, own: int, bound: np.ndarray, best: list[tuple[int, int]], floor: int, k: int) -> None:
        """Push (score, -id) of better vectors onto the heap `best`. floor: scores below it can't be among the k."""
        heap = [(-bound[0], 0)]
        while heap:
            top, node = heapq.heappop(heap)
            if -top < (max(floor, best[0][0]) if len(best) >= k else floor):
                return
            a, b = self.kids[node]
            if a >= 0:
                heapq.heappush(heap, (-bound[a], a))
                heapq.heappush(heap, (-bound[b], b))
                continue
            part = self.part[node]
            score = self.rows[part] @ q
            low = max(floor, best[0][0]) if len(best) >= k else floor
            some = np.flatnonzero(score >= low)
            if len(some) > k:  # an id's best row stands for all of them
                some = some[np.lexsort((-score[some], self.ids[part[some]]))]
                some = some[np.diff(self.ids[part[some]], prepend=self.ids[part[some[0]]] - 1) != 0]
            if len(some) > k:  # those below the kth best of the leaf can't count, but for the query's own row
                some = some[score[some] >= np.partition(score[some], -k - 1)[-k - 1]]
            for i in some.tolist():
                vec_id = int(self.ids[part[i]])
                if vec_id == own:
                    continue
                x = (int(score[i]), -vec_id)
                twin = next((y for y in best if y[1] == x[1]), None)
                if twin:
                    if x > twin:
                        best.remove(twin)
                        best.append(x)
                        heapq.heapify(best)
                elif len(best) < k:
                    heapq.heappush(best, x)
                elif x > best[0]:
                    heapq.heapreplace(best, x)


def batches_of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and rows of the batch, by vector length."""
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    v = batch.column(1)
    size = np.diff(v.offsets.to_numpy())
    flat = v.flatten().to_numpy(zero_copy_only=False)
    start = np.concatenate([[0], np.cumsum(size)])
    for d in np.unique(size[size > 0]):
        some = np.flatnonzero(size == d)
        yield ids[some], flat[start[some][:, None] + np.arange(d)]


def exact(x: np.ndarray, largest: int) -> np.ndarray:
    """As doubles, whose products are fast, where no sum can pass 2 ** 53; as Python integers where one can pass 64 bits."""
    most = x.shape[1] * largest * max(1, max((abs(int(v)) for v in (x.min(initial=0), x.max(initial=0)))))
    return x.astype(np.float64) if most < 1 << 53 else x.astype(np.int64) if most < 1 << 62 else x.astype(object)


def widest(x: np.ndarray) -> int:
    return max(1, abs(int(x.min(initial=0))), abs(int(x.max(initial=0))))


def top_k(vectors: DataFrame, queries: Column, *, k: int = 10, scale: int = 1024, leaf: int = 128, block: int = 8192, block_bytes: int = 64 << 20, sample: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: the k best vectors for each row of vectors that the condition `queries` (on vec_id) selects."""
    spark = vectors.sparkSession
    rows = stored(scaled(vectors, scale))
    asked = stored(rows.filter(queries).groupBy("vec_id").agg(F.min("v").alias("v")))
    n, width = asked.agg(F.count("*"), F.max(F.size("v"))).first()
    block = max(1, min(block, block_bytes // (8 * max(1, width or 0))))
    out = spark.createDataFrame([], OUT)
    first = [(r.vec_id, r.v) for r in rows.limit(sample).collect()] if n else []
    parts = -(-n // block)
    for j in range(parts):
        mine = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == j) if parts > 1 else asked
        held = [(r.vec_id, np.array(r.v, np.int64)) for r in mine.toLocalIterator()]
        by_size: dict[int, tuple] = {}
        for d in {len(q) for _, q in held} - {0}:
            ids = np.array([i for i, q in held if len(q) == d])
            qs = np.stack([q for _, q in held if len(q) == d])
            best_of: dict[int, list[int]] = {}
            for i, v in first:  # one row for each id, so that k rows are k ids
                if len(v) == d:
                    best_of.setdefault(i, v)
            floor = np.full(len(ids), np.iinfo(np.int64).min)
            if len(best_of) > k:
                at, sv = np.array(list(best_of)), np.array(list(best_of.values()), np.int64)
                q, w = exact(qs, widest(sv)), exact(sv, widest(qs))
                if q.dtype == w.dtype and q.dtype != object:  # else no floor is given
                    score = (q @ w.T).astype(np.int64)
                    score[ids[:, None] == at] = np.iinfo(np.int64).min
                    floor = np.partition(score, -k, axis=1)[:, -k]
            by_size[d] = (ids, qs, floor)
        out = out.union(_searched(rows, spark.sparkContext.broadcast(by_size), k, leaf))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = out.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _searched(rows: DataFrame, shared, k: int, leaf: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[tuple[int, int]]] = {}
        for batch in batches:
            for ids, x in batches_of(batch):
                if x.shape[1] not in shared.value:
                    continue
                own, qs, floor = shared.value[x.shape[1]]
                x = exact(x, widest(qs))
                q = qs.astype(x.dtype)
                tree = Tree(ids, x, leaf)
                for i in range(0, len(q), 512):
                    bound = tree.bounds(q[i : i + 512])
                    for r in range(len(bound)):
                        at = i + r
                        tree.search(q[at], int(own[at]), bound[r], found.setdefault(int(own[at]), []), int(floor[at]), k)
        out = [(i, -v, min(max(s, -(1 << 63)), (1 << 63) - 1)) for i, best in found.items() for s, v in best]
        cols = zip(*out, strict=True) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])

    return rows.mapInArrow(run, OUT)


ORACLE = """
WITH r AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 e AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM r),
 s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score FROM e q JOIN e c ON q.i = c.i AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0 GROUP BY ALL),
 k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM k WHERE rank <= 10
"""
