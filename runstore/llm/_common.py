"""Helpers shared by the corpus operators: stored tables, word hashes, Arrow batches."""

from __future__ import annotations

import atexit
import pickle
import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession

# Functions of this package travel to the executors by value, so that these need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__.rpartition(".")[0]])

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: list[tuple[SparkSession, str]] = []
_scopes: ContextVar[tuple[list[tuple[SparkSession, str]], ...]] = ContextVar("scopes", default=())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or in local mode a temporary folder where it is unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if path is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            path = tempfile.mkdtemp(prefix="corpus-")
        sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def stored(df: DataFrame, keep: bool = False, tidy: bool = False) -> DataFrame:
    """Write df once as Parquet into the shared folder and read it back: lineage is cut, and lost executors cost nothing that was written.

    The table is deleted at the end of the innermost `passing` block (keep: of the one around it), or else when the driver ends.
    tidy: the shuffle files of the write go as it ends, not once the driver collects garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    if tidy:
        spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if tidy:
            spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    scopes = _scopes.get()
    outer = scopes[:-1] if keep else scopes
    (outer[-1] if outer else _written).append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def passing() -> Iterator[None]:
    """Tables stored inside are needed inside only."""
    token = _scopes.set((*_scopes.get(), []))
    try:
        yield
    finally:
        mine = _scopes.get()[-1]
        _scopes.reset(token)
        for spark, path in mine:
            _deleted(spark, path)


def _deleted(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _deleted(spark, path)
        except Exception:  # noqa: BLE001  the JVM has gone, or the cluster cleans the folder itself
            return


class Shared:
    """A broadcast of any object of this package: its class travels by value, too."""

    def __init__(self, spark: SparkSession, value: object) -> None:
        self._sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @cached_property
    def value(self):
        return pickle.loads(self._sent.value)


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with about `most` characters of text each; null texts come as empty ones."""
    for batch in batches:
        texts = batch.column(text)
        begin, held = 0, 0
        part: list[str] = []
        for i in range(batch.num_rows):
            part.append(texts[i].as_py() or "")
            held += len(part[-1])
            if held >= most:
                yield batch.slice(begin, i + 1 - begin), part
                begin, held, part = i + 1, 0, []
        if part:
            yield batch.slice(begin), part


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_BASE = 0x5851F42D4C957F2D
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE**i and its inverse modulo 2**64 for all i < n."""
    size = 1 << max(20, (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.ones(1, np.uint64)
            while len(p) < size:
                p = np.concatenate([p, p * np.uint64(pow(base, len(p), 1 << 64))])
            out.append(p)
        _powers[size] = (out[0], out[1])
    p, q = _powers[size]
    return p[:n], q[:n]


_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def runs_of_words(data: np.ndarray, inside: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of bytes that `inside` allows, and the index of the text it lies in; sizes: bytes of each text, with one that parts it from the next."""
    if not len(data):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    held = inside[data]
    edge = np.flatnonzero(np.diff(held, prepend=False, append=False))
    begin, end = edge[::2], edge[1::2]
    p, q = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(np.where(held, data.astype(np.uint64) + np.uint64(1), np.uint64(0)) * p[:-1], out=total[1:])
    return mix64((total[end] - total[begin]) * q[begin]), np.searchsorted(np.cumsum(sizes), begin, side="right")


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of the lower-cased texts, and the text's index: words are runs of letters, digits and non-ASCII characters."""
    data = [t.lower().encode(errors="replace") for t in texts]
    return runs_of_words(np.frombuffer(b" ".join([*data, b""]), np.uint8), _WORD, [len(d) + 1 for d in data])


def grams(word: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place on; 0 where the text ends before."""
    m = len(word) - n + 1
    if m <= 0:
        return np.zeros(len(word), np.uint64)
    total = np.zeros(m, np.uint64)
    for k in range(n):
        total = total * np.uint64(_BASE) + word[k : k + m]
    total = mix64(total)
    total[owner[:m] != owner[n - 1 :]] = 0
    return np.concatenate([total, np.zeros(n - 1, np.uint64)])


def sliding(x: np.ndarray, width: int, pick: np.ufunc, fill: int) -> np.ndarray:
    """pick (minimum or maximum) over each `width` neighbours of x, in two scans of blocks."""
    n = len(x)
    if n < width:
        return x[:0]
    full = np.full(-(-n // width) * width, fill, x.dtype)
    full[:n] = x
    block = full.reshape(-1, width)
    ahead = pick.accumulate(block, axis=1).ravel()
    back = pick.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(back[: n - width + 1], ahead[width - 1 : n])


def minimizers(v: np.ndarray, valid: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places that hold the least value of some valid window, and the first and last such window of each.

    Window s is v[s : s + width], and all v > 0. Places with the same value all count, so that equal texts choose alike.
    """
    least = sliding(v, width, np.minimum, np.iinfo(np.uint64).max)
    if not len(least):
        none = np.zeros(0, np.int64)
        return none, none, none
    edge = np.zeros(width - 1, np.uint64)
    least = np.where(valid[: len(least)], least, 0)
    place = np.flatnonzero(sliding(np.concatenate([edge, least, edge]), width, np.maximum, 0) == v)
    # the windows of a place are neighbours: among the runs of equal least values near it, one has its value
    begin = np.flatnonzero(np.diff(least, prepend=least[0] + np.uint64(1)))
    value, end = least[begin], np.append(begin[1:], len(least)) - 1
    run = np.searchsorted(end, place - (width - 1))
    open_ = np.flatnonzero(value[run] != v[place])
    while len(open_):
        run[open_] += 1
        open_ = open_[value[run[open_]] != v[place[open_]]]
    return place, np.maximum(begin[run], place - (width - 1)), np.minimum(end[run], place)


def grouped(batches: Iterator[pa.RecordBatch], keys: int, least: int = 65536) -> Iterator[list[np.ndarray]]:
    """Integer columns of sorted batches, dealt anew so that rows with equal leading `keys` columns stay together."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        if sum(len(x[0]) for x in held) < least:
            continue
        rows = [np.concatenate(c) for c in zip(*held, strict=True)]
        same = np.logical_and.reduce([c == c[-1] for c in rows[:keys]])
        cut = 0 if same.all() else len(same) - int(np.argmin(same[::-1]))
        if cut:
            yield [c[:cut] for c in rows]
        held = [[c[cut:] for c in rows]]
    if held and len(held[0][0]):
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def bit_map(rids: DataFrame) -> Broadcast:
    """A bit map of row keys (the first column), made by the tasks: 8 bits a key, 16 MB at most; it never misses a key."""
    bits = min(27, max(16, int(rids.count() * 8).bit_length()))
    width = min((1 << bits) // 8, 8192)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << bits, bool)
        for batch in batches:
            held[batch.column(0).to_numpy(zero_copy_only=False) & ((1 << bits) - 1)] = True
        rows = np.packbits(held).reshape(-1, width)
        part = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([rows[i].tobytes() for i in part], pa.binary())], names=["part", "bits"])

    out = np.zeros(((1 << bits) // 8 // width, width), np.uint8)
    for r in rids.mapInArrow(run, "part long, bits binary").toLocalIterator():
        out[r.part] |= np.frombuffer(r.bits, np.uint8)
    return rids.sparkSession.sparkContext.broadcast((bits, out.ravel()))


def in_bit_map(held: tuple[int, np.ndarray], rids: pa.Array) -> pa.Array:
    bits, packed = held
    at = rids.to_numpy(zero_copy_only=False) & ((1 << bits) - 1)
    return pa.array((packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool))
