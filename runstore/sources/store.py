"""A versioned key-value table: puts and deletes go to immutable sorted runs, reads are DataFrames over a snapshot."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codec import frame, frames
from ..model import DELETE, PUT, VERSION, check_key, check_value, op_of, valid_versions
from ..operators.bounds import Bound, in_range, may_hold
from ..operators.files import key_to_files
from ..operators.merge import compacted, drop_tombstones, live, multi_get, newest_per_key
from ..plans.policies import File, Leveled, NoCompaction, Simple, StaleTask, State, Task, Tiered, full_applied, full_task
from .cache import FileCache
from .catalog import Catalog, Conflict, Snapshot
from .files import Files

#: Catalogues of more files are narrowed by the hull of the keys only.
MOST_RANGES = 100_000
#: Up to so many files a batched get opens all, and a read goes through the cache.
FEW_FILES = 16
#: Bytes of a data file that hold no rows: its schema, statistics and offsets.
FOOTER_BYTES = 2 << 10
#: A compaction has more tasks than the session's shuffles if each would otherwise write more than this.
TASK_BYTES = 64 << 20


@dataclass(frozen=True)
class Options:
    target_bytes: int = 2 << 20
    max_buffers: int = 50
    policy: NoCompaction | Simple | Tiered | Leveled = field(default_factory=NoCompaction)
    wal: bool = False
    compression: str = "snappy"
    bloom: bool = True
    cache_bytes: int = 0  # of data files kept in the executors' memory

    @staticmethod
    def small() -> Options:
        return Options()

    @staticmethod
    def two_buffers() -> Options:
        return Options(max_buffers=2)

    @staticmethod
    def compacting(policy: Simple | Tiered | Leveled | NoCompaction) -> Options:
        return Options(target_bytes=1 << 20, max_buffers=2, policy=policy)


class Store:
    """Any number of readers, each over the snapshot it started from. Writers may commit at the same time: the later commit is newer.

    Recency is the commit, then the order inside a batch. Rows keep the seq they were written with; where another writer committed
    first, the file carries how far its rows move up. One writer at a time may use the log (`wal`).
    """

    def __init__(self, spark: SparkSession, path: str, options: Options = Options()) -> None:
        self.spark, self.path, self.options = spark, path.rstrip("/"), options
        self.files = Files(spark, self.path)
        self.catalog = Catalog(self.files)
        self.snapshot = self.catalog.latest(options.policy.initial())
        self.buffers: list[dict[str, tuple[int, str]]] = [{}]  # newest first; the first is written to
        self.sizes = [0]
        self.seq = self.snapshot.next_seq
        self.closed = False
        self.cache = FileCache(options.cache_bytes) if options.cache_bytes else None
        self._log, self._segments = None, 0
        if options.wal:
            self._recover()

    # Writing

    def put(self, key: str, value: str) -> None:
        """Insert or overwrite; an empty value deletes."""
        if self.closed:
            raise RuntimeError("the table is closed")
        check_key(key), check_value(value)
        if self.options.wal:
            self._append(key, value)
        self.buffers[0][key] = (self.seq, value)
        self.seq += 1
        self.sizes[0] += len(key.encode()) + len(value.encode())
        if self.sizes[0] >= self.options.target_bytes:
            self.freeze()
            if len(self.buffers) > self.options.max_buffers:
                self.flush_oldest()

    def put_batch(self, rows: Iterable[tuple[str, str]]) -> None:
        for k, v in rows:
            self.put(k, v)

    def delete(self, key: str) -> None:
        self.put(key, "")

    def freeze(self) -> None:
        """Close the active buffer; an empty one stays."""
        if self.buffers[0]:
            self.buffers.insert(0, {})
            self.sizes.insert(0, 0)

    def flush_oldest(self) -> bool:
        """Write the oldest closed buffer as a run; False if there is none."""
        if len(self.buffers) < 2:
            return False
        rows = [(k, s, DELETE if v == "" else PUT, v) for k, (s, v) in self.buffers[-1].items()]
        self._commit_run(self.spark.createDataFrame(rows, VERSION), {"kind": "flush"})
        self.buffers.pop(), self.sizes.pop()
        if self.options.wal:
            self._rewrite_log()
        return True

    def flush(self) -> None:
        """Freeze, and write every buffer."""
        self.freeze()
        while self.flush_oldest():
            pass

    def close(self) -> None:
        if not self.closed:
            self.flush()
            if self._log is not None:
                self._log.close()
            self.closed = True

    def ingest(self, df: DataFrame, batch_id: int | str | None = None, source: str = "") -> bool:
        """Write a batch (key, value, and seq where rows are ordered) as one run, newer than all before; False if batch_id of this source was written before.

        A seq column orders the batch; without one, the batch's own order (partition, then row) does, and what is left of it shares
        one seq, as each key is left once. Nothing is sorted as a whole.
        """
        self.flush()
        if self._done(batch_id, source):
            return False
        order = F.col("seq") if "seq" in df.columns else F.monotonically_increasing_id()
        rows = valid_versions(df.select("key", "value", order.cast("long").alias("seq")))
        rows = newest_per_key(rows.select("key", "seq", op_of(F.col("value")).alias("op"), "value"))
        rows = rows.withColumn("seq", F.lit(self.seq).cast("long"))  # a key is left once, so its place among other batches is all that counts
        return self._commit_run(rows, {"kind": "ingest", "batch": batch_id}, batch_id, source)

    def _done(self, batch_id: int | str | None, source: str) -> bool:
        done = (self.snapshot.batches or {}).get(source)
        return batch_id is not None and done is not None and int(batch_id) <= done

    def _commit_run(self, rows: DataFrame, action: dict, batch_id: int | str | None = None, source: str = "") -> bool:
        """Write rows as a run and commit it on top of whatever others have committed; False if they committed this batch."""
        written = self._write(rows, self.snapshot.next_id)
        for _ in range(20):
            snap = self.snapshot
            if self._done(batch_id, source):
                for f in written:
                    self.files.delete(f.path)
                return False
            up = max(0, snap.next_seq - min((f.min_seq for f in written), default=snap.next_seq))
            files = [replace(f, id=snap.next_id + i, run=snap.next_id, shift=up, min_seq=f.min_seq + up, max_seq=f.max_seq + up) for i, f in enumerate(written)]
            ids = tuple(f.id for f in files)
            if isinstance(self.options.policy, Tiered):
                levels = (((ids[0], ids),) if ids else ()) + snap.state.levels
                state = replace(snap.state, levels=levels, files={**snap.state.files, **{f.id: f for f in files}})
            else:
                state = replace(snap.state, l0=ids + snap.state.l0, files={**snap.state.files, **{f.id: f for f in files}})
            batches = dict(snap.batches or {}) | ({source: int(batch_id)} if batch_id is not None else {})
            new = replace(snap, state=state, next_id=snap.next_id + len(ids), next_seq=max([snap.next_seq, *[f.max_seq + 1 for f in files]]), batches=batches, gone=())
            try:
                self.snapshot = self.catalog.commit(new, action | {"added": ids}, snap)
                self.seq = max(self.seq, self.snapshot.next_seq)
                return True
            except Conflict:
                self.refresh()
        raise Conflict("too many other writers")

    def _write(self, rows: DataFrame, first_id: int, parts: int | None = None, per_file: int = 0) -> list[File]:
        """Write rows, sorted by key, as files of about target_bytes; returns them in key order.

        Without a number of parts, Spark joins small parts of the shuffle up to target_bytes. A part of more than per_file rows (0: any) makes several files.
        """
        folder = f"{self.path}/runs/run={first_id:05d}-{self.files.jvm.java.util.UUID.randomUUID().toString()[:8]}"
        rows = rows.select("key", "seq", "op", "value")
        out = (rows.repartitionByRange("key") if parts is None else rows.repartitionByRange(parts, "key")).sortWithinPartitions("key")
        writer = out.write.option("compression", self.options.compression).option("maxRecordsPerFile", per_file)
        if self.options.bloom:
            # else a megabyte for any file; the sizes to choose from halve from there, and with fewer of them the least is 64 KB
            writer = writer.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.adaptive.enabled", "true").option("parquet.bloom.filter.candidates.number#key", "16")
        with settings(self.spark, {"spark.sql.adaptive.advisoryPartitionSizeInBytes": str(self.options.target_bytes), "spark.sql.adaptive.coalescePartitions.minPartitionSize": str(min(1 << 20, self.options.target_bytes)), "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}):
            writer.parquet(folder)
        stats = self.spark.read.schema(VERSION).parquet(folder).groupBy(F.col("_metadata.file_path").alias("path")).agg(
            F.max("_metadata.file_size").alias("bytes"), F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.count("*").alias("rows"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"))
        found = sorted(stats.collect(), key=lambda r: r.first_key.encode())  # one row for each file written
        return [File(first_id + i, r.bytes, r.first_key, r.last_key, r.rows, r.max_seq, r.path, first_id, r.min_seq) for i, r in enumerate(found)]

    # Reading

    def refresh(self) -> Snapshot:
        self.snapshot = self.catalog.latest(self.options.policy.initial())
        return self.snapshot

    def at(self, version: int) -> Snapshot:
        return self.catalog.read(version)[0]

    def _unique(self, state: State) -> bool:
        """Whether every key has one version at most: a single sorted level, and nothing above."""
        held = [ids for _, ids in state.levels if ids]
        return not state.l0 and len(held) <= 1

    def versions(self, snapshot: Snapshot | None = None, lower: Bound = Bound(), upper: Bound = Bound()) -> DataFrame:
        """All versions of a range; files outside it are not opened."""
        snap = snapshot or self.snapshot
        parts = self._opened([f for f in snap.state.files.values() if may_hold(lower, upper, f.first_key, f.last_key)])
        rows = [] if snapshot else [(k, s, DELETE if v == "" else PUT, v) for b in self.buffers for k, (s, v) in b.items()]
        if rows or not parts:
            up = max(0, snap.next_seq - min((r[1] for r in rows), default=snap.next_seq))  # what is not committed yet is newest
            parts.append(self.spark.createDataFrame([(k, s + up, op, v) for k, s, op, v in rows], VERSION))
        return reduce(DataFrame.unionByName, parts).filter(in_range(lower, upper))

    def _opened(self, files: list[File]) -> list[DataFrame]:
        """The rows of the files, one scan for each shift (as a rule all have none); up to FEW_FILES of them through the cache, if there is one."""
        if self.cache is not None and len(files) <= FEW_FILES:
            scans_ = [(f.shift, self.cache.read(f.path, f.bytes, self.spark.read.schema(VERSION).parquet)) for f in files]
            return [x.withColumn("seq", F.col("seq") + up) if up else x for up, x in scans_]
        by_shift: dict[int, list[str]] = {}
        for f in files:
            by_shift.setdefault(f.shift, []).append(f.path)
        scans = {up: self.spark.read.schema(VERSION).parquet(*paths) for up, paths in sorted(by_shift.items())}
        return [x.withColumn("seq", F.col("seq") + up) if up else x for up, x in scans.items()]

    def live(self, snapshot: Snapshot | None = None, lower: Bound = Bound(), upper: Bound = Bound()) -> DataFrame:
        snap = snapshot or self.snapshot
        unique = self._unique(snap.state) and (snapshot is not None or not any(self.buffers))
        return live(self.versions(snapshot, lower, upper), unique=unique).select("key", "value")

    def scan(self, lower: Bound = Bound(), upper: Bound = Bound(), snapshot: Snapshot | None = None) -> DataFrame:
        """Live rows in key order, by one shuffle: parts of the key space are merged and sorted by themselves."""
        snap = snapshot or self.snapshot
        unique = self._unique(snap.state) and (snapshot is not None or not any(self.buffers))
        rows = self.versions(snapshot, lower, upper)
        return live(rows if unique else rows.repartitionByRange("key"), unique=unique).select("key", "value").orderBy("key")

    def get(self, key: str) -> str | None:
        for b in self.buffers:
            if key in b:
                return b[key][1] or None
        rows = self.live(lower=Bound.included(check_key(key)), upper=Bound.included(key)).head(1)
        return rows[0].value if rows else None

    def multi_get(self, keys: DataFrame) -> DataFrame:
        """keys (column key) with their values, null where there is none.

        Of a table of more than FEW_FILES files only those are opened whose range holds one of the keys; to ask costs two small jobs.
        """
        some = list(self.snapshot.state.files.values())
        if len(some) > FEW_FILES:
            hull = keys.agg(F.min("key").alias("a"), F.max("key").alias("z")).first()
            some = [f for f in some if hull.a is not None and may_hold(Bound.included(hull.a), Bound.included(hull.z), f.first_key, f.last_key)]
            if 1 < len(some) < MOST_RANGES:
                ranges = self.spark.createDataFrame([(f.id, f.first_key, f.last_key) for f in some], "id long, first_key string, last_key string")
                hit = {r.id for r in key_to_files(keys.select("key"), ranges).select("id").distinct().collect()}  # at most one row a file
                some = [f for f in some if f.id in hit]
        parts = self._opened(some)
        rows = [(k, s, DELETE if v == "" else PUT, v) for b in self.buffers for k, (s, v) in b.items()]
        if rows or not parts:
            up = max(0, self.snapshot.next_seq - min((r[1] for r in rows), default=self.snapshot.next_seq))
            parts.append(self.spark.createDataFrame([(k, s + up, op, v) for k, s, op, v in rows], VERSION))
        unique = self._unique(self.snapshot.state) and not rows
        return multi_get(reduce(DataFrame.unionByName, parts), keys, unique).select("key", "value")

    # Maintenance

    def force_full_compaction(self) -> bool:
        self.flush()
        return self._compact(full_task(self.snapshot.state))

    def trigger_compaction(self) -> bool:
        """One step of the policy; False if it asks for none."""
        task = self.options.policy.task(self.snapshot.state)
        return self._compact(task) if task else False

    def maintain(self, most: int = 100) -> int:
        n = 0
        while n < most and self.trigger_compaction():
            n += 1
        return n

    def trigger_flush(self) -> bool:
        return len(self.buffers) - 1 >= self.options.max_buffers and self.flush_oldest()

    def _compact(self, task: Task) -> bool:
        files = [self.snapshot.state.files[i] for i in task.inputs() if i in self.snapshot.state.files]
        if not files:
            return False
        rows = reduce(DataFrame.unionByName, self._opened(files))
        # a delete may go only if no file outside the task holds older versions
        rest = [i for _, ids in self.snapshot.state.levels for i in ids if i not in set(task.inputs())] if task.kind == "tiered" else []
        bottom = task.bottom and not (task.kind == "tiered" and rest and task.tiers[-1][0] != self.snapshot.state.levels[-1][0])
        # rows of a file by the inputs' bytes a row: versions that the merge drops make fewer files, not smaller ones
        size, n = sum(max(1, f.bytes - FOOTER_BYTES) for f in files), sum(f.rows for f in files)
        parts = min(-(-size // self.options.target_bytes), max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES)))
        out = self._write(compacted(rows, bottom), self.snapshot.next_id, parts, -(-n * self.options.target_bytes // size))
        ids = tuple(f.id for f in out)
        snap = self.snapshot
        state = replace(snap.state, files={**snap.state.files, **{f.id: f for f in out}})
        state = full_applied(state, task, ids, isinstance(self.options.policy, Tiered)) if task.kind == "full" else self.options.policy.applied(state, task, ids)
        used = {*state.l0, *(i for _, x in state.levels for i in x)}
        gone = tuple(f.path for i, f in state.files.items() if i not in used)
        state = replace(state, files={i: f for i, f in state.files.items() if i in used})
        new = replace(snap, state=state, next_id=max([snap.next_id, *[i + 1 for i in ids]]), gone=gone)
        try:
            self.snapshot = self.catalog.commit(new, {"kind": "compaction", "task": task.kind, "inputs": task.inputs(), "output": ids}, snap)
        except Conflict as e:
            for f in out:
                self.files.delete(f.path)
            self.refresh()
            raise StaleTask("another writer came first; the task's output is deleted") from e
        return True

    def vacuum(self, older_than: float = 0.0, keep_versions: int = 1) -> int:
        """Delete all data files that none of the last keep_versions versions needs, those of failed writers too, and that are older than the time stamp.

        Give a time before any running writer began; 0 takes all. Spark lists the files; the driver sees those to delete only.
        """
        needed = [(p,) for p in {p for v in self.catalog.versions()[-keep_versions:] for p in self.at(v).paths()}]
        held = self.files.data_files("runs").withColumn("name", F.substring_index("path", "/runs/", -1))
        names = self.spark.createDataFrame(needed, "path string").select(F.substring_index("path", "/runs/", -1).alias("name"))
        lost = held.join(names, "name", "left_anti").filter(F.lit(not older_than) | (F.col("modified") < older_than))
        n = 0
        for r in lost.select("path").toLocalIterator():
            self.files.delete(r.path)
            n += 1
        return n

    def catalogue(self) -> DataFrame:
        """The files of the snapshot: level, pos, id, bytes, rows, first_key, last_key, max_seq."""
        state = self.snapshot.state
        rows = [(n, pos, i) for n, ids in ((0, state.l0), *state.levels) for pos, i in enumerate(ids)]
        out = [(n, pos, i, f.bytes, f.rows, f.first_key, f.last_key, f.max_seq) for n, pos, i in rows if (f := state.files.get(i))]
        return self.spark.createDataFrame(out, "level int, pos int, id long, bytes long, rows long, first_key string, last_key string, max_seq long")

    # The log of unwritten buffers: segments wal/<n>-<id>.log in order of n, through Spark's file systems, so it lies with the table

    def _append(self, key: str, value: str) -> None:
        if self._log is None:
            self._log = self.files.writer(self._segment())
        self._log.write(bytearray(frame(key, value)))
        self.files.flushed(self._log)

    def _segment(self) -> str:
        self._segments += 1
        return f"wal/{self._segments:010d}-{uuid.uuid4().hex[:8]}.log"

    def sync(self) -> None:
        """All puts so far are safe after this. Stores that can't take part of a file get a file for each call."""
        if self._log is not None and not self.files.flushed(self._log, sync=True):
            self._log.close()
            self._log = None

    def _recover(self) -> None:
        """Rows of all segments, each up to its first damaged frame; they then go to a segment of their own."""
        old = [n for n in self.files.list("wal") if n.endswith(".log")]
        self._segments = max([int(n[:10]) for n in old], default=0)
        for name in old:
            for k, v in frames(self.files.read(f"wal/{name}")):
                self.buffers[0][k] = (self.seq, v)
                self.sizes[0] += len(k.encode()) + len(v.encode())
                self.seq += 1
        if old:
            self._rewrite_log()

    def _rewrite_log(self) -> None:
        """Leave only what is not yet written: in a new segment, before the old ones go."""
        old = [n for n in self.files.list("wal") if n.endswith(".log")]
        if self._log is not None:
            self._log.close()
        self._log = self.files.writer(self._segment())
        for b in reversed(self.buffers):
            for k, (_, v) in sorted(b.items(), key=lambda x: x[1][0]):
                self._log.write(bytearray(frame(k, v)))
        self.sync()
        for name in old:
            self.files.delete(f"wal/{name}")


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings of the session, for a while."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def tombstones(df: DataFrame) -> DataFrame:
    return newest_per_key(df).filter("value = ''")


__all__ = ["Options", "Store", "drop_tombstones", "tombstones"]
