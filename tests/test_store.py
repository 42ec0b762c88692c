import os
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from py4j.protocol import Py4JJavaError

from runstore.operators.bounds import Bound
from runstore.plans.policies import Leveled, Simple, StaleTask, Tiered
from runstore.sources.cache import FileCache
from runstore.sources.catalog import CHECKPOINT, Catalog, Conflict, Corrupt
from runstore.sources.cli import answers
from runstore.sources.store import Options, Store
from runstore.streaming.ingest import into, newest


def rows(df):
    return [(r.key, r.value) for r in df.collect()]


def test_put_get_delete_scan(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    for k, v in ("a1", "b2", "c3", "d4"):
        s.put(k, v)
    assert rows(s.scan(Bound.included("b"), Bound.excluded("d"))) == [("b", "2"), ("c", "3")]
    assert s.get("a") == "1" and s.get("x") is None
    s.freeze()
    s.delete("a")
    assert s.get("a") is None and rows(s.scan(upper=Bound.included("b"))) == [("b", "2")]
    s.flush()
    assert s.get("a") is None and s.get("d") == "4"
    assert len(s.snapshot.state.l0) == 2
    for bad in ("", None):
        with pytest.raises(ValueError):
            s.put(bad, "x")
    with pytest.raises(ValueError):
        s.put("k", None)


def test_empty_flush_commits_nothing(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    s.flush()
    assert s.snapshot.version == -1 and rows(s.scan()) == [] and not s.trigger_compaction() and not s.force_full_compaction()


def test_full_compaction_and_snapshots(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    s.put("a", "alpha"), s.put("b", "beta"), s.flush()
    s.put("b", "beta_v2"), s.delete("a"), s.put("c", "charlie"), s.flush()
    before = s.snapshot
    s.force_full_compaction()
    assert s.snapshot.state.l0 == () and len(s.snapshot.state.level(1)) == 1
    want = [("b", "beta_v2"), ("c", "charlie")]
    assert rows(s.scan()) == rows(s.scan(snapshot=before)) == want
    assert rows(s.scan(snapshot=s.at(0))) == [("a", "alpha"), ("b", "beta")]
    assert "Exchange" not in s.live()._jdf.queryExecution().executedPlan().toString()
    assert s.vacuum() == 2
    assert rows(s.scan()) == want


def test_reopening_many_times(spark, tmp_path):
    want = {}
    for turn in range(4):
        s = Store(spark, str(tmp_path), Options(wal=True))
        assert dict(rows(s.scan())) == want
        s.put(f"k{turn}", str(turn)), s.put("all", str(turn))
        want |= {f"k{turn}": str(turn), "all": str(turn)}
        if turn == 1:
            s.sync()  # and no close: the log holds the rows
        else:
            s.close()


def test_log_recovery_after_damage(spark, tmp_path):
    s = Store(spark, str(tmp_path), Options(wal=True))
    for i in range(50):
        s.put(f"crash_key_{i:02d}", "v")
    s.sync()
    with open(next((tmp_path / "wal").glob("*.log")), "r+b") as f:
        f.seek(-3, 2)
        f.write(b"\x7f\x7f\x7f")
    again = Store(spark, str(tmp_path), Options(wal=True))
    assert len(rows(again.scan())) == 49
    again.put("crash_key_49", "w"), again.sync()
    assert Store(spark, str(tmp_path), Options(wal=True)).get("crash_key_49") == "w"


def test_corrupt_or_contested_log(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    s.put("a", "1"), s.flush()
    with pytest.raises(Conflict):
        Catalog(s.files).commit(Store(spark, str(tmp_path)).at(0).__class__(), {})
    other = Store(spark, str(tmp_path))
    other.put("b", "2"), other.flush()
    s.put("c", "3"), s.flush()  # commits on top of the other writer's version
    assert [k for k, _ in rows(s.scan())] == ["a", "b", "c"]
    other.put("d", "4"), other.flush() if other.refresh() else None
    with pytest.raises(StaleTask):
        s.force_full_compaction()
    name = sorted((tmp_path / "log").glob("*.json"))[-1]
    name.write_bytes(name.read_bytes()[:10] + b"\x7f" + name.read_bytes()[11:])
    (tmp_path / "log" / f".{name.name}.crc").unlink(missing_ok=True)
    with pytest.raises(Corrupt, match="mismatch"):
        Store(spark, str(tmp_path))


def test_lifecycle_of_a_thousand(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    want = {}
    for i in range(1000):
        s.put(f"key_{i:04d}", f"val_{i:04d}")
        want[f"key_{i:04d}"] = f"val_{i:04d}"
        if i % 200 == 199:
            s.freeze()
    for i in range(100, 200):
        s.put(f"key_{i:04d}", f"val_new_{i:04d}")
        want[f"key_{i:04d}"] = f"val_new_{i:04d}"
    for i in range(500, 550):
        s.delete(f"key_{i:04d}")
        del want[f"key_{i:04d}"]
    assert len(want) == 950
    assert dict(rows(s.scan())) == want
    s.close()
    s = Store(spark, str(tmp_path))
    assert dict(rows(s.scan())) == want
    s.force_full_compaction()
    assert dict(rows(Store(spark, str(tmp_path)).scan())) == want


@pytest.mark.parametrize("policy", [Simple(200, 2, 3), Tiered(3, 200, 1, 2), Leveled(4, 2, 3, 3_000), Tiered(2, 10_000, 10_000, 2, 2)])
def test_any_history_equals_a_dict(spark, tmp_path, policy):
    rng, s, want = random.Random(3), Store(spark, str(tmp_path), Options(policy=policy, target_bytes=2_000)), {}
    for _ in range(5):
        for _ in range(40):
            k = f"k{rng.randrange(60):03d}"
            if rng.random() < 0.3:
                s.delete(k)
                want.pop(k, None)
            else:
                v = str(rng.randrange(1000))
                s.put(k, v)
                want[k] = v
        s.flush()
        if rng.random() < 0.6:
            s.trigger_compaction()
        if rng.random() < 0.3:
            s = Store(spark, str(tmp_path), s.options)
    assert dict(rows(s.scan())) == want
    s.maintain(6)
    assert dict(rows(s.scan())) == want
    keys = spark.createDataFrame([(f"k{i:03d}",) for i in range(0, 70, 7)], "key string")
    assert dict(rows(s.multi_get(keys))) == {f"k{i:03d}": want.get(f"k{i:03d}") for i in range(0, 70, 7)}


def test_ingest_is_idempotent_and_prunes(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    df = spark.range(1000).selectExpr("format_string('k%04d', id) key", "cast(id as string) value", "id seq")
    assert s.ingest(df, 0) and not s.ingest(df, 0)
    assert s.ingest(spark.createDataFrame([("k0001", "x"), ("k0001", "y"), ("k0002", "")], "key string, value string").coalesce(1), 1)
    assert s.get("k0001") == "y" and s.get("k0002") is None and s.live().count() == 999
    one = s.versions(lower=Bound.included("k0500"), upper=Bound.included("k0500"))
    assert len(one.inputFiles()) < len(s.versions().inputFiles())


def test_streaming(spark, tmp_path):
    src = str(tmp_path / "in")
    s = Store(spark, str(tmp_path / "table"))
    for turn in range(3):
        spark.range(turn * 10, turn * 10 + 20).selectExpr("format_string('k%03d', id) key", f"'{turn}' value", "id seq").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("key string, value string, seq long").parquet(src)
        into(s, stream, str(tmp_path / "ck")).awaitTermination()
    want = {f"k{i:03d}": str(min(2, i // 10)) for i in range(40)}
    assert dict(rows(s.scan())) == want and s.snapshot.batches == {"stream": 2}
    q = newest(spark.readStream.schema("key string, value string, seq long").parquet(src)).writeStream.outputMode("update").format("memory").queryName("newest_").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("newest_").count() == 40


def test_prompt(spark, tmp_path):
    lines = ["get a", f"open {tmp_path}", "put k1 val1", "put k2 val2", "get k1", "get k2", "get k3", "scan * *", "scan k2 *", "delete k1", "flush", "compact", "get k1", "put x", "what", "quit", "get k2"]
    want = ["no table is open", "OK", "OK", "OK", "val1", "val2", "(not found)", "k1 val1", "k2 val2", "OK", "k2 val2", "OK", "OK", "OK", "OK", "(not found)", "usage: put <key> <value>", "unknown command: what"]
    assert list(answers(spark, lines)) == want


def batch(spark, n, value):
    return spark.createDataFrame([("a", value, n)], "key string, value string, seq long")


def test_large_sequence_numbers(spark, tmp_path):
    """Nanosecond stamps order a batch and are not added up from batch to batch."""
    s = Store(spark, str(tmp_path))
    for n in range(8):
        s.ingest(spark.createDataFrame([("a", f"old{n}", 1_700_000_000_000_000_000 + n), ("a", f"new{n}", (1 << 63) - 2)], "key string, value string, seq long"), n)
    assert s.get("a") == "new7" and s.snapshot.next_seq < 100


def test_the_later_commit_wins(spark, tmp_path):
    """Two writers from one version: what commits second is newer, whoever wrote it first."""
    one, two = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    for n in range(4):
        one.ingest(batch(spark, n, f"old{n}"))
    two.ingest(batch(spark, 0, "new"))
    fresh = Store(spark, str(tmp_path))
    assert fresh.get("a") == "new" and dict(rows(fresh.scan())) == {"a": "new"} and rows(fresh.multi_get(batch(spark, 0, "").select("key"))) == [("a", "new")]
    one.refresh()
    one.ingest(batch(spark, 0, "newest"))
    fresh.refresh()
    assert fresh.get("a") == "newest"
    fresh.force_full_compaction()
    assert fresh.get("a") == "newest" and all(f.shift == 0 for f in fresh.snapshot.state.files.values())
    two.put("a", "buffered")
    two.refresh()
    assert two.get("a") == "buffered" and dict(rows(two.scan())) == {"a": "buffered"}
    two.flush()
    assert Store(spark, str(tmp_path)).get("a") == "buffered"


def test_batches_of_two_sources(spark, tmp_path):
    one, two = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    assert one.ingest(batch(spark, 0, "x"), 1, "A") and two.ingest(batch(spark, 0, "y"), 1, "B")
    assert Store(spark, str(tmp_path)).snapshot.batches == {"A": 1, "B": 1}
    late = Store(spark, str(tmp_path))
    late.snapshot = late.at(0)  # as if it had opened before B's batch, whose replay it is given
    assert not late.ingest(batch(spark, 0, "y"), 1, "B") and not late.ingest(batch(spark, 0, "x"), 1, "A")
    assert len(Store(spark, str(tmp_path)).snapshot.state.l0) == 2


def test_writers_at_the_same_time(spark, tmp_path):
    def work(name):
        s = Store(spark, str(tmp_path))
        for n in range(3):
            s.ingest(spark.createDataFrame([(f"{name}{n}", "v", 0)], "key string, value string, seq long"), n, name)

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(work, "abcd"))
    s = Store(spark, str(tmp_path))
    assert sorted(k for k, _ in rows(s.scan())) == [f"{x}{n}" for x in "abcd" for n in range(3)]
    assert s.snapshot.batches == dict.fromkeys("abcd", 2) and s.snapshot.version == 11


def test_a_dead_writer_stops_nobody(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    s.ingest(batch(spark, 0, "1"))
    (tmp_path / "log" / f"{1:020d}.json.claim").touch()
    (tmp_path / "log" / f"{1:020d}.json.x.tmp").write_text("half")
    s.ingest(batch(spark, 0, "2"))
    assert Store(spark, str(tmp_path)).get("a") == "2"
    (tmp_path / "log").chmod(0o500)
    try:
        if not os.access(tmp_path / "log", os.W_OK):  # root may write anyway
            with pytest.raises(Py4JJavaError):
                s.ingest(batch(spark, 0, "3"))
    finally:
        (tmp_path / "log").chmod(0o700)


def test_the_log_lies_with_the_table(spark, tmp_path, monkeypatch):
    """A table path with a scheme: nothing is written to the working directory."""
    monkeypatch.chdir(tmp_path)
    s = Store(spark, f"file://{tmp_path}/t", Options(wal=True))
    s.put("k", "v"), s.sync()
    assert [p.name for p in tmp_path.iterdir()] == ["t"] and list((tmp_path / "t" / "wal").glob("*.log"))
    assert Store(spark, f"file://{tmp_path}/t", Options(wal=True)).get("k") == "v"
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    hadoop.set("fs.viewfs.mounttable.logs.link./t", f"file://{tmp_path}/far")
    (tmp_path / "far").mkdir()
    s = Store(spark, "viewfs://logs/t", Options(wal=True))
    s.put("k", "1"), s.sync(), s.put("l", "2"), s.sync()
    assert Store(spark, "viewfs://logs/t", Options(wal=True)).get("l") == "2"
    s.close()
    assert dict(rows(Store(spark, "viewfs://logs/t").scan())) == {"k": "1", "l": "2"}


def test_vacuum_finds_orphans(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    s.ingest(batch(spark, 0, "1")), s.ingest(batch(spark, 0, "2"))
    s._write(s.versions(), 99)  # a writer that died before its commit
    s.force_full_compaction()
    held = lambda: {str(p) for p in (tmp_path / "runs").rglob("*.parquet")}
    assert len(held()) == 4 and s.vacuum(older_than=1.0) == 0
    assert s.vacuum() == 3 and {p.removeprefix("file:") for p in s.snapshot.paths()} == held()
    assert s.get("a") == "2"


def test_log_of_changes(spark, tmp_path):
    """Versions hold what they change; any of them can be read."""
    s = Store(spark, str(tmp_path))
    for n in range(CHECKPOINT + 3):
        s.ingest(batch(spark, 0, str(n)))
    sizes = [p.stat().st_size for p in sorted((tmp_path / "log").glob("*.json"))]
    assert sizes[CHECKPOINT] > 4 * sizes[CHECKPOINT - 1] and max(sizes[:CHECKPOINT]) < 2 * min(sizes[:CHECKPOINT])
    for v in (0, 5, CHECKPOINT, CHECKPOINT + 2):
        assert rows(s.live(snapshot=s.at(v))) == [("a", str(v))]
    assert s.at(CHECKPOINT + 2).state == s.snapshot.state


def test_runs_trigger_not_files(spark, tmp_path):
    s = Store(spark, str(tmp_path), Options(policy=Leveled(4, 2, 3, 1 << 20), target_bytes=4_000))
    many = spark.range(4000).selectExpr("format_string('k%05d', id) key", "sha2(cast(id as string), 256) value", "id seq")
    s.ingest(many.repartition(16))
    assert len(s.snapshot.state.l0) > 2 and s.snapshot.state.runs() == 1 and not s.trigger_compaction()
    s.ingest(many)
    assert s.trigger_compaction() and s.snapshot.state.l0 == ()
    one = Store(spark, str(tmp_path / "one"))
    one.ingest(many.repartition(16))
    assert len(one.snapshot.state.l0) == 1  # small parts are joined up to target_bytes


def test_compaction_keeps_the_size_of_files(spark, tmp_path):
    """Neither what each file holds besides its rows nor versions that a merge drops make for more and smaller files."""
    target = 16 << 10
    s = Store(spark, str(tmp_path), Options(policy=Simple(200, 2, 3), target_bytes=target))
    for n in range(4):
        s.ingest(spark.range(1500).selectExpr("format_string('k%05d', id) key", f"sha2('{n}-' || id, 256) value", "id seq"))
    before = len(s.snapshot.state.files)
    assert s.maintain() == 3
    files = [s.snapshot.state.files[i] for i in s.snapshot.state.level(3)]
    assert len(files) == len(s.snapshot.state.files) < before and sum(f.rows for f in files) == 1500
    assert max(f.bytes for f in files) < 1.5 * target and sum(f.bytes for f in files) > 0.4 * target * len(files)
    got = rows(s.scan())
    assert len(got) == 1500 and got == [(r.key, r.v) for r in spark.range(1500).selectExpr("format_string('k%05d', id) key", "sha2('3-' || id, 256) v").orderBy("key").collect()]
    small = Store(spark, str(tmp_path / "small"))
    small.put("k", "v"), small.flush()
    assert next(iter(small.snapshot.state.files.values())).bytes < 4 << 10  # its filter is sized to its rows


def test_scan_and_get_plans(spark, tmp_path):
    s = Store(spark, str(tmp_path), Options(target_bytes=8_000))
    for n in range(4):
        s.ingest(spark.range(n * 100, n * 100 + 3000).selectExpr("format_string('k%05d', id) key", f"'{n}' || sha2(cast(id as string), 256) value", "id seq"))
    plan = s.scan()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "rangepartitioning" in plan
    got = rows(s.scan())
    assert got == sorted(got) and len(got) == 3300 and len(s.snapshot.state.files) > 16
    keys = spark.createDataFrame([("k00001",), ("k00001x",), ("zzz",)], "key string")
    out = s.multi_get(keys)
    assert {k: v and v[0] for k, v in rows(out)} == {"k00001": "0", "k00001x": None, "zzz": None}
    assert len(out.inputFiles()) < len(s.versions().inputFiles()) / 2
    assert rows(s.multi_get(keys.limit(0))) == []


def test_cache_lets_the_least_recently_used_go(spark):
    cache, loads = FileCache(100), []

    def load(path):
        loads.append(path)
        return spark.range(3).withColumnRenamed("id", path)

    for path, size in (("a", 40), ("b", 40), ("a", 40), ("c", 40)):
        assert cache.read(path, size, load).columns == [path]
    assert loads == ["a", "b", "c"] and "b" not in cache and "a" in cache and (len(cache), cache.bytes, cache.hits, cache.misses) == (2, 80, 1, 3)
    assert not cache.read("large", 101, load).is_cached and len(cache) == 2
    cache.insert("a", load("a2"), 60)
    assert cache.get("a").columns == ["a2"] and cache.bytes == 100 and cache.get("b") is None
    cache.insert("d", load("d"), 41)
    assert "c" not in cache and "a" not in cache and cache.get("d").is_cached


def test_reads_through_the_cache(spark, tmp_path):
    s = Store(spark, str(tmp_path), Options(cache_bytes=1 << 20))
    for n in range(3):
        s.ingest(batch(spark, 0, str(n)))
    assert s.get("a") == "2" and s.cache.misses == 3 and rows(s.scan()) == [("a", "2")] and s.cache.hits == 3
    assert "InMemoryTableScan" in s.live()._jdf.queryExecution().executedPlan().toString()
    s.force_full_compaction()
    assert rows(s.scan()) == [("a", "2")] and s.get("a") == "2"
