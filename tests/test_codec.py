import os
import random
import struct
import zlib

from pyspark.sql import functions as F

from runstore.functions import codec
from runstore.operators import bloom
from runstore.plans import catalogue
from runstore.sources.wal import read_log


def test_big_endian(spark):
    r = spark.range(1).select(codec.be_hex(F.lit(0x1234), 2).alias("a"), codec.be_hex(F.lit(0xAABBCCDD), 4).alias("b"), codec.be_hex(F.lit(0x1122334455667788), 8).alias("c")).first()
    assert (r.a, r.b, r.c) == ("1234", "AABBCCDD", "1122334455667788")
    assert spark.range(1).select(codec.from_be_hex(F.lit("1122334455667788"))).first()[0] == 0x1122334455667788
    assert spark.range(1).select(codec.crc(F.lit("123456789"))).first()[0] == 0xCBF43926


def test_lcp(spark):
    pairs = [("abc", "abd"), ("", "a"), ("same", "same"), ("é", "è"), ("x", "y")]
    got = spark.createDataFrame(pairs, "a string, b string").select(codec.lcp(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [codec.shared_prefix(a.encode(), b.encode()) for a, b in pairs] == [2, 0, 4, 1, 0]


def test_prefix_block():
    block = codec.Block([(b"aaaa", b"v1"), (b"aaab", b"v2"), (b"aaac", b"v3")])
    data = block.encode()
    assert struct.unpack(">H", data[-2:])[0] == 3
    assert struct.unpack(">3H", data[-8:-2])[:2] == (0, 12)
    assert data[12:16] == struct.pack(">HH", 3, 1)
    assert codec.Block.decode(data).entries == block.entries


def test_block_seek():
    block = codec.Block([(w, b"") for w in (b"apple", b"banana", b"cat", b"dog")])
    assert [block.seek(k) for k in (b"ball", b"dog", b"zebra")] == [1, 3, 4]


def test_packing_round_trip():
    entries = [(f"prefix_common_key_{i:03d}".encode(), b"" if i == 15 else f"value_content_{i:03d}".encode()) for i in range(60)]
    for size in (32, 256, 4096):
        blocks = codec.packed(entries, size)
        assert [e for b in blocks for e in codec.Block.decode(b.encode()).entries] == entries
        assert all(len(b.encode()) <= size or len(b.entries) == 1 for b in blocks)
    assert len(codec.packed(entries, 32)) > 1


def test_crc_rows_against_zlib(spark, sf_dir):
    want = {(r.key, r.seq): zlib.crc32(f"{r.key}\0{r.value}".encode()) for r in catalogue.kv(spark, sf_dir).collect()}
    assert {(r.key, r.seq): r.crc for r in catalogue.crc32_rows(spark, sf_dir).collect()} == want


def test_block_packing_against_a_fold(spark, sf_dir):
    """Entries of a nation in order; a block is closed where the next entry, with its whole key, could pass 256 bytes."""
    held = {}
    for r in sorted(spark.read.parquet(f"{sf_dir}/supplier.parquet").collect(), key=lambda r: r.s_name):
        blocks = held.setdefault(r.s_nationkey, [])
        size = len(r.s_name) + len(str(r.s_suppkey)) + 6
        if not blocks or blocks[-1]["bytes"] + size > 256:
            blocks.append({"first": r.s_name, "entries": 0, "bytes": 2})
        b = blocks[-1]
        same = len(os.path.commonprefix([b["first"], r.s_name])) if b["entries"] else 0
        b["entries"] += 1
        b["bytes"] += size - same + 2
    want = {(n, i): (b["entries"], b["bytes"], b["first"]) for n, blocks in held.items() for i, b in enumerate(blocks)}
    assert {(r.nation, r.block): (r.entries, r.bytes, r.first_key) for r in catalogue.block_packing(spark, sf_dir).collect()} == want


def test_bloom(spark):
    keys = spark.range(10_000).select(F.format_string("key_%d", "id").alias("key"))
    bits, probes = bloom.shape(10_000, 0.01)
    assert (bits % bloom.PART, probes) == (0, 6) and bits >= 10 * 10_000
    built = bloom.built(keys, bits, probes)
    assert bloom.asked(keys, built, bits, probes).filter("not may_contain").count() == 0
    other = spark.range(10_000).select(F.format_string("other_%d", "id").alias("key"))
    assert bloom.asked(other, built, bits, probes).filter("may_contain").count() < 200
    assert bloom.asked(other, built.limit(0), bits, probes).filter("may_contain").count() == 0


def test_frames_stop_at_damage(spark, tmp_path):
    data = b"".join(codec.frame(f"key_{i:02d}", f"val_{i:02d}") for i in range(100))
    assert len(list(codec.frames(data))) == 100
    bad = data[:-5] + b"\x7f" * 5
    assert [k for k, _ in codec.frames(bad)] == [f"key_{i:02d}" for i in range(99)]
    rng = random.Random(1)
    for _ in range(50):
        cut = rng.randrange(len(data))
        assert list(codec.frames(data[:cut])) == list(codec.frames(data))[: len(list(codec.frames(data[:cut])))]
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.wal").write_bytes(bad)
    assert read_log(spark, str(tmp_path / "log")).count() == 99


def test_nearest_rank_and_sizes(spark):
    assert spark.range(1).select(codec.nearest_rank_index(F.lit(4), 50)).first()[0] == 2
    got = spark.createDataFrame([(10,), (2047,), (3 << 20,)], "n long").select(codec.human_bytes(F.col("n"))).collect()
    assert [r[0] for r in got] == ["10 B", "1 KB", "3 MB"]
