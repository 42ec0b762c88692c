import random

from pyspark.sql import functions as F

from runstore.operators import files as fl


def test_sliced_join_equals_broadcast(spark):
    rng = random.Random(1)
    rows = []
    for i in range(60):
        a, b = sorted((f"k{rng.randrange(1000):04d}", f"k{rng.randrange(1000):04d}"))
        rows.append((i, i % 3, a, b))
    files = spark.createDataFrame(rows, "id int, level int, first_key string, last_key string")
    keys = spark.range(0, 1000, 7).select(F.format_string("k%04d", "id").alias("key"))
    want = sorted((r.key, r.id) for r in fl.key_to_files(keys, files).collect())
    got = sorted((r.key, r.id) for r in fl.key_to_files(keys, files, broadcast_rows=0, slices=20).collect())
    assert got == want == sorted((k.key, i) for k in keys.collect() for i, _, a, b in rows if a <= k.key <= b)


def test_sliced_overlaps_equal_all_pairs(spark):
    rng = random.Random(2)
    rows = [(i, *sorted((f"k{rng.randrange(300):03d}", f"k{rng.randrange(300):03d}"))) for i in range(50)]
    a = spark.createDataFrame(rows, "id int, first_key string, last_key string")
    b = a.filter("id % 3 = 0")
    want = sorted((i, j) for i, f, l in rows for j, x, y in rows if j % 3 == 0 and f <= y and x <= l)
    for few in (100_000, 0):
        assert sorted((r.a_id, r.b_id) for r in fl.overlapping(a, b, broadcast_rows=few, slices=12).collect()) == want


def test_catalogue_checks(spark):
    files = spark.createDataFrame([(1, 1, 0, "a", "c"), (2, 1, 1, "c", "e"), (3, 1, 2, "f", "g"), (4, 2, 0, "z", "y")], "id int, level int, pos int, first_key string, last_key string")
    assert sorted(r.id for r in fl.out_of_order(files).collect()) == [1, 4]
    pairs = fl.overlapping(files.filter("level = 1"), files.filter("level = 1")).filter("a_id < b_id").collect()
    assert [(r.a_id, r.b_id) for r in pairs] == [(1, 2)]


def test_equal_ranges_go_by_id(spark):
    rows = [(i, i % 2, "a", "z") for i in (7, 2, 5, 0, 3, 6, 1, 4)]
    for order in (rows, rows[::-1]):
        files = spark.createDataFrame(order, "id int, level int, first_key string, last_key string").coalesce(1)
        assert sorted(r.id for r in fl.out_of_order(files).collect()) == [0, 1, 2, 3, 4, 5]
