import pytest

from runstore.model import VERSION, valid_versions
from runstore.operators import merge as mg
from runstore.operators.bounds import Bound, in_range, may_hold


def runs(spark, *newest_first):
    """DataFrames of the runs, the newest with the largest seq."""
    n = len(newest_first)
    return [spark.createDataFrame([(k, n - i, "D" if v == "" else "P", v) for k, v in r.items()], VERSION) for i, r in enumerate(newest_first)]


def as_dict(df):
    return {r.key: r.value for r in df.collect()}


def test_merge_three(spark):
    r = runs(spark, {"k1": "v1_new", "k2": "", "k4": "v4_new"}, {"k2": "v2_mid", "k3": "v3_mid"}, {"k1": "v1_old", "k3": "v3_old", "k5": "v5_old"})
    want = {"k1": "v1_new", "k2": "", "k3": "v3_mid", "k4": "v4_new", "k5": "v5_old"}
    assert as_dict(mg.merge_runs(r)) == want
    assert as_dict(mg.newest_per_key(mg.concat(r))) == want
    assert as_dict(mg.live(mg.concat(r))) == {k: v for k, v in want.items() if v}


def test_two_merge(spark):
    a, b = runs(spark, {"b": "mem_b_new", "d": "mem_d", "e": ""}, {"a": "sst_a", "b": "sst_b", "c": "sst_c", "e": "sst_e"})
    assert as_dict(mg.two_merge(a, b)) == {"a": "sst_a", "b": "mem_b_new", "c": "sst_c", "d": "mem_d", "e": ""}


def test_concat_and_seek(spark):
    r = mg.concat(runs(spark, {"k1": "v1", "k2": "v2"}, {"k3": "v3", "k4": "v4"}, {"k5": "v5", "k6": "v6"}))
    for at, want in (("k3", "k3 k4 k5 k6"), ("k2_5", "k3 k4 k5 k6"), ("k5", "k5 k6"), ("k7", "")):
        assert [x.key for x in mg.seek(r, at).collect()] == want.split()


def test_bounds_over_deletes(spark):
    df = mg.concat(runs(spark, {"key1": "val1_new", "key2": "", "key4": "", "key5": "val5_new"}, {"key2": "val2_old", "key3": "val3_old", "key4": "val4_old", "key6": "val6_old"}))
    for upper, want in ((Bound(), "1356"), (Bound.included("key5"), "135"), (Bound.excluded("key5"), "13")):
        assert [r.key[-1] for r in mg.scan(df, upper=upper).collect()] == list(want)


@pytest.mark.parametrize(
    ("lower", "upper", "want"),
    [(Bound.included("key_20"), Bound.included("key_40"), [20, 30, 40]), (Bound.excluded("key_20"), Bound.excluded("key_40"), [30]), (Bound.included("key_25"), Bound.included("key_26"), []),
     (Bound.included("key_99"), Bound(), []), (Bound(), Bound(), [10, 20, 30, 40, 50]), (Bound.included("key_40"), Bound.included("key_20"), [])],
)
def test_range_of_five(spark, lower, upper, want):
    (df,) = runs(spark, {f"key_{n}": f"val_{n}" for n in range(10, 60, 10)})
    assert [r.value for r in mg.scan(df, lower, upper).collect()] == [f"val_{n}" for n in want]
    assert bool(want) <= may_hold(lower, upper, "key_10", "key_50")


def test_may_hold_is_exact_at_the_edges():
    assert may_hold(Bound.included("b"), Bound(), "a", "b") and not may_hold(Bound.excluded("b"), Bound(), "a", "b")
    assert may_hold(Bound(), Bound.included("a"), "a", "b") and not may_hold(Bound(), Bound.excluded("a"), "a", "b")


def test_keys_compare_as_bytes(spark):
    (df,) = runs(spark, {"a": "1", "ab": "2", "é": "3", "z": "4", "漢": "5"})
    assert [r.key for r in mg.scan(df).collect()] == sorted(["a", "ab", "é", "z", "漢"], key=str.encode)


def test_batched_reads(spark):
    df = mg.concat(runs(spark, {"a": "", "b": "2"}, {"a": "1", "c": "3"}))
    keys = spark.createDataFrame([(k,) for k in "abcd"], "key string")
    assert as_dict(mg.multi_get(df, keys)) == {"a": None, "b": "2", "c": "3", "d": None}
    assert sorted(r.key for r in mg.existing(df, keys).collect()) == ["b", "c"]
    assert sorted(r.key for r in mg.missing(df, keys).collect()) == ["a", "d"]
    assert as_dict(mg.get(df, "b")) == {"b": "2"} and mg.get(df, "a").count() == 0


def test_deletes_stay_unless_bottom(spark):
    df = mg.concat(runs(spark, {"a": "", "b": "2"}, {"a": "1"}))
    assert as_dict(mg.compacted(df, bottom=False)) == {"a": "", "b": "2"}
    assert as_dict(mg.compacted(df, bottom=True)) == {"b": "2"}


def test_range_reaches_the_scan_and_delete_filter_does_not(spark, tmp_path):
    (df,) = runs(spark, {f"k{i:03d}": str(i) for i in range(100)})
    df.write.parquet(str(tmp_path / "t"))
    plan = mg.live(spark.read.parquet(str(tmp_path / "t")), Bound.included("k010"), Bound.excluded("k020"))._jdf.queryExecution().executedPlan().toString()
    pushed = next(x for x in plan.splitlines() if "PushedFilters" in x)
    assert "GreaterThanOrEqual(key,k010)" in pushed and "LessThan(key,k020)" in pushed and "value" not in pushed.split("PushedFilters")[1].split("]")[0]
    assert mg.live(spark.read.parquet(str(tmp_path / "t")).filter(in_range()), unique=True)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 0


def test_bad_rows_fail(spark):
    for row in ((None, "x"), ("", "x"), ("k", None)):
        with pytest.raises(Exception, match="keys must be non-empty"):
            valid_versions(spark.createDataFrame([row], "key string, value string")).collect()
