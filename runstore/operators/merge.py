"""Merging runs: the newest version of each key wins, then deletes disappear. That order is never turned around."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .bounds import Bound, in_range


def newest_per_key(df: DataFrame, *ties: str) -> DataFrame:
    """The version with the largest seq of each key, deletes included.

    Spark ranks within each map task first (a limit below the shuffle), so a key with very many versions sends one per task.
    """
    order = [F.desc("seq"), *[F.desc(t) for t in ties]]
    return df.withColumn("rn_", F.row_number().over(W.partitionBy("key").orderBy(*order))).filter("rn_ = 1").drop("rn_")


def drop_tombstones(df: DataFrame) -> DataFrame:
    return df.filter("value <> ''")


def live(df: DataFrame, lower: Bound = Bound(), upper: Bound = Bound(), unique: bool = False) -> DataFrame:
    """Live rows of a range. The range reaches the scan; unique: every key has one version, so nothing is shuffled."""
    df = df.filter(in_range(lower, upper))
    return drop_tombstones(df if unique else newest_per_key(df))


def scan(df: DataFrame, lower: Bound = Bound(), upper: Bound = Bound(), *, limit: int | None = None, reverse: bool = False, unique: bool = False) -> DataFrame:
    """Live rows in key order."""
    out = live(df, lower, upper, unique).orderBy(F.desc("key") if reverse else F.asc("key"))
    return out if limit is None else out.limit(limit)


def get(df: DataFrame, key: str, unique: bool = False) -> DataFrame:
    """The live row of a key, or none."""
    return live(df, Bound.included(key), Bound.included(key), unique)


def multi_get(df: DataFrame, keys: DataFrame, unique: bool = False) -> DataFrame:
    """keys (column key) with the live value of each, null where there is none. Only versions of these keys are merged."""
    some = df.join(keys.select("key"), "key", "left_semi")
    found = drop_tombstones(some if unique else newest_per_key(some)).select("key", "value", "seq")
    return keys.join(found, "key", "left")


def existing(df: DataFrame, keys: DataFrame) -> DataFrame:
    return keys.join(live(df).select("key"), "key", "left_semi")


def missing(df: DataFrame, keys: DataFrame) -> DataFrame:
    return keys.join(live(df).select("key"), "key", "left_anti")


def two_merge(newer: DataFrame, older: DataFrame) -> DataFrame:
    """All of newer, and what older has besides; newer's deletes hide older's values and stay."""
    return newer.unionByName(older.join(newer.select("key"), "key", "left_anti"))


def merge_runs(runs: list[DataFrame]) -> DataFrame:
    """Runs listed newest first; deletes stay. Recency is the place in the list, then seq."""
    ranked = [r.withColumn("recency_", F.lit(len(runs) - i)) for i, r in enumerate(runs)]
    w = W.partitionBy("key").orderBy(F.desc("recency_"), F.desc("seq"))
    return reduce(DataFrame.unionByName, ranked).withColumn("rn_", F.row_number().over(w)).filter("rn_ = 1").drop("rn_", "recency_")


def concat(runs: list[DataFrame]) -> DataFrame:
    """Runs whose key ranges do not overlap: nothing to merge."""
    return reduce(DataFrame.unionByName, runs)


def seek(df: DataFrame, key: str) -> DataFrame:
    return df.filter(F.col("key") >= key).orderBy("key")


def compacted(df: DataFrame, bottom: bool) -> DataFrame:
    """What compaction writes: deletes go only where no older version can lie below."""
    return drop_tombstones(newest_per_key(df)) if bottom else newest_per_key(df)
