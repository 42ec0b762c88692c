"""Queries over a file catalogue (id, level, pos, bytes, first_key, last_key)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def key_to_files(keys: DataFrame, files: DataFrame, broadcast_rows: int = 100_000, slices: int = 256) -> DataFrame:
    """Each key with the files whose range holds it.

    A catalogue of up to broadcast_rows rows is sent to all tasks. A larger one is joined by slices of the key space, cut at some
    of the files' first keys: a file goes to every slice that it reaches, a key to one.
    """
    on = F.col("key").between(F.col("first_key"), F.col("last_key"))
    n = files.count()
    if n <= broadcast_rows:
        return keys.join(F.broadcast(files), on)
    slice_of = _slices(files, n, slices)
    reached = files.withColumn("slice_", F.explode(F.sequence(slice_of("first_key"), F.greatest(slice_of("first_key"), slice_of("last_key")))))
    return keys.withColumn("slice_", slice_of("key")).join(reached, "slice_").filter(on).drop("slice_")


def _slices(files: DataFrame, n: int, slices: int) -> Callable[[str], Column]:
    """The slice of the key space that a column's key lies in; cuts are some of the files' first keys, and where to cut changes no answer."""
    some = files.filter(F.pmod(F.xxhash64("first_key"), F.lit(max(1, n // slices))) == 0)
    cuts = sorted({r.first_key for r in some.select("first_key").limit(4 * slices).collect()}, key=str.encode)
    cut = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<string>")
    return lambda c: F.size(F.filter(cut, lambda x: x <= F.col(c)))


def overlapping(a: DataFrame, b: DataFrame, broadcast_rows: int = 100_000, slices: int = 256) -> DataFrame:
    """Pairs of files whose ranges meet (columns prefixed a_ and b_).

    If neither side is small, each file goes to every slice of the key space that it reaches, and a pair meets in the first slice of both.
    """
    n, m = a.count(), b.count()
    slice_of = _slices(a, n, slices)
    one, two = (x.select([F.col(c).alias(f"{p}_{c}") for c in x.columns]) for x, p in ((a, "a"), (b, "b")))
    on = (F.col("a_first_key") <= F.col("b_last_key")) & (F.col("b_first_key") <= F.col("a_last_key"))
    if min(n, m) <= broadcast_rows:
        return one.join(F.broadcast(two), on) if m <= n else F.broadcast(one).join(two, on)
    one, two = (x.withColumn(f"{p}_s", slice_of(f"{p}_first_key")).withColumn("s_", F.explode(F.sequence(F.col(f"{p}_s"), F.greatest(F.col(f"{p}_s"), slice_of(f"{p}_last_key"))))) for x, p in ((one, "a"), (two, "b")))
    return one.join(two, "s_").filter(on & (F.col("s_") == F.greatest("a_s", "b_s"))).drop("s_", "a_s", "b_s")


def level_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("level").agg(F.count("*").alias("n_files"), F.sum("bytes").alias("bytes"), F.min("first_key").alias("first_key"), F.max("last_key").alias("last_key"))


def out_of_order(files: DataFrame) -> DataFrame:
    """Files that break a level's order: their range is inverted, or reaches the next file's. Of equal ranges the one with the largest id comes last."""
    following = F.lead("first_key").over(W.partitionBy("level").orderBy("first_key", "last_key", "id"))
    return files.withColumn("next_first", following).filter("first_key > last_key or last_key >= next_first")


def running_counts(tiers: DataFrame) -> DataFrame:
    """tiers (tier_id, pos, n): files of the tiers up to each, newest first, and its share of them."""
    w = W.orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    return tiers.withColumn("upto", F.sum("n").over(w)).withColumn("next_n", F.lead("n").over(W.orderBy("pos")))
