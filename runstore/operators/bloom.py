"""Bloom filters as tables of bitmaps, built and asked by DataFrame functions: they grow with the keys and never pass through the driver."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART = 32768  # bits that one bitmap of Spark's holds


def shape(keys: int, rate: float) -> tuple[int, int]:
    """Bits (whole bitmaps) and probes for a number of keys at a false positive rate."""
    per_key = math.ceil(-math.log(rate) / math.log(2) ** 2)
    return max(1, -(-keys * per_key // PART)) * PART, max(1, min(30, int(per_key * math.log(2))))


def places(key: Column, bits: int, probes: int) -> Column:
    """The bits of a key, one for each probe: a hash with its own seed each."""
    return F.array_distinct(F.array(*[F.pmod(F.xxhash64(key, F.lit(i)), F.lit(bits)) for i in range(probes)]))


def built(keys: DataFrame, bits: int, probes: int) -> DataFrame:
    """part, map: the bitmaps of the keys (column key)."""
    at = keys.select(F.explode(places(F.col("key"), bits, probes)).alias("at"))
    return at.groupBy(F.floor(F.col("at") / PART).alias("part")).agg(F.bitmap_construct_agg(F.col("at") % PART).alias("map"))


def asked(keys: DataFrame, bloom: DataFrame, bits: int, probes: int) -> DataFrame:
    """key, may_contain for each distinct key: false only for keys that were not built in."""
    at = keys.select("key").distinct().select("key", F.explode(places(F.col("key"), bits, probes)).alias("at"))
    at = at.withColumn("part", F.floor(F.col("at") / PART)).join(bloom, "part", "left")
    byte = F.conv(F.hex(F.substr(F.col("map"), ((F.col("at") % PART) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    one = F.expr("shiftright(b_, cast(at % 8 as int)) & 1 = 1")
    return at.withColumn("b_", byte).groupBy("key").agg(F.coalesce(F.min(one), F.lit(False)).alias("may_contain"))
