"""Schema of versioned rows, key codecs and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = T.StructType([T.StructField("key", T.StringType(), False), T.StructField("seq", T.LongType(), False), T.StructField("op", T.StringType(), False), T.StructField("value", T.StringType(), False)])
PUT, DELETE = "P", "D"


def op_of(value: Column) -> Column:
    """An empty value is a delete."""
    return F.when(value == "", F.lit(DELETE)).otherwise(F.lit(PUT))


def check_key(key: str) -> str:
    if not isinstance(key, str) or not key:
        raise ValueError("a key must be a non-empty string")
    return key


def check_value(value: str) -> str:
    if not isinstance(value, str):
        raise ValueError("a value must be a string; delete with delete()")
    return value


def valid_versions(df: DataFrame) -> DataFrame:
    """df, failing at run time on null or empty keys and on null values."""
    bad = F.col("key").isNull() | (F.col("key") == "") | F.col("value").isNull()
    return df.withColumn("key", F.when(bad, F.raise_error(F.lit("keys must be non-empty, and values not null")).cast("string")).otherwise(F.col("key")))


def key_of(*parts: Column | str, sep: str = "|") -> Column:
    """A key from typed columns: longs are zero-padded to 19 digits, so that key order is numeric order."""
    return F.concat_ws(sep, *[F.format_string("%019d", p.cast("long")) if isinstance(p, Column) else F.col(p).cast("string") for p in parts])
