"""Log files as DataFrames: frames are decoded in the executors, a file at a time, up to the first damaged one."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codec import frames


def decoded(files: DataFrame) -> DataFrame:
    """path, pos, key, value of the valid frames of each file (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, i, k, v) for p, data in zip(*(c.to_pylist() for c in batch.columns), strict=True) for i, (k, v) in enumerate(frames(data))]
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["path", "pos", "key", "value"])

    return files.select("path", "content").mapInArrow(run, "path string, pos long, key string, value string")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The valid frames of all log files below a path."""
    return decoded(spark.read.format("binaryFile").load(path))


def last_writes(df: DataFrame) -> DataFrame:
    return df.groupBy("key").agg(F.max_by("value", "pos").alias("value"))
