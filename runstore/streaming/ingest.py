"""Structured Streaming into a table: one run per micro-batch, written once even if the batch is replayed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import Store


def into(store: Store, stream: DataFrame, checkpoint: str, *, source: str = "stream", available_now: bool = True, maintain: bool = False) -> StreamingQuery:
    """Start writing a stream (key, value, and seq where rows are ordered) to the table.

    A batch is a run; its number is committed with it, so a batch that is replayed after a failure changes nothing.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        store.ingest(batch, batch_id, source)
        if maintain:
            store.maintain()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def newest(stream: DataFrame) -> DataFrame:
    """The newest version of each key so far, kept as streaming state (update mode): for small key sets; runs need no state."""
    return stream.groupBy("key").agg(F.max(F.struct("seq", "value")).alias("v")).select("key", "v.seq", "v.value")
