"""Continuous ingest: a structured stream written to a namespace, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from palimpsest.sources.store import Namespace


def ingest(stream: DataFrame, target: Namespace, name: str, checkpoint: str, available_now: bool = False, interval: str = "10 seconds") -> StreamingQuery:
    """Starts inserting a stream of records.

    Each micro-batch is one commit that also records the batch's number under
    `name`, so a batch that is replayed after a failure is not inserted twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        target.insert_df(batch, stream=(name, number))

    writer = stream.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()
