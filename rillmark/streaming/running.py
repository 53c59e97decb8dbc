"""Starting streaming queries."""

from __future__ import annotations

import json
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

DRAIN = {"availableNow": True}


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Start queries inside this block to keep their state in RocksDB."""
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, before)


def each_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str,
               trigger: dict | None = None, keep: bool = False, mode: str = "append") -> StreamingQuery:
    """Run ``handle(batch, batch_id)`` on each micro-batch.

    A micro-batch that failed comes again with the same id, so handlers write
    under that id.  ``keep`` holds the batch for handlers that read it more than
    once; those that write it once should not pay for that.
    """
    def kept(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            handle(batch, batch_id)
        finally:
            batch.unpersist()

    return (stream.writeStream.outputMode(mode).foreachBatch(kept if keep else handle).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or DRAIN)).start())


def append_files(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None,
                 partition_by: str | None = None) -> StreamingQuery:
    """Append to Parquet files; each row lands exactly once."""
    writer = stream.writeStream.format("parquet").outputMode("append")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    return (writer.option("checkpointLocation", checkpoint).trigger(**(trigger or DRAIN)).start(path))


def finish(query: StreamingQuery) -> None:
    """Wait for a draining query, as long as it takes, and pass on its failure."""
    query.awaitTermination()


def late_rows(query: StreamingQuery) -> int:
    """Rows the recent micro-batches dropped as later than the watermark."""
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)


def source_lag(query: StreamingQuery) -> dict[str, int]:
    """Unread records per topic partition, from the last progress report; empty without Kafka sources."""
    progress = query.lastProgress
    lag: dict[str, int] = {}
    for source in progress.sources if progress else []:
        if not source.description.startswith("Kafka"):
            continue
        latest, done = json.loads(source.latestOffset or "{}"), json.loads(source.endOffset or "{}")
        for topic, partitions in latest.items():
            for partition, last in partitions.items():
                position = done.get(topic, {}).get(partition, 0)
                lag[f"{topic}-{partition}"] = max(0, last - position)
    return lag
