"""Continuous append to the event stores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from rillmark.sinks.tables import event_store_rows
from rillmark.streaming.running import append_files, each_batch
from rillmark.sinks.keyed import write_keyed


def append_event_store(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append records to a store partitioned by ``event_date``; each lands exactly once."""
    return append_files(event_store_rows(stream), path, checkpoint, trigger, "event_date")


def publish_stream(stream: DataFrame, key: str, target: dict, checkpoint: str, order=(), partitions: int = 6,
                   trigger: dict | None = None) -> StreamingQuery:
    """Streaming form of ``write_keyed``.  Files go to one folder per micro-batch, so a retry replaces itself."""
    def publish(batch: DataFrame, batch_id: int) -> None:
        here = dict(target)
        if here["format"] != "kafka":
            here = {**target, "path": f"{target['path']}/batch_id={batch_id}", "mode": "overwrite"}
        write_keyed(batch, key, here, order, partitions)

    return each_batch(stream, publish, checkpoint, trigger, keep=True)
