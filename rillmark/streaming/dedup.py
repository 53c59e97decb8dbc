"""Deduplication of streams."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from rillmark.operators.bounded import DEFAULT_CAP, Memory
from rillmark.operators.dedup import shard_of


def dedup_stream(stream: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First arrival of each key, however late it comes.

    Every key seen is state, spread over the shuffle partitions: start the query
    inside ``rocksdb_state`` to keep it on disk and not on the heap.  There is no
    watermark, since one would drop late records that were never seen.
    """
    return stream.dropDuplicates(list(keys))


class _FifoMemory(StatefulProcessor):
    """Admits the rows of one group against the ids it still remembers.

    The state lists admitted ids, the last ``cap`` of which are remembered.  A
    micro-batch appends what it admits; the list is written anew, without what is
    forgotten, when it would exceed twice ``cap``.  So per id admitted, at most
    two are written, however large the memory is.
    """

    def __init__(self, id_column: str, id_type: T.DataType, order: Sequence[str], columns: Sequence[str], cap: int):
        self.id_column, self.order, self.columns, self.cap = id_column, list(order), list(columns), cap
        self.schema = T.StructType([T.StructField("id", id_type)])

    def init(self, handle) -> None:
        self.queue = handle.getListState("queue", self.schema)

    def handleInputRows(self, key, rows, timerValues):
        batch = pd.concat(list(rows)).sort_values(self.order)
        listed = [entry[0] for entry in self.queue.get()]
        memory = Memory(self.cap, listed[-self.cap:])
        ids = batch[self.id_column].tolist()
        verdicts = [memory.admit(identifier) for identifier in ids]
        admitted = [(identifier,) for identifier, new in zip(ids, verdicts) if new]
        if len(listed) + len(admitted) > 2 * self.cap:
            self.queue.put([(identifier,) for identifier in memory.queue])
        elif admitted:
            self.queue.appendList(admitted)
        yield batch.loc[verdicts, self.columns]

    def close(self) -> None:
        pass


def _remembering(keyed: DataFrame, key: str, rows: T.StructType, id_column: str, order: Sequence[str],
                 cap: int) -> DataFrame:
    """Group ``keyed`` by its column ``key`` and return its admitted rows with the columns of ``rows``."""
    processor = _FifoMemory(id_column, rows[id_column].dataType, order, rows.names, cap)
    return keyed.groupBy(key).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=rows, outputMode="Append", timeMode="None")


def dedup_bounded_stream(stream: DataFrame, group: str, id_column: str, order: Sequence[str],
                         cap: int = DEFAULT_CAP) -> DataFrame:
    """Streaming form of ``dedup_bounded``; start it inside ``rocksdb_state``.

    A task holds one group's rows of one micro-batch, so bound the micro-batch
    at the source (``maxOffsetsPerTrigger``, ``maxFilesPerTrigger``).
    """
    return _remembering(stream, group, stream.schema, id_column, order, cap)


def dedup_sharded_stream(stream: DataFrame, id_column: str, order: Sequence[str], cap: int = 4_000_000,
                         shards: int = 64, shard: Column | None = None) -> DataFrame:
    """Streaming form of ``dedup_sharded``, with the same remarks."""
    keyed = stream.withColumn("_shard", shard_of(F.col(id_column), shards) if shard is None else shard)
    return _remembering(keyed, "_shard", stream.schema, id_column, order, max(1, cap // shards))
