from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_lag_stream(sent: DataFrame, received: DataFrame, id_column: str) -> DataFrame:
    """Streaming form of ``event_lag``: every pair, however slow or early the receipt.

    Both sides are state, since a receipt may come at any time; keep it in RocksDB
    (``rocksdb_state``).
    """
    left = sent.select(F.col(id_column).alias("_sent_id"), "sent_ms")
    pairs = received.select(id_column, "received_ms").join(left, F.col(id_column) == F.col("_sent_id"))
    return pairs.select(id_column, (F.col("received_ms") - F.col("sent_ms")).alias("lag_ms"))
