"""Delivery to a sink that may fail, without losing a row.

Rows the sink did not take go to parcels, one per failed micro-batch, in the
shared folder.  A replay offers every open parcel again; what fails again stays.
Delivery is at least once: a sink that failed half way gets rows twice.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from rillmark.session import child_names, path_exists, touch
from rillmark.streaming.running import each_batch

# A sink takes the rows and a name that belongs to these rows across retries.  It raises if
# nothing counts as delivered, or returns the rows it could not deliver, or None.
Sink = Callable[[DataFrame, str], "DataFrame | None"]

_LOG = logging.getLogger(__name__)
_PARCEL = "parcel="


def _offer(rows: DataFrame, name: str, sink: Sink) -> DataFrame | None:
    try:
        failed = sink(rows, name)
    except (AnalysisException, TypeError, NameError, AttributeError):
        raise  # a mistake in the program, which no replay mends
    except Exception as cause:
        _LOG.warning("parcel %s was not delivered: %s", name, cause)
        return rows
    return None if failed is None or failed.isEmpty() else failed


def _remainder(name: str, failed: DataFrame, offered: DataFrame) -> str:
    """A part of the rows is another parcel, so a sink that writes by name keeps what it took."""
    return name if failed is offered else f"{name}.r"


def _keep(rows: DataFrame, path: str, name: str) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/open/{_PARCEL}{name}")


def deliver_with_replay(stream: DataFrame, sink: Sink, undelivered_path: str, checkpoint: str,
                        trigger: dict | None = None) -> StreamingQuery:
    """Offer each micro-batch to ``sink`` and keep what it did not take."""
    def deliver(batch: DataFrame, batch_id: int) -> None:
        name = f"{batch_id:012d}"
        failed = _offer(batch, name, sink)
        if failed is not None:
            _keep(failed, undelivered_path, _remainder(name, failed, batch))

    return each_batch(stream, deliver, checkpoint, trigger, keep=True)


def open_parcels(spark: SparkSession, path: str) -> list[str]:
    closed = {n for n in child_names(spark, f"{path}/closed")}
    return [n[len(_PARCEL):] for n in child_names(spark, f"{path}/open")
            if n.startswith(_PARCEL) and n not in closed and path_exists(spark, f"{path}/open/{n}/_SUCCESS")]


def pending(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows still to be delivered."""
    folders = [f"{path}/open/{_PARCEL}{name}" for name in open_parcels(spark, path)]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*folders)


def replay_undelivered(spark: SparkSession, path: str, schema: T.StructType, sink: Sink) -> int:
    """Offer every open parcel once more; returns how many stay open.

    The loop is over failed micro-batches; each parcel is delivered by all executors.
    """
    for name in open_parcels(spark, path):
        rows = spark.read.schema(schema).parquet(f"{path}/open/{_PARCEL}{name}")
        failed = _offer(rows, name, sink)
        if failed is rows:
            continue
        if failed is not None:
            _keep(failed, path, _remainder(name, failed, rows))
        touch(spark, f"{path}/closed/{_PARCEL}{name}")
    return len(open_parcels(spark, path))


def drain_undelivered(spark: SparkSession, path: str, schema: T.StructType, sink: Sink) -> int:
    """Replay as long as a round delivers something; returns how many parcels stay open."""
    left, before = open_parcels(spark, path), None
    while left and left != before:
        replay_undelivered(spark, path, schema, sink)
        left, before = open_parcels(spark, path), left
    return len(left)
