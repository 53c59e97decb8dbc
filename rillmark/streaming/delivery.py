"""The minute rollup, refreshed incrementally."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rillmark.operators.delivery import merge_rollup, minute_rollup
from rillmark.schemas import MINUTE_ROLLUP
from rillmark.sinks.logs import append_batch, compact_log, read_log
from rillmark.streaming.running import each_batch


def minute_rollup_stream(webhooks: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append each micro-batch's partial rollup; ``read_rollup`` sums the parts.

    No row is ever too late, since a late webhook just adds to its minute, and
    the rollup is never empty while it is refreshed.
    """
    return each_batch(webhooks, lambda batch, batch_id: append_batch(minute_rollup(batch), path, batch_id),
                      checkpoint, trigger)


def read_rollup(spark: SparkSession, path: str) -> DataFrame:
    return merge_rollup(read_log(spark, path, MINUTE_ROLLUP))


def compact_rollup(spark: SparkSession, path: str) -> int | None:
    return compact_log(spark, path, MINUTE_ROLLUP, merge_rollup)


def minute_windows(webhooks: DataFrame) -> DataFrame:
    """The rollup as a windowed streaming aggregate, for queries in update or complete mode.

    Without a watermark no webhook is too late: its window is just updated again.
    """
    counts = webhooks.groupBy(F.window(F.timestamp_millis(F.col("timestamp_ms")), "1 minute"), "channel", "status").agg(
        F.count(F.lit(1)).alias("event_count"))
    return counts.select(F.col("window.start").alias("minute"), "channel", "status", "event_count")


def minute_windows_stream(webhooks: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append the windows each micro-batch changed; ``read_windows`` takes the last count of each."""
    return each_batch(minute_windows(webhooks), lambda batch, batch_id: append_batch(batch, path, batch_id), checkpoint,
                      trigger, mode="update")


def read_windows(spark: SparkSession, path: str) -> DataFrame:
    rows = read_log(spark, path, MINUTE_ROLLUP)
    return rows.groupBy("minute", "channel", "status").agg(F.max_by("event_count", "batch_id").alias("event_count"))
