"""Per-minute delivery rollup and the dashboard queries on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rillmark.functions import MINUTE_MS, event_time, floor_ms, ratio
from rillmark.operators.ranges import between
from rillmark.operators.scan import positions


def _per_minute(webhooks: DataFrame, measure) -> DataFrame:
    """Group on the integer minute; the timestamp is made from the few result rows."""
    return (webhooks
            .groupBy(floor_ms(F.col("timestamp_ms"), MINUTE_MS).alias("_minute"), "channel", "status")
            .agg(measure)
            .withColumn("minute", event_time(F.col("_minute")))
            .drop("_minute"))


def minute_rollup(webhooks: DataFrame) -> DataFrame:
    """One row per minute, channel and status with its number of webhooks."""
    counts = _per_minute(webhooks, F.count(F.lit(1)).alias("event_count"))
    return counts.select("minute", "channel", "status", "event_count")


def merge_rollup(parts: DataFrame) -> DataFrame:
    """Sum partial rollup rows with equal key; any number of partial rows is legal."""
    return parts.groupBy("minute", "channel", "status").agg(F.sum("event_count").alias("event_count"))


def recompute_counts(webhooks: DataFrame) -> DataFrame:
    """Webhooks per channel and status, from the raw log."""
    return (webhooks.groupBy("channel", "status").agg(F.count(F.lit(1)).alias("count"))
            .orderBy("channel", "status"))


def rollup_counts(rollup: DataFrame) -> DataFrame:
    """Webhooks per channel and status, from the rollup."""
    return (rollup.groupBy("channel", "status").agg(F.sum("event_count").alias("count"))
            .orderBy("channel", "status"))


def window_start(start_ms: int) -> int:
    """A dashboard window starts on a whole minute, in both forms of the query."""
    return start_ms - start_ms % MINUTE_MS


def dashboard_raw(webhooks: DataFrame, start_ms: int) -> DataFrame:
    """Distinct webhooks per minute, channel and status since ``start_ms``, from the raw log."""
    recent = between(webhooks, window_start(start_ms))
    counts = _per_minute(recent, F.count_distinct("webhook_id").alias("distinct_count"))
    return (counts.select("minute", "channel", "status", "distinct_count")
            .orderBy("minute", "channel", "status"))


def dashboard_rollup(rollup: DataFrame, start_ms: int) -> DataFrame:
    """The same answer from the rollup of a deduplicated log."""
    recent = rollup.where(F.col("minute") >= event_time(F.lit(window_start(start_ms))))
    return (merge_rollup(recent).withColumnRenamed("event_count", "distinct_count")
            .orderBy("minute", "channel", "status"))


def summary(rollup: DataFrame) -> DataFrame:
    return rollup_counts(rollup).select("channel", "status", "count")


def dashboard_totals(rows: DataFrame) -> DataFrame:
    """Channel total, grand total and share of the largest count, for ``summary`` rows.

    The input is one row per channel and status, so the windows hold a handful of rows.
    """
    everything = W.partitionBy(F.lit(0))
    largest = F.greatest(F.max("count").over(everything), F.lit(1))
    return rows.select(
        "channel", "status", "count",
        F.sum("count").over(W.partitionBy("channel")).alias("channel_total"),
        F.sum("count").over(everything).alias("grand_total"),
        ratio(F.col("count"), largest).alias("share"))


def channel_counts(webhooks: DataFrame) -> DataFrame:
    return webhooks.groupBy("channel").agg(F.count(F.lit(1)).alias("count"))


def message_lifecycle(webhooks: DataFrame, stretch_ms: int | None = None) -> DataFrame:
    """Every webhook of a message, numbered in time order (ties by ``webhook_id``).

    Long form: a message with very many webhooks stays many rows and is ordered
    in ranges of rows, so no task and no cell ever holds one whole message.
    ``stretch_ms`` is taken for callers of the earlier form; ranges need no width.
    """
    rows = webhooks.select("message_id", "timestamp_ms", "webhook_id", "status")
    return positions(rows, ["message_id"], ["timestamp_ms", "webhook_id"])


def throughput(webhooks: DataFrame) -> DataFrame:
    """Rows per second in each minute."""
    minute = floor_ms(F.col("timestamp_ms"), MINUTE_MS).alias("_minute")
    counts = webhooks.groupBy(minute).agg(F.count(F.lit(1)).alias("_rows"))
    return counts.select(
        event_time(F.col("_minute")).alias("minute"), ratio(F.col("_rows"), F.lit(60)).alias("rows_per_sec"))


def overall_throughput(rows: DataFrame) -> DataFrame:
    """Rows and rows per second between the first and the last row."""
    seconds = (F.max("timestamp_ms") - F.min("timestamp_ms")) / 1000
    return rows.agg(F.count(F.lit(1)).alias("rows_n"),
                    ratio(F.count(F.lit(1)), seconds).alias("rows_per_sec"))


def rollup_ratio(webhooks: DataFrame, rollup: DataFrame) -> DataFrame:
    """How much smaller the rollup is than the log."""
    none = F.lit(0).cast("long")
    sizes = (webhooks.agg(F.count(F.lit(1)).alias("raw_n"), none.alias("rollup_n"))
             .unionByName(rollup.agg(none.alias("raw_n"), F.count(F.lit(1)).alias("rollup_n"))))
    total = sizes.agg(F.sum("raw_n").alias("raw_n"), F.sum("rollup_n").alias("rollup_n"))
    return total.withColumn("ratio", ratio(F.col("rollup_n"), F.col("raw_n")))
