"""Declared record schemas.  Nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

READING = T.StructType([
    T.StructField("device_id", T.StringType()),
    T.StructField("sequence", T.LongType()),
    T.StructField("timestamp_ms", T.LongType()),
    T.StructField("value", T.DoubleType()),
])

STOREFRONT_EVENT = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("profile_id", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("timestamp_ms", T.LongType()),
    T.StructField("attributes", T.MapType(T.StringType(), T.StringType())),
])

DELIVERY_WEBHOOK = T.StructType([
    T.StructField("webhook_id", T.StringType()),
    T.StructField("message_id", T.StringType()),
    T.StructField("channel", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("timestamp_ms", T.LongType()),
    T.StructField("provider", T.StringType()),
])

MINUTE_ROLLUP = T.StructType([
    T.StructField("minute", T.TimestampType()),
    T.StructField("channel", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("event_count", T.LongType()),
])

MEMBERSHIP = T.StructType([
    T.StructField("segment_id", T.StringType()),
    T.StructField("profile_id", T.StringType()),
])

SEGMENT = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("family", T.StringType(), False),
    T.StructField("min_count", T.IntegerType(), False),
    T.StructField("window_days", T.IntegerType(), False),
    T.StructField("category", T.StringType(), False),
    T.StructField("min_value", T.DoubleType(), False),
    T.StructField("min_hours", T.IntegerType(), False),
    T.StructField("min_days", T.IntegerType(), False),
    T.StructField("min_distinct", T.IntegerType(), False),
])

# Key each record type is partitioned by when published.
PUBLISH_KEY = {"reading": "device_id", "storefront": "profile_id", "webhook": "message_id"}
