"""Topics: bounded snapshots and continuous reads.

A source is a small dict ``{"format", "options", "path", "schema"}``.  For Kafka
the connector package must be on the classpath; files need nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def kafka_topic(servers: str, topic: str, **options: str) -> dict:
    """``options`` may hold ``maxOffsetsPerTrigger`` or ``minPartitions``."""
    return {"format": "kafka",
            "options": {"kafka.bootstrap.servers": servers, "subscribe": topic, **options}}


def parquet_topic(path: str, schema: T.StructType, **options: str) -> dict:
    """A directory of Parquet files; ``options`` may hold ``pathGlobFilter`` or ``maxFilesPerTrigger``."""
    return {"format": "parquet", "path": path, "schema": schema, "options": options}


def _configure(reader, source: dict, extra: dict):
    reader = reader.format(source["format"]).options(**source.get("options", {}), **extra)
    if source.get("schema") is not None:
        reader = reader.schema(source["schema"])
    return reader.load(source["path"]) if source.get("path") else reader.load()


def read_topic_snapshot(spark: SparkSession, source: dict) -> DataFrame:
    """Everything from the earliest record up to what is there now, without a consumer group."""
    bounds = ({"startingOffsets": "earliest", "endingOffsets": "latest"} if source["format"] == "kafka" else {})
    return _configure(spark.read, source, bounds)


def read_topic_stream(spark: SparkSession, source: dict) -> DataFrame:
    """All partitions from the first record on; the query's checkpoint keeps the progress."""
    start = {"startingOffsets": "earliest"} if source["format"] == "kafka" else {}
    return _configure(spark.readStream, source, start)


def merge_topics(*frames: DataFrame) -> DataFrame:
    """The records of several topics, or of several parts of one, as one frame or stream."""
    return reduce(DataFrame.unionByName, frames)
