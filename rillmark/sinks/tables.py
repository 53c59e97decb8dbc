"""Catalog tables: create if absent, and reset before a run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillmark.functions import utc_date


def ensure_table(spark: SparkSession, name: str, schema: T.StructType, path: str,
                 partition_by: Sequence[str] = ()) -> None:
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        partitioning = f" PARTITIONED BY ({', '.join(partition_by)})" if partition_by else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet{partitioning} LOCATION '{path}'")


def truncate_table(spark: SparkSession, name: str) -> None:
    """Remove all rows of a table if it exists, and keep the table."""
    if spark.catalog.tableExists(name):
        table = spark.table(name)
        spark.createDataFrame([], table.schema).write.insertInto(name, overwrite=True)


def event_store_rows(df: DataFrame) -> DataFrame:
    """Rows of an event store, with the UTC ``event_date`` it is partitioned by."""
    return df.withColumn("event_date", utc_date(F.col("timestamp_ms")))
