"""Publishing keyed messages so that the records of one key stay in order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillmark.operators.dedup import shard_of

DEFAULT_PARTITIONS = 6


def assign_partition(key: Column, partitions: int = DEFAULT_PARTITIONS) -> Column:
    return shard_of(key, partitions)


def keyed_messages(df: DataFrame, key: str) -> DataFrame:
    """``key`` and JSON ``value`` columns, the form the Kafka sink takes."""
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))


def write_keyed(df: DataFrame, key: str, target: dict, order: Sequence[str] = (),
                partitions: int = DEFAULT_PARTITIONS, files: int | None = None) -> None:
    """Publish a batch.  ``target`` is ``{"format": "kafka", "options": …}`` or ``{"format": "parquet", "path": …}``.

    Kafka assigns its partitions from the key and keeps the order messages are
    sent in, so with ``order`` all records of a key go through one producer, read
    off a sorted (spilling) partition; without it nothing is shuffled.  Files get a ``partition`` folder
    per key hash; inside it rows are range-split by key and order into several
    files, so a hot key fills many files, in order, and never one task.
    """
    if target["format"] == "kafka":
        ordered = df.repartition(key).sortWithinPartitions(key, *order) if order else df
        keyed_messages(ordered, key).write.format("kafka").options(**target["options"]).save()
        return
    split_by = ["partition", key, *order]
    placed = df.withColumn("partition", assign_partition(F.col(key), partitions))
    ranged = placed.repartitionByRange(files, *split_by) if files else placed.repartitionByRange(*split_by)
    (ranged.sortWithinPartitions(*split_by).write.partitionBy("partition")
     .mode(target.get("mode", "append")).format(target["format"]).save(target["path"]))


def read_keyed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    with_partition = T.StructType([*schema.fields, T.StructField("partition", T.IntegerType())])
    return spark.read.schema(with_partition).parquet(path)
