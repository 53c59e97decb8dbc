"""Append-only logs of partial results, merged when read.

``<path>/delta/batch_id=<k>`` holds what batch ``k`` added; writing a batch again
replaces it, so a retried batch counts once.  ``<path>/base/upto=<k>`` holds
batches up to ``k`` merged; it counts from the moment its success marker exists.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillmark.session import child_names, path_exists, touch

MARKER = "_SUCCESS"
DEFAULT_SHARDS = 16


def append_batch(df: DataFrame, path: str, batch_id: int, partition_by: str | None = None) -> None:
    """Write what a batch adds."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(f"{path}/delta/batch_id={batch_id}")


def _listed(spark: SparkSession, path: str, prefix: str, after: int | None = None, before: int | None = None) -> list[int]:
    """Numbers of the folders under ``path`` that lie between two others, finished or not, ascending."""
    numbers = [int(n[len(prefix):]) for n in child_names(spark, path) if n.startswith(prefix)]
    return sorted(k for k in numbers if (after is None or k > after) and (before is None or k < before))


def _finished(spark: SparkSession, folder: str) -> bool:
    return path_exists(spark, f"{folder}/{MARKER}")


def merged_upto(spark: SparkSession, path: str, before: int | None = None) -> int | None:
    """The last batch of the newest finished base, of those below ``before``."""
    bases = reversed(_listed(spark, f"{path}/base", "upto=", before=before))
    return next((k for k in bases if _finished(spark, f"{path}/base/upto={k}")), None)


def _deltas(spark: SparkSession, path: str, after: int | None, before: int | None = None) -> list[int]:
    """Finished batches that are not merged yet; merged ones are not asked for."""
    listed = _listed(spark, f"{path}/delta", "batch_id=", after, before)
    return [k for k in listed if _finished(spark, f"{path}/delta/batch_id={k}")]


def read_log(spark: SparkSession, path: str, schema: T.StructType, before: int | None = None) -> DataFrame:
    """All partial rows with their ``batch_id``; merged ones carry the last batch merged.

    ``before`` leaves out batches from that one on, for a batch that is being retried.
    """
    with_batch = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    upto = merged_upto(spark, path, before)
    deltas = _deltas(spark, path, upto, before)
    frames = []
    if upto is not None:
        base = spark.read.schema(schema).parquet(f"{path}/base/upto={upto}")
        frames.append(base.withColumn("batch_id", F.lit(upto).cast("long")))
    if deltas:
        folders = [f"{path}/delta/batch_id={k}" for k in deltas]
        frames.append(spark.read.schema(with_batch).option("basePath", f"{path}/delta").parquet(*folders))
    if not frames:
        return spark.createDataFrame([], with_batch)
    return frames[0].unionByName(frames[1]) if len(frames) == 2 else frames[0].select(*with_batch.names)


def compact_log(spark: SparkSession, path: str, schema: T.StructType, merge: Callable[[DataFrame], DataFrame],
                partition_by: str | None = None) -> int | None:
    """Merge everything there is into a new base; returns the last batch in it.

    Superseded folders stay until removed by whoever owns the storage, so
    running readers are not disturbed.
    """
    upto = merged_upto(spark, path)
    deltas = _deltas(spark, path, upto)
    if not deltas:
        return upto
    merged = merge(read_log(spark, path, schema)).select(*schema.names)
    writer = merged.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(f"{path}/base/upto={deltas[-1]}")
    return deltas[-1]


def fixed_shards(spark: SparkSession, path: str, wanted: int | None = None) -> int:
    """The number of shards of a sharded log: noted by its first writer, the same for all others."""
    noted = [int(n[len("shards="):]) for n in child_names(spark, path) if n.startswith("shards=")]
    if not noted:
        noted = [wanted or DEFAULT_SHARDS]
        touch(spark, f"{path}/shards={noted[0]}")
    if wanted is not None and wanted != noted[0]:
        raise ValueError(f"{path} has {noted[0]} shards, not {wanted}")
    return noted[0]
