"""The membership store: a log of changes; the last change of a pair holds.

Changes lie in shards by profile hash, so the segments of some profiles are found
in their shards alone; inside a file they are sorted by segment, so the members
of one segment are found by file statistics.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillmark.operators.segment_state import profile_shard
from rillmark.schemas import MEMBERSHIP
from rillmark.sinks.logs import append_batch, compact_log, fixed_shards, read_log

CHANGES = T.StructType([*MEMBERSHIP.fields, T.StructField("change", T.StringType()),
                        T.StructField("shard", T.IntegerType())])


def _laid_out(changes: DataFrame) -> DataFrame:
    # Four tasks and files per shard, so that a hot profile's shard is not one task.
    part = F.pmod(F.xxhash64("segment_id", "profile_id"), F.lit(4))
    return changes.repartition("shard", part).sortWithinPartitions("shard", "segment_id")


def write_membership(delta: DataFrame, path: str, batch_id: int, shards: int | None = None) -> None:
    """Record ``added`` and ``removed`` pairs of one batch; a retried batch replaces itself.

    The first write fixes the number of ``shards``.
    """
    shards = fixed_shards(delta.sparkSession, path, shards)
    sharded = delta.withColumn("shard", profile_shard(F.col("profile_id"), shards)).select(*CHANGES.names)
    append_batch(_laid_out(sharded), path, batch_id, "shard")


def _last_changes(log: DataFrame) -> DataFrame:
    return log.groupBy("shard", "segment_id", "profile_id").agg(F.max_by("change", "batch_id").alias("change"))


def read_membership(spark: SparkSession, path: str, before: int | None = None,
                    shards: Sequence[int] | None = None, tasks: int = 1) -> DataFrame:
    """Current pairs; filter by segment for its members or by profile for its segments.

    ``shards`` limits the reading to the shards of the profiles in question; with several ``tasks`` changes are dealt to that many.
    """
    log = read_log(spark, path, CHANGES, before)
    if shards is not None:
        log = log.where(F.col("shard").isin(list(shards)))
    if tasks > 1:
        log = log.repartition(tasks, "shard", "segment_id", "profile_id")
    return _last_changes(log).where(F.col("change") == "added").select("segment_id", "profile_id")


def compact_membership(spark: SparkSession, path: str) -> int | None:
    return compact_log(spark, path, CHANGES,
                       lambda log: _laid_out(_last_changes(log).where(F.col("change") == "added")), "shard")
