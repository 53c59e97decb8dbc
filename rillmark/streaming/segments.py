"""Segment membership kept up to date from a stream of deduplicated events.

Each micro-batch is reduced to mergeable facts, which are appended to a log, and
the profiles it touched are decided again from their facts alone.  The facts lie
in ``shards`` by profile hash, so a micro-batch reads only the shards it
touches.  Memberships that change through time alone are settled by
``finalize_segments``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rillmark.operators.definitions import Segment
from rillmark.operators.segment_state import FACTS, facts_of, members_from_facts, merge_facts, trim_facts
from rillmark.operators.segments import membership_delta
from rillmark.session import dealt_by_rows, task_count
from rillmark.sinks.logs import append_batch, compact_log, fixed_shards, read_log
from rillmark.sinks.membership import CHANGES, compact_membership, read_membership, write_membership
from rillmark.streaming.running import each_batch

# Change numbers between two micro-batches, for final passes.
_STEP = 1 << 20


def _facts_path(path: str) -> str:
    return f"{path}/facts"


def _changes_path(path: str) -> str:
    return f"{path}/membership"


def _rows(spark: SparkSession, path: str) -> int:
    """Rows of both logs, from the footers of their files."""
    return read_log(spark, _facts_path(path), FACTS).count() + read_log(spark, _changes_path(path), CHANGES).count()


def fold_batch(spark: SparkSession, batch: DataFrame, batch_id: int, segments: Sequence[Segment], path: str,
               shards: int | None = None) -> None:
    """Add one micro-batch and write the membership changes of the profiles in it.

    Each profile is decided as of its own newest event, so a late batch undoes nothing.
    ``spark`` is the session
    the stream was built in: the session of a micro-batch runs without adaptive
    execution, which the joins on the logs should have.
    """
    shards = fixed_shards(spark, _facts_path(path), shards)
    # At most four files per shard and micro-batch; the facts of a hot profile spread over them.
    spread = F.pmod(F.xxhash64("facet", "item"), F.lit(4))
    append_batch(facts_of(batch, shards).repartition("shard", spread), _facts_path(path), batch_id, "shard")
    fresh = read_log(spark, _facts_path(path), FACTS).where(F.col("batch_id") == batch_id)
    # At most one row per shard; as literals they pick the folders to read.
    in_shards = [row["shard"] for row in fresh.select("shard").distinct().collect()]
    if not in_shards:
        return
    touched = fresh.select("shard", "profile_id").distinct()
    log = read_log(spark, _facts_path(path), FACTS).where(F.col("shard").isin(in_shards))
    after = members_from_facts(log.join(touched, ["shard", "profile_id"], "left_semi"), segments)
    change = batch_id * _STEP
    before = read_membership(spark, _changes_path(path), change, in_shards).join(
        touched.select("profile_id"), "profile_id", "left_semi")
    with dealt_by_rows(spark, _rows(spark, path)):
        write_membership(membership_delta(before, after), _changes_path(path), change, shards)


def incremental_segments(events: DataFrame, segments: Sequence[Segment], path: str, checkpoint: str,
                         trigger: dict | None = None, shards: int | None = None, compact_every: int = 20) -> StreamingQuery:
    """Fold each micro-batch.  The logs are merged after every ``compact_every`` of them, so what a micro-batch
    reads does not grow with their number; a retry reads what it read before, as merged folders stay."""
    spark = events.sparkSession

    def fold(batch: DataFrame, batch_id: int) -> None:
        fold_batch(spark, batch, batch_id, segments, path, shards)
        if (batch_id + 1) % compact_every == 0:
            compact_segments(spark, path, segments)

    return each_batch(events, fold, checkpoint, trigger)


def current_segments(spark: SparkSession, path: str) -> DataFrame:
    """``(segment_id, profile_id)`` as last decided."""
    return read_membership(spark, _changes_path(path), tasks=task_count(read_log(spark, _changes_path(path), CHANGES).count()))


def newest_event(spark: SparkSession, path: str) -> int | None:
    return read_log(spark, _facts_path(path), FACTS).where(F.col("facet") == "seen").agg(
        F.max("last_ms")).first()[0]


def finalize_segments(spark: SparkSession, path: str, segments: Sequence[Segment],
                      as_of: int | None = None) -> DataFrame:
    """Decide every profile again as of ``as_of`` (by default the newest event), write the
    changes and return the membership."""
    newest = newest_event(spark, path)
    if newest is None:
        return current_segments(spark, path)
    as_of = newest if as_of is None else as_of
    if as_of < newest:
        raise ValueError(f"facts already hold events up to {newest}, later than {as_of}")
    after = members_from_facts(read_log(spark, _facts_path(path), FACTS), segments, as_of)
    last = read_log(spark, _changes_path(path), CHANGES).agg(F.max("batch_id")).first()[0]
    if last is not None and (last + 1) % _STEP == 0:
        raise RuntimeError("too many final passes between two micro-batches")
    delta = membership_delta(current_segments(spark, path), after)
    with dealt_by_rows(spark, _rows(spark, path)):
        write_membership(delta, _changes_path(path), 1 if last is None else last + 1)
    return current_segments(spark, path)


def compact_segments(spark: SparkSession, path: str, segments: Sequence[Segment]) -> None:
    """Merge both logs, dropping purchases no window reaches any more.  Run between micro-batches."""
    with dealt_by_rows(spark, _rows(spark, path)):
        compact_log(spark, _facts_path(path), FACTS, lambda log: trim_facts(merge_facts(log), segments), "shard")
        compact_membership(spark, _changes_path(path))
