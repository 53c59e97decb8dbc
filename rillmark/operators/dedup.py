"""Deduplication with unbounded memory, and its statistics.

All forms combine copies before the shuffle, so a key that owns a third of the
rows reaches the reducer as one row per map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmark.functions import ratio
from rillmark.operators.scan import null_safe_join, positions, running


def dedup(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key; which of several unequal copies survives is not defined."""
    return rows.dropDuplicates(list(keys))


def unique_per_stream(rows: DataFrame, stream: str = "device_id", sequence: str = "sequence") -> DataFrame:
    """Distinct readings within each device's own delivery."""
    return dedup(rows, [stream, sequence])


def dedup_first(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The whole first row of each key, in arrival order.

    The smallest row is an aggregate and not a window rank: copies are thrown
    away in the map tasks.
    """
    rest = [c for c in rows.columns if c not in keys and c not in order]
    ranked = F.struct(*order, *rest)
    first = rows.groupBy(*keys).agg(F.min_by(ranked, F.struct(*order)).alias("_first"))
    return first.select(*[F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in rows.columns])


def dedup_verdict(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """All rows plus ``accepted``: true on the first of each key in arrival order.

    ``order`` must be unique within a key.  The join back is on key *and* order,
    so the copies of a hot key spread over all tasks.
    """
    keys, order = list(keys), list(order)
    first = (rows.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_first"))
             .select(*keys, *[F.col(f"_first.{c}").alias(c) for c in order], F.lit(True).alias("_hit")))
    return (null_safe_join(rows, first, keys + order, "left")
            .withColumn("accepted", F.col("_hit").isNotNull()).select(*rows.columns, "accepted"))


def dedup_counts(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Accepted and rejected rows; needs no order."""
    copies = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_copies"))
    return copies.agg(F.count(F.lit(1)).alias("accepted"),
                      F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("rejected"))


def duplicate_stats(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Unique rows, delivered rows and the duplicate fraction of the delivered ones."""
    copies = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_copies"))
    total = copies.agg(F.count(F.lit(1)).alias("unique_n"),
                       F.coalesce(F.sum("_copies"), F.lit(0)).alias("delivered_n"))
    return total.withColumn("dup_fraction", ratio(F.col("delivered_n") - F.col("unique_n"), F.col("delivered_n")))


def state_size(rows: DataFrame, group: str | None, id_column: str, cap: int) -> DataFrame:
    """Ids a bounded memory holds in the end, and groups it tracks."""
    groups = [] if group is None else [group]
    distinct = rows.select(*groups, id_column).distinct()
    held = distinct.groupBy(*groups).agg(F.least(F.count(F.lit(1)), F.lit(cap)).alias("_held"))
    return held.agg(F.coalesce(F.sum("_held"), F.lit(0)).alias("entries"), F.count(F.lit(1)).alias("groups"))


def state_trace(rows: DataFrame, group: str, id_column: str, order: Sequence[str], cap: int,
                every: int) -> DataFrame:
    """Remembered ids after each ``every`` arrived rows: ``sample`` (1, 2, …) and ``entries``.

    A group's memory grows by one per new id until it holds ``cap`` and stays
    there, so the trace follows from where each id came first.  Samples in
    which nothing grew are not listed: the value before them still holds.
    """
    placed = positions(rows.select(group, id_column, *order), [], order, "_arrival")
    first = placed.groupBy(group, id_column).agg(F.min("_arrival").alias("_arrival"))
    sample = (F.call_function("div", F.col("_arrival") - 1, F.lit(every).cast("long")) + 1).alias("sample")
    grown = first.groupBy(group, sample).agg(F.count(F.lit(1)).alias("_new"))
    per_group = running(grown, [group], "sample", 4096, sums=["_new"])
    capped = per_group.select(
        "sample", (F.least(F.col("run__new"), F.lit(cap))
                   - F.least(F.col("run__new") - F.col("_new"), F.lit(cap))).alias("_delta"))
    deltas = capped.groupBy("sample").agg(F.sum("_delta").alias("_delta"))
    return running(deltas, [], "sample", 4096, sums=["_delta"]).select(
        "sample", F.col("run__delta").alias("entries"))


def state_peak(trace: DataFrame, rows: DataFrame, group: str, cap: int) -> DataFrame:
    """Peak of a trace, the bound ``groups * cap`` and whether the peak keeps it."""
    none = F.lit(None).cast("long")
    peak = trace.agg(F.max("entries").alias("peak"), none.alias("bound"))
    bound = rows.agg(none.alias("peak"), (F.count_distinct(group) * cap).alias("bound"))
    both = peak.unionByName(bound).agg(F.max("peak").alias("peak"), F.max("bound").alias("bound"))
    return both.withColumn("ok", F.col("peak") <= F.col("bound"))


def shard_of(id_column: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(id_column), F.lit(shards)).cast("int")
