"""Comparisons of two tables that should agree.

Each is one union and one aggregation and not a join of two aggregates: a single
shuffle, combined in the map tasks, so hot groups and repeated ids do no harm.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _sides(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    return (left.select(*columns, F.lit(True).alias("_left"))
            .unionByName(right.select(*columns, F.lit(False).alias("_left"))))


def diff_sets(left: DataFrame, right: DataFrame, group: str, id_column: str,
              groups: DataFrame | None = None) -> DataFrame:
    """Per group: both sizes, ids on one side only, and whether the sets are equal.

    Repeated ids count once.  ``groups`` names groups to report even when both sides are empty.
    """
    rows = _sides(left, right, [group, id_column]).withColumn("_listed", F.lit(False))
    if groups is not None:
        empty = groups.select(
            F.col(group), F.lit(None).cast(left.schema[id_column].dataType).alias(id_column),
            F.lit(False).alias("_left"), F.lit(True).alias("_listed"))
        rows = rows.unionByName(empty)
    ids = rows.groupBy(group, id_column, "_listed").agg(
        F.bool_or("_left").alias("_in_left"), F.bool_or(~F.col("_left")).alias("_in_right"))
    member = ~F.col("_listed")
    counted = ids.groupBy(group).agg(
        F.count_if(member & F.col("_in_left")).alias("left_n"),
        F.count_if(member & F.col("_in_right")).alias("right_n"),
        F.count_if(member & F.col("_in_left") & ~F.col("_in_right")).alias("only_left"),
        F.count_if(member & F.col("_in_right") & ~F.col("_in_left")).alias("only_right"))
    return counted.withColumn("exact", (F.col("only_left") == 0) & (F.col("only_right") == 0))


def diff_totals(diff: DataFrame) -> DataFrame:
    """Groups, exact groups and ids that differ, over a ``diff_sets`` result."""
    return diff.agg(
        F.count(F.lit(1)).alias("groups_n"), F.count_if("exact").alias("exact_n"),
        F.coalesce(F.sum(F.col("only_left") + F.col("only_right")), F.lit(0)).alias("mismatched_n"))


def multiset_diff(left: DataFrame, right: DataFrame, id_column: str) -> DataFrame:
    """Ids that do not occur equally often on both sides, with both counts."""
    counts = _sides(left, right, [id_column]).groupBy(id_column).agg(
        F.count_if("_left").alias("left_n"), F.count_if(~F.col("_left")).alias("right_n"))
    return counts.where(F.col("left_n") != F.col("right_n"))


def multiset_equal(left: DataFrame, right: DataFrame, id_column: str) -> bool:
    return multiset_diff(left, right, id_column).isEmpty()


def reconcile(expected: DataFrame, actual: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per key: expected and actual sum of ``value`` and whether they are equal.

    Keys of either side are listed; a missing one counts 0.
    """
    rows = _sides(expected, actual, [*keys, value])
    sums = rows.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(F.col("_left"), F.col(value))), F.lit(0)).alias("expected_n"),
        F.coalesce(F.sum(F.when(~F.col("_left"), F.col(value))), F.lit(0)).alias("actual_n"))
    return sums.withColumn("exact", F.col("expected_n") == F.col("actual_n"))


def reconcile_totals(result: DataFrame) -> DataFrame:
    """Pairs, exact pairs, both totals and whether everything is exact."""
    totals = result.agg(
        F.count(F.lit(1)).alias("pairs_n"), F.count_if("exact").alias("exact_n"),
        F.coalesce(F.sum("expected_n"), F.lit(0)).alias("expected_n"),
        F.coalesce(F.sum("actual_n"), F.lit(0)).alias("actual_n"))
    return totals.withColumn("exact", F.col("pairs_n") == F.col("exact_n"))


def lost_records(sent: DataFrame, landed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct records sent, landed, and sent but not landed."""
    ids = _sides(sent, landed, keys).groupBy(*keys).agg(
        F.bool_or("_left").alias("_sent"), F.bool_or(~F.col("_left")).alias("_landed"))
    return ids.agg(F.count_if("_sent").alias("sent"), F.count_if("_landed").alias("landed"),
                   F.count_if(F.col("_sent") & ~F.col("_landed")).alias("lost"))


def lost_ids(sent: DataFrame, landed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The records behind ``lost``; swap the arguments for records nobody sent."""
    ids = _sides(sent, landed, keys).groupBy(*keys).agg(F.bool_and("_left").alias("_only_sent"))
    return ids.where("_only_sent").drop("_only_sent")
