"""Running aggregates over an ordered key, without one task per key.

A plain ``Window.partitionBy(key).orderBy(at)`` sorts everything a key owns in
one task, which fails when one key owns a third of the data.  Here each key is
cut into stretches of ``width`` along ``at``: stretch totals are summed up per
key (few rows, combined before the shuffle), and the rows themselves are only
ordered within their own stretch.

NULL is a key like any other, and NULL orders before everything else.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rillmark.session import materialise

STRETCH = "_stretch"


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal ``keys`` where NULL equals NULL; keeps the columns of ``left`` and the others of ``right``."""
    renamed = right.select([F.col(c).alias(f"_key_{c}") if c in keys else F.col(c) for c in right.columns])
    condition = [F.col(key).eqNullSafe(F.col(f"_key_{key}")) for key in keys]
    return left.join(renamed, condition, how).drop(*[f"_key_{key}" for key in keys])


def stretch_of(at: str, width: int) -> Column:
    return F.floor(F.col(at) / F.lit(width)).cast("long")


def running(points: DataFrame, keys: Sequence[str], at: str, width: int,
            sums: Sequence[str] = (), highs: Sequence[str] = (), whole: Sequence[str] = ()) -> DataFrame:
    """Add ``run_<c>``: the sum (or maximum) of ``c`` over the key's rows up to this ``at``,
    and for the sums listed in ``whole`` also ``all_<c>``, the sum over all the key's rows.

    Rows with equal ``at`` see each other.  Rows must already be combined per
    ``(keys, at)`` up to a fixed factor, so a stretch holds at most ``width``
    times that factor.
    """
    keys = list(keys)
    cut = points.withColumn(STRETCH, stretch_of(at, width))
    totals = cut.groupBy(*keys, STRETCH).agg(
        *[F.sum(c).alias(f"_total_{c}") for c in sums], *[F.max(c).alias(f"_total_{c}") for c in highs])
    before = W.partitionBy(*keys).orderBy(STRETCH).rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select(
        *keys, STRETCH,
        *[F.sum(f"_total_{c}").over(before).alias(f"_before_{c}") for c in sums],
        *[F.max(f"_total_{c}").over(before).alias(f"_before_{c}") for c in highs],
        *[F.sum(f"_total_{c}").over(W.partitionBy(*keys)).alias(f"all_{c}") for c in whole])
    joined = null_safe_join(cut, carried, [*keys, STRETCH])
    here = W.partitionBy(*keys, STRETCH).orderBy(at).rangeBetween(W.unboundedPreceding, W.currentRow)
    return joined.select(
        *points.columns, STRETCH,
        *[(F.sum(c).over(here) + F.coalesce(F.col(f"_before_{c}"), F.lit(0))).alias(f"run_{c}") for c in sums],
        *[F.greatest(F.max(c).over(here), F.col(f"_before_{c}")).alias(f"run_{c}") for c in highs],
        *[f"all_{c}" for c in whole])


def previous(points: DataFrame, keys: Sequence[str], at: str, value: str, name: str) -> DataFrame:
    """Add ``name``: ``value`` at the key's previous ``at``.  ``points`` come from ``running``,
    one row per ``(keys, at)``.

    Only the first row of a stretch has to look back beyond it, at the last row of
    the stretch before.  First and last rows get a lane of their own, two rows per
    stretch; all others stay with their stretch.
    """
    keys = list(keys)
    here = W.partitionBy(*keys, STRETCH).orderBy(at)
    whole = W.partitionBy(*keys, STRETCH)
    marked = points.withColumns({
        "_inside": F.lag(value).over(here),
        "_first": F.col(at) == F.min(at).over(whole),
        "_edge": (F.col(at) == F.min(at).over(whole)) | (F.col(at) == F.max(at).over(whole))})
    lane = F.when(~F.col("_edge"), F.col(STRETCH))
    across = W.partitionBy(*keys, "_lane").orderBy(at)
    return (marked.withColumn("_lane", lane)
            .withColumn(name, F.when(F.col("_first"), F.lag(value).over(across)).otherwise(F.col("_inside")))
            .drop("_inside", "_first", "_edge", "_lane"))


def in_ranges(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``rows`` stored in order, with ``_place``, which counts up within a range, and ``_range``, the number of the range."""
    ordered = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    # The id holds the number of the range in its upper bits; stored, it stays as it is.
    placed = materialise(ordered.withColumn("_place", F.monotonically_increasing_id()), "positions")
    return placed.withColumn("_range", F.shiftright("_place", 33))


def positions(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "position", total: str | None = None) -> DataFrame:
    """Number the rows of each key 1, 2, 3 … by ``order``, and add the key's number of rows as ``total`` if named.

    Rows are sorted by key and order in ranges of about as many rows each, whatever a key or a moment owns, and stored with their
    place in their range.  What a range holds of a key is counted, the counts are summed along the ranges of the key, and the
    sums are joined back.  ``order`` must be unique within a key; rows equal in it get numbers in any order.
    """
    keys = list(keys)
    placed = in_ranges(rows, keys, order)
    counts = placed.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_rows"), F.min("_place").alias("_first"))
    before = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first") + 1
    whole = [F.sum("_rows").over(W.partitionBy(*keys)).alias(total)] if total else []
    carried = counts.select(*keys, "_range", shift.alias("_shift"), *whole)
    return (null_safe_join(placed, carried, [*keys, "_range"])
            .withColumn(name, F.col("_place") + F.col("_shift"))
            .drop("_place", "_range", "_shift"))
