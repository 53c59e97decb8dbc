"""Segment membership, computed in full from the event log.

``events`` hold ``profile_id, event_type, timestamp_ms, attributes`` without
repeated events (see ``dedup``).  ``as_of`` is a number of epoch milliseconds,
so the time bounds are literals and reach the scan; later events are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmark.functions import DAY_MS, HOUR_MS, at_least, attribute, clock_seconds_between, with_amount
from rillmark.operators import definitions as d
from rillmark.operators.definitions import Segment
from rillmark.operators.ranges import between

DAY_SECONDS = 86_400


def is_purchase() -> Column:
    return F.col("event_type") == "purchase"


def is_cart() -> Column:
    return F.col("event_type") == "add_to_cart"


def is_view() -> Column:
    return F.col("event_type") == "page_view"


def _until(events: DataFrame, as_of: int) -> DataFrame:
    return between(events, high_ms=as_of)


def _purchases(events: DataFrame, as_of: int, window_days: int) -> DataFrame:
    return between(events, as_of - window_days * DAY_MS, as_of).where(is_purchase())


def purchase_price() -> Column:
    return F.when(is_purchase(), F.col("attributes")["price"])


def viewed_category(attributes: Column) -> Column:
    return F.when(is_view(), attribute(attributes, "category"))


# One function per family -----------------------------------------------------------------

def segment_purchase_count(events: DataFrame, as_of: int, min_count: int, window_days: int) -> DataFrame:
    counts = _purchases(events, as_of, window_days).groupBy("profile_id").agg(F.count(F.lit(1)).alias("_n"))
    return counts.where(F.col("_n") >= min_count).select("profile_id")


def segment_purchase_value(events: DataFrame, as_of: int, min_value: float, window_days: int) -> DataFrame:
    priced = with_amount(_purchases(events, as_of, window_days), F.col("attributes")["price"])
    spend = priced.groupBy("profile_id").agg(F.sum("_amount").alias("_amount"), F.sum("_fine").alias("_fine"))
    return spend.where(at_least("_amount", "_fine", min_value)).select("profile_id")


def segment_cart_abandon(events: DataFrame, as_of: int, min_days: int) -> DataFrame:
    last = _until(events, as_of).where(is_cart() | is_purchase()).groupBy("profile_id").agg(
        _last_or_epoch(is_cart()).alias("_cart"), _last_or_epoch(is_purchase()).alias("_purchase"))
    idle = clock_seconds_between(F.col("_cart"), F.lit(as_of)) >= min_days * DAY_SECONDS
    return last.where((F.col("_cart") > F.col("_purchase")) & idle).select("profile_id")


def segment_category_views(events: DataFrame, as_of: int, category: str, min_count: int) -> DataFrame:
    views = _until(events, as_of).where(is_view() & (attribute(F.col("attributes"), "category") == category))
    counts = views.groupBy("profile_id").agg(F.count(F.lit(1)).alias("_n"))
    return counts.where(F.col("_n") >= min_count).select("profile_id")


def segment_recently_active(events: DataFrame, as_of: int, min_hours: int) -> DataFrame:
    recent = between(events, as_of - min_hours * HOUR_MS, as_of)
    return recent.select("profile_id").distinct()


def segment_never_purchased(events: DataFrame, as_of: int) -> DataFrame:
    counts = _until(events, as_of).groupBy("profile_id").agg(F.count_if(is_purchase()).alias("_n"))
    return counts.where(F.col("_n") == 0).select("profile_id")


def segment_churn_risk(events: DataFrame, as_of: int, min_days: int) -> DataFrame:
    seen = _until(events, as_of).groupBy("profile_id").agg(
        F.count_if(is_purchase()).alias("_n"), F.max("timestamp_ms").alias("_last"))
    idle = clock_seconds_between(F.col("_last"), F.lit(as_of)) >= min_days * DAY_SECONDS
    return seen.where((F.col("_n") >= 1) & idle).select("profile_id")


def segment_multi_category(events: DataFrame, as_of: int, min_distinct: int,
                           ignore_missing: bool = False) -> DataFrame:
    """A page view without a category counts as the category '' unless ``ignore_missing``."""
    pairs = _until(events, as_of).where(is_view()).select(
        "profile_id", attribute(F.col("attributes"), "category").alias("_category"))
    if ignore_missing:
        pairs = pairs.where(F.col("_category") != "")
    counts = pairs.distinct().groupBy("profile_id").agg(F.count(F.lit(1)).alias("_n"))
    return counts.where(F.col("_n") >= min_distinct).select("profile_id")


def _last_or_epoch(condition: Column) -> Column:
    return F.coalesce(F.max(F.when(condition, F.col("timestamp_ms"))), F.lit(0).cast("long"))


# All definitions at once -----------------------------------------------------------------

class Measures:
    """The per-profile measures a list of definitions reads, and their column names."""

    def __init__(self, segments: Sequence[Segment]):
        self.count_days = sorted({s.window_days for s in segments if s.family == d.PURCHASE_COUNT})
        self.value_days = sorted({s.window_days for s in segments if s.family == d.PURCHASE_VALUE})
        self.categories = sorted({s.category for s in segments if s.family == d.CATEGORY_VIEWS})

    @staticmethod
    def buys(days: int) -> str:
        return f"buys_{days}d"

    @staticmethod
    def spend(days: int) -> str:
        """The column of the spend to six places; ``spend_fine`` names that of the places beyond."""
        return f"spend_{days}d"

    @staticmethod
    def spend_fine(days: int) -> str:
        return f"spend_fine_{days}d"

    def views(self, category: str) -> str:
        return f"views_{self.categories.index(category)}"

    @property
    def windows(self) -> list[str]:
        return [*map(self.buys, self.count_days), *map(self.spend, self.value_days), *map(self.spend_fine, self.value_days)]

    @property
    def longest_days(self) -> int:
        return max([*self.count_days, *self.value_days], default=0)


def _clock_seconds(ms: str) -> str:
    return f"(({ms} - pmod({ms}, 1000L)) div 1000)"


def text_literal(value: str) -> str:
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def condition(segment: Segment, measures: Measures, now: str) -> str:
    """The segment's condition on a row of measures, as SQL text.

    The row has ``events_n, purchases_n, last_event_ms, last_cart_ms,
    last_purchase_ms, categories_n`` and the window and category columns; ``now``
    is a literal or a column of it.  Text, because fifty conditions built call by
    call would cost more than small queries take to run.
    """
    family = segment.family
    idle_since = {d.CART_ABANDON: "last_cart_ms", d.CHURN_RISK: "last_event_ms"}.get(family, "last_event_ms")
    idle = f"{_clock_seconds(now)} - {_clock_seconds(idle_since)} >= {segment.min_days * DAY_SECONDS}"
    if family == d.PURCHASE_COUNT:
        return f"{measures.buys(segment.window_days)} >= {segment.min_count}"
    if family == d.PURCHASE_VALUE:
        days = segment.window_days
        return at_least(measures.spend(days), measures.spend_fine(days), segment.min_value)
    if family == d.CART_ABANDON:
        return f"last_cart_ms > last_purchase_ms AND {idle}"
    if family == d.CATEGORY_VIEWS:
        return f"{measures.views(segment.category)} >= {segment.min_count}"
    if family == d.RECENTLY_ACTIVE:
        return f"last_event_ms >= {now} - {segment.min_hours * HOUR_MS}L"
    if family == d.NEVER_PURCHASED:
        return "events_n > 0 AND purchases_n = 0"
    if family == d.CHURN_RISK:
        return f"purchases_n >= 1 AND {idle}"
    if family == d.MULTI_CATEGORY:
        return f"categories_n >= {segment.min_distinct}"
    raise ValueError(f"unknown segment family {family!r}")


def candidate_segments(segments: Sequence[Segment], measures: Measures, now: str) -> str:
    """SQL array with the id of each segment a row of measures belongs to, NULL for the others."""
    cases = [f"CASE WHEN {condition(s, measures, now)} THEN {text_literal(s.id)} END" for s in segments]
    return f"array({', '.join(cases)})"


def profile_measures(events: DataFrame, segments: Sequence[Segment], as_of: int,
                     ignore_missing: bool = False) -> DataFrame:
    """Everything the definitions need, one row per profile, from one scan.

    First per profile and viewed category, then per profile: both steps combine
    in the map tasks, the distinct categories need no set, and the second
    shuffle carries only a few rows per profile.
    """
    measures = Measures(segments)
    rows = with_amount(_until(events, as_of).select(
        "profile_id", "event_type", "timestamp_ms", viewed_category(F.col("attributes")).alias("_category"),
        purchase_price().alias("_price")), F.col("_price"))

    def since(days: int) -> str:
        return f"event_type = 'purchase' AND timestamp_ms >= {as_of - days * DAY_MS}L"

    fine = rows.groupBy("profile_id", "_category").agg(*map(F.expr, [
        "count(1) AS events_n",
        "count_if(event_type = 'purchase') AS purchases_n",
        "max(timestamp_ms) AS last_event_ms",
        "max(CASE WHEN event_type = 'add_to_cart' THEN timestamp_ms END) AS last_cart_ms",
        "max(CASE WHEN event_type = 'purchase' THEN timestamp_ms END) AS last_purchase_ms",
        *[f"count_if({since(days)}) AS {measures.buys(days)}" for days in measures.count_days],
        *[f"sum(CASE WHEN {since(days)} THEN _amount END) AS {measures.spend(days)}" for days in measures.value_days],
        *[f"sum(CASE WHEN {since(days)} THEN _fine END) AS {measures.spend_fine(days)}" for days in measures.value_days]]))
    is_category = "_category != ''" if ignore_missing else "_category IS NOT NULL"
    return fine.groupBy("profile_id").agg(*map(F.expr, [
        "sum(events_n) AS events_n",
        "sum(purchases_n) AS purchases_n",
        "max(last_event_ms) AS last_event_ms",
        "coalesce(max(last_cart_ms), 0L) AS last_cart_ms",
        "coalesce(max(last_purchase_ms), 0L) AS last_purchase_ms",
        f"count_if({is_category}) AS categories_n",
        *[f"sum({name}) AS {name}" for name in measures.windows],
        *[f"coalesce(sum(CASE WHEN _category = {text_literal(c)} THEN events_n END), 0L) AS {measures.views(c)}"
          for c in measures.categories]]))


def evaluate_segments(events: DataFrame, segments: Sequence[Segment], as_of: int,
                      ignore_missing: bool = False) -> DataFrame:
    """``(segment_id, profile_id)`` for all definitions: one scan, not one per definition.

    The definitions become columns of one projection, so there is no cross join.
    """
    rows = profile_measures(events, segments, as_of, ignore_missing)
    return members_from(rows, segments, f"{as_of}L")


def members_from(rows: DataFrame, segments: Sequence[Segment], now: str) -> DataFrame:
    """One row per profile and segment that holds; all of it in generated code."""
    candidates = candidate_segments(segments, Measures(segments), now)
    return rows.select(F.expr(f"explode({candidates}) AS segment_id"), "profile_id").where("segment_id IS NOT NULL")


def segment_sizes(membership: DataFrame, definitions: DataFrame) -> DataFrame:
    """Members per definition, 0 for an empty segment."""
    counts = membership.groupBy("segment_id").agg(F.count(F.lit(1)).alias("_n"))
    return (definitions.select(F.col("id").alias("segment_id")).join(counts, "segment_id", "left")
            .select("segment_id", F.coalesce(F.col("_n"), F.lit(0)).alias("n")))


def members_of(membership: DataFrame, segment_id: str) -> DataFrame:
    return membership.where(F.col("segment_id") == segment_id).select("profile_id")


def profile_segments(membership: DataFrame) -> DataFrame:
    """The sorted segment ids of each profile; at most one per definition."""
    return membership.groupBy("profile_id").agg(F.sort_array(F.collect_set("segment_id")).alias("segments"))


def membership_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Pairs to add to and to remove from ``before`` to reach ``after``."""
    rows = (before.select("segment_id", "profile_id", F.lit(False).alias("_after"))
            .unionByName(after.select("segment_id", "profile_id", F.lit(True).alias("_after"))))
    sides = rows.groupBy("segment_id", "profile_id").agg(
        F.bool_or("_after").alias("_new"), F.bool_or(~F.col("_after")).alias("_old"))
    change = F.when(F.col("_new"), "added").otherwise("removed")
    return sides.where(F.col("_new") != F.col("_old")).select("segment_id", "profile_id", change.alias("change"))


def apply_delta(before: DataFrame, delta: DataFrame) -> DataFrame:
    """The membership after ``delta``; applying it twice changes nothing more."""
    rows = (before.select("segment_id", "profile_id", F.lit(0).alias("_rank"), F.lit("added").alias("change"))
            .unionByName(delta.select("segment_id", "profile_id", F.lit(1).alias("_rank"), "change")))
    last = rows.groupBy("segment_id", "profile_id").agg(F.max_by("change", "_rank").alias("change"))
    return last.where(F.col("change") == "added").select("segment_id", "profile_id")


# Per-profile statistics ------------------------------------------------------------------

def profile_stats(events: DataFrame) -> DataFrame:
    return events.groupBy("profile_id").agg(
        F.count(F.lit(1)).alias("events_n"), F.count_if(is_purchase()).alias("purchases_n"),
        F.max("timestamp_ms").alias("last_event_ms"), _last_or_epoch(is_cart()).alias("last_cart_ms"),
        _last_or_epoch(is_purchase()).alias("last_purchase_ms"))


def category_views(events: DataFrame) -> DataFrame:
    """Page views per profile and category; views without a category are left out."""
    views = events.where(is_view()).select(
        "profile_id", attribute(F.col("attributes"), "category").alias("category"))
    return (views.where(F.col("category") != "")
            .groupBy("profile_id", "category").agg(F.count(F.lit(1)).alias("views")))
