"""What was true of a profile at each of its events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmark.functions import DAY_MS, FINE_TYPE, HOUR_MS, SPEND_TYPE, with_amount
from rillmark.operators.definitions import Segment
from rillmark.operators.scan import STRETCH, null_safe_join, positions, previous, running
from rillmark.operators.segments import Measures, candidate_segments, is_cart, is_purchase, purchase_price, viewed_category

# What is summed per window: the column of a row, the prefix of its running sums and their type.
WINDOWED = {"_buys": ("buys", "long"), "_amount": ("spend", SPEND_TYPE), "_fine": ("spend_fine", FINE_TYPE)}


def _none() -> Column:
    return F.lit(0).cast("long")


def _windows(days: Sequence[int]) -> dict[str, str]:
    """The columns of running sums and their types."""
    return {f"{kind}_{day}d": of_type for day in days for kind, of_type in WINDOWED.values()}


def profile_timeline(events: DataFrame, stretch_ms: int | None = None) -> DataFrame:
    """Events of each profile numbered by ``(timestamp_ms, event_id)``.

    ``stretch_ms`` is taken for callers of the earlier form; ranges of rows need no width.
    """
    rows = events.select("profile_id", "event_id", "timestamp_ms")
    return positions(rows, ["profile_id"], ["timestamp_ms", "event_id"])


def _entering_and_leaving(own: Column, days: Sequence[int], rest: Sequence[Column]) -> Column:
    """One row as a list: itself, and for every window the moment it drops out again.

    A row at t counts for every moment in [t, t + window]; adding it at t and
    taking it off at t + window + 1 ms turns a trailing window into a running sum.
    """
    def entry(at: Column, is_own: bool, leaving: int | None) -> Column:
        def windowed(value: str, day: int) -> Column:
            if leaving is None:
                return F.col(value)
            return -F.col(value) if day == leaving else F.lit(0)

        return F.struct(
            at.alias("at"), F.lit(is_own).alias("own"),
            *[c if leaving is None else F.lit(None).alias(name) for name, c in rest],
            *[windowed(value, day).cast(of_type).alias(f"{kind}_{day}d")
              for value, (kind, of_type) in WINDOWED.items() for day in days])

    leaves = [entry(own + (day * DAY_MS + 1), False, day) for day in days]
    first = entry(own, True, None)
    if not leaves:
        return F.array(first)
    # Only purchases ever leave a window.
    return F.when(F.col("_buys") > 0, F.array(first, *leaves)).otherwise(F.array(first))


def rolling_purchases(events: DataFrame, days: Sequence[int] = (30,), stretch_ms: int = HOUR_MS) -> DataFrame:
    """For each purchase: the profile's purchases and spend in the trailing windows that end with it.

    Purchases of the same millisecond see each other.  They are combined first,
    so a stretch is bounded by its milliseconds and not by the number of events.
    """
    purchases = events.where(is_purchase())
    points = with_amount(purchases, purchase_price()).groupBy("profile_id", "timestamp_ms").agg(
        F.count(F.lit(1)).alias("_buys"), F.sum("_amount").alias("_amount"), F.coalesce(F.sum("_fine"), F.lit(0)).alias("_fine"))
    moves = points.select("profile_id", F.explode(
        _entering_and_leaving(F.col("timestamp_ms"), days, [])).alias("_move")).select("profile_id", "_move.*")
    totals = running(moves, ["profile_id"], "at", stretch_ms, sums=list(_windows(days))).where("own").select(
        "profile_id", F.col("at").alias("timestamp_ms"),
        *[F.col(f"run_buys_{day}d").cast("long").alias(f"n_{day}d") for day in days],
        *[F.col(f"run_spend_{day}d").alias(f"value_{day}d") for day in days])
    return null_safe_join(purchases.select("profile_id", "timestamp_ms", "event_id"), totals, ["profile_id", "timestamp_ms"])


def membership_timeline(events: DataFrame, segments: Sequence[Segment], stretch_ms: int = HOUR_MS) -> DataFrame:
    """Every change of membership, evaluated at each event with the event's own time as now.

    Returns ``profile_id, event_id, timestamp_ms, segment_id, change`` with
    ``enter`` or ``exit``.  Events of one millisecond are one moment; its change
    is booked on the smallest event id.  A membership that ends between two
    events through time alone shows at the next event.
    """
    measures = Measures(segments)
    days = sorted({*measures.count_days, *measures.value_days})
    category = viewed_category(F.col("attributes"))
    moments = with_amount(events, purchase_price()).groupBy("profile_id", "timestamp_ms").agg(
        F.min("event_id").alias("event_id"),
        F.count(F.lit(1)).alias("events_n"),
        F.count_if(is_purchase()).alias("_buys"),
        F.sum("_amount").alias("_amount"),
        F.coalesce(F.sum("_fine"), F.lit(0)).alias("_fine"),
        F.coalesce(F.max(F.when(is_cart(), F.col("timestamp_ms"))), _none()).alias("last_cart_ms"),
        F.coalesce(F.max(F.when(is_purchase(), F.col("timestamp_ms"))), _none()).alias("last_purchase_ms"),
        *[F.count_if(category == c).alias(measures.views(c)) for c in measures.categories])
    views = [measures.views(c) for c in measures.categories]
    plain = ["event_id", "events_n", "_buys", "last_cart_ms", "last_purchase_ms", *views]
    moves = moments.select("profile_id", F.explode(_entering_and_leaving(
        F.col("timestamp_ms"), days, [(name, F.col(name)) for name in plain])).alias("_move")).select(
        "profile_id", "_move.*", _none().alias("new_categories"))
    # A category counts from the first moment it was viewed.
    first_views = (events.withColumn("_category", category).where(F.col("_category").isNotNull())
                   .groupBy("profile_id", "_category").agg(F.min("timestamp_ms").alias("at"))
                   .groupBy("profile_id", "at").agg(F.count(F.lit(1)).alias("new_categories"))
                   .withColumn("own", F.lit(False)))
    rows = moves.unionByName(first_views, allowMissingColumns=True)

    windows = _windows(days)
    sums = ["events_n", "_buys", "new_categories", *views, *windows]
    counted = rows.fillna(0, subset=["events_n", "_buys", *views]).withColumns(
        {w: F.coalesce(F.col(w), F.lit(0).cast(of_type)) for w, of_type in windows.items()})
    state = running(counted, ["profile_id"], "at", stretch_ms, sums=sums,
                    highs=["last_cart_ms", "last_purchase_ms"]).where("own")
    named = state.select(
        "profile_id", "event_id", "at", STRETCH,
        F.col("run_events_n").alias("events_n"), F.col("run__buys").alias("purchases_n"),
        F.col("at").alias("last_event_ms"), F.col("run_last_cart_ms").alias("last_cart_ms"),
        F.col("run_last_purchase_ms").alias("last_purchase_ms"),
        F.col("run_new_categories").alias("categories_n"),
        *[F.col(f"run_{name}").alias(name) for name in [*views, *windows]])
    held = named.select("profile_id", "event_id", "at", STRETCH,
                        F.array_compact(F.expr(candidate_segments(segments, measures, "at"))).alias("_now"))
    compared = previous(held, ["profile_id"], "at", "_now", "_before")
    nothing = F.array().cast("array<string>")
    before = F.coalesce(F.col("_before"), nothing)
    changes = F.concat(
        F.transform(F.array_except("_now", before),
                    lambda s: F.struct(s.alias("segment_id"), F.lit("enter").alias("change"))),
        F.transform(F.array_except(before, F.col("_now")),
                    lambda s: F.struct(s.alias("segment_id"), F.lit("exit").alias("change"))))
    return compared.select(
        "profile_id", "event_id", F.col("at").alias("timestamp_ms"), F.explode(changes).alias("_change")).select(
        "profile_id", "event_id", "timestamp_ms", "_change.segment_id", "_change.change")
