"""Mergeable per-profile facts, from which every segment can be decided without the log.

A fact row says how often something was seen of a profile: any event (``seen``),
a purchase (``bought``), purchases at one millisecond (``bought_at``), a cart
(``cart``) or views of a category (``view``).  Facts of different batches are
summed, in any order and grouping, so late and reordered events need no care.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillmark.functions import DAY_MS, with_amount
from rillmark.operators.dedup import shard_of
from rillmark.operators.definitions import Segment
from rillmark.operators.segments import Measures, is_cart, is_purchase, is_view, members_from, purchase_price, text_literal, viewed_category

AMOUNTS, FINE = T.DecimalType(38, 6), T.DecimalType(38, 0)
FACTS = T.StructType([
    T.StructField("profile_id", T.StringType()),
    T.StructField("facet", T.StringType()),
    T.StructField("item", T.StringType()),
    T.StructField("n", T.LongType()),
    T.StructField("amount", AMOUNTS),
    T.StructField("fine", FINE),
    T.StructField("last_ms", T.LongType()),
    T.StructField("shard", T.IntegerType()),
])


def profile_shard(profile: Column, shards: int) -> Column:
    return shard_of(profile, shards)


def facts_of(events: DataFrame, shards: int) -> DataFrame:
    """Facts of deduplicated events; combined in the map tasks before the shuffle."""
    def fact(facet: str, item: Column, amount: Column = F.lit(0), fine: Column = F.lit(None)) -> Column:
        return F.struct(F.lit(facet).alias("facet"), item.alias("item"), amount.cast(AMOUNTS).alias("amount"),
                        fine.cast(FINE).alias("fine"))

    no_item = F.lit("")
    listed = F.array_compact(F.array(
        fact("seen", no_item),
        F.when(is_purchase(), fact("bought", no_item)),
        F.when(is_purchase(), fact("bought_at", F.col("timestamp_ms").cast("string"), F.col("_amount"), F.col("_fine"))),
        F.when(is_cart(), fact("cart", no_item)),
        F.when(is_view(), fact("view", viewed_category(F.col("attributes"))))))
    rows = with_amount(events, purchase_price()).select("profile_id", "timestamp_ms", F.explode(listed).alias("_fact"))
    counted = rows.groupBy("profile_id", F.col("_fact.facet").alias("facet"), F.col("_fact.item").alias("item")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("_fact.amount").alias("amount"), F.sum("_fact.fine").alias("fine"),
        F.max("timestamp_ms").alias("last_ms"))
    return counted.withColumn("shard", profile_shard(F.col("profile_id"), shards))


def merge_facts(facts: DataFrame) -> DataFrame:
    return facts.groupBy("shard", "profile_id", "facet", "item").agg(
        F.sum("n").alias("n"), F.sum("amount").alias("amount"), F.sum("fine").alias("fine"), F.max("last_ms").alias("last_ms"))


def trim_facts(facts: DataFrame, segments: Sequence[Segment]) -> DataFrame:
    """Drop purchases that no window of ``segments`` can reach any more, not even as of their profile's newest event."""
    reach = Measures(segments).longest_days * DAY_MS
    own = facts.where("facet = 'seen'").groupBy("shard", "profile_id").agg((F.max("last_ms") - reach).alias("_oldest"))
    kept = (F.col("facet") != "bought_at") | (F.col("last_ms") >= F.col("_oldest"))
    return facts.join(own, ["shard", "profile_id"]).where(kept).select(*facts.columns)


def members_from_facts(facts: DataFrame, segments: Sequence[Segment], as_of: int | None = None) -> DataFrame:
    """``(segment_id, profile_id)`` as of a time not before the newest event folded in.

    Without ``as_of`` each profile is decided as of its own newest event.
    """
    measures = Measures(segments)
    merged, now = merge_facts(facts), f"{as_of}L"
    if as_of is None:
        own = merged.where("facet = 'seen'").groupBy("shard", "profile_id").agg(F.max("last_ms").alias("now"))
        merged, now = merged.join(own, ["shard", "profile_id"]), "now"

    def within(days: int) -> str:
        return f"facet = 'bought_at' AND last_ms BETWEEN {now} - {days * DAY_MS}L AND {now}"

    def total(chosen: str, value: str = "n") -> str:
        return f"coalesce(sum(CASE WHEN {chosen} THEN {value} END), 0L)"

    def newest(facet: str) -> str:
        return f"coalesce(max(CASE WHEN facet = '{facet}' THEN last_ms END), 0L)"

    rows = merged.groupBy("profile_id").agg(*map(F.expr, [
        f"max({now}) AS now",
        total("facet = 'seen'") + " AS events_n", total("facet = 'bought'") + " AS purchases_n",
        newest("seen") + " AS last_event_ms", newest("cart") + " AS last_cart_ms",
        newest("bought") + " AS last_purchase_ms", "count_if(facet = 'view') AS categories_n",
        *[f"{total(within(days))} AS {measures.buys(days)}" for days in measures.count_days],
        *[f"{total(within(days), 'amount')} AS {measures.spend(days)}" for days in measures.value_days],
        *[f"{total(within(days), 'fine')} AS {measures.spend_fine(days)}" for days in measures.value_days],
        *[total("facet = 'view' AND item = " + text_literal(c)) + f" AS {measures.views(c)}"
          for c in measures.categories]]))
    return members_from(rows, segments, "now")
