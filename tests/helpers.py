"""Small frames and plain loops to compare with."""

from __future__ import annotations

import random

from rillmark.schemas import READING, STOREFRONT_EVENT

DAY = 86_400_000


def storefront(spark, rows):
    """``rows`` of (event_id, profile_id, event_type, timestamp_ms, attributes)."""
    return spark.createDataFrame(rows, STOREFRONT_EVENT)


def readings(spark, rows):
    return spark.createDataFrame([(d, s, 1_700_000_000_000 + s * 1000, float(v)) for d, s, v in rows], READING)


def column(df, name):
    return sorted(row[name] for row in df.collect())


def random_events(seed: int, profiles: int = 12, events: int = 400, days: int = 120) -> list[tuple]:
    rng = random.Random(seed)
    categories = ["electronics", "toys", "books", None]
    rows = []
    for number in range(events):
        kind = rng.choice(["page_view", "page_view", "add_to_cart", "purchase", "cart_abandon"])
        attributes = {}
        category = rng.choice(categories)
        if category:
            attributes["category"] = category
        if kind in ("purchase", "add_to_cart"):
            attributes["price"] = rng.choice(["19.99", "120.5", "x", "300"])
        # Half the events fall on one profile, and many share a millisecond.
        profile = 0 if rng.random() < 0.5 else rng.randrange(1, profiles)
        at = rng.randrange(days) * DAY + rng.randrange(4) * 3_600_000 + rng.randrange(2)
        rows.append((f"e{number:05d}", f"p{profile}", kind, 1_700_000_000_000 + at, attributes))
    return rows


def price(attributes) -> float:
    try:
        return float(attributes.get("price", "0"))
    except ValueError:
        return 0.0


def holds(segment, events, now) -> bool:
    """Whether a profile with these events is in the segment at ``now``; a plain loop."""
    seen = [e for e in events if e[3] <= now]
    if not seen:
        return False
    bought = [e for e in seen if e[2] == "purchase"]
    views = [e[4].get("category", "") for e in seen if e[2] == "page_view"]
    recent = [e for e in bought if e[3] >= now - segment.window_days * DAY]
    last = max(e[3] for e in seen)
    cart = max([e[3] for e in seen if e[2] == "add_to_cart"], default=0)
    last_bought = max([e[3] for e in bought], default=0)

    def idle(since):
        return now // 1000 - since // 1000 >= segment.min_days * 86_400

    return {
        "purchase_count_min": lambda: len(recent) >= segment.min_count,
        "purchase_value_min": lambda: bool(recent) and round(sum(price(e[4]) for e in recent), 6) >= segment.min_value,
        "cart_abandon_days": lambda: cart > last_bought and idle(cart),
        "category_view_min": lambda: views.count(segment.category) >= segment.min_count,
        "recently_active_hours": lambda: last >= now - segment.min_hours * 3_600_000,
        "never_purchased": lambda: not bought,
        "churn_risk_days": lambda: bool(bought) and idle(last),
        "multi_category_shopper_min": lambda: len(set(views)) >= segment.min_distinct,
    }[segment.family]()


def members(segments, rows, now) -> set[tuple[str, str]]:
    by_profile: dict[str, list] = {}
    for row in rows:
        by_profile.setdefault(row[1], []).append(row)
    return {(s.id, p) for p, events in by_profile.items() for s in segments if holds(s, events, now)}


def pairs(df) -> set[tuple[str, str]]:
    rows = [(r["segment_id"], r["profile_id"]) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)
