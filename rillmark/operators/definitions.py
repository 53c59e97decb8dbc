"""Segment definitions are data: a family name and the parameters it reads."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from rillmark.schemas import SEGMENT

# The names of the segment families.
PURCHASE_COUNT = "purchase_count_min"
PURCHASE_VALUE = "purchase_value_min"
CART_ABANDON = "cart_abandon_days"
CATEGORY_VIEWS = "category_view_min"
RECENTLY_ACTIVE = "recently_active_hours"
NEVER_PURCHASED = "never_purchased"
CHURN_RISK = "churn_risk_days"
MULTI_CATEGORY = "multi_category_shopper_min"


class Segment(NamedTuple):
    id: str
    family: str
    min_count: int = 0
    window_days: int = 0
    category: str = ""
    min_value: float = 0.0
    min_hours: int = 0
    min_days: int = 0
    min_distinct: int = 0


# The parameters of the 50 standard segments.
CATEGORIES = ("electronics", "apparel", "home", "beauty", "sports", "books", "toys", "grocery")
PURCHASE_COUNTS = (1, 2, 3, 5)
PURCHASE_COUNT_DAYS = (7, 30, 90)
ABANDON_DAYS = (1, 3, 7, 14, 30)
CATEGORY_VIEW_COUNTS = (3, 5)
PURCHASE_VALUES = (100, 250, 500)
PURCHASE_VALUE_DAYS = (30, 90)
ACTIVE_HOURS = (1, 6, 24, 72)
CHURN_DAYS = (14, 30, 60)
DISTINCT_CATEGORIES = (2, 3, 4)


def standard_segments() -> list[Segment]:
    return [
        *(Segment(f"purchase_count_min_{n}_{w}d", PURCHASE_COUNT, min_count=n, window_days=w)
          for n in PURCHASE_COUNTS for w in PURCHASE_COUNT_DAYS),
        *(Segment(f"cart_abandon_{d}d", CART_ABANDON, min_days=d) for d in ABANDON_DAYS),
        *(Segment(f"category_view_min_{c}_{n}", CATEGORY_VIEWS, min_count=n, category=c)
          for c in CATEGORIES for n in CATEGORY_VIEW_COUNTS),
        *(Segment(f"purchase_value_min_{v}_{w}d", PURCHASE_VALUE, min_value=float(v), window_days=w)
          for v in PURCHASE_VALUES for w in PURCHASE_VALUE_DAYS),
        *(Segment(f"recently_active_{h}h", RECENTLY_ACTIVE, min_hours=h) for h in ACTIVE_HOURS),
        Segment("never_purchased", NEVER_PURCHASED),
        *(Segment(f"churn_risk_{d}d", CHURN_RISK, min_days=d) for d in CHURN_DAYS),
        *(Segment(f"multi_category_shopper_min_{k}", MULTI_CATEGORY, min_distinct=k) for k in DISTINCT_CATEGORIES),
    ]


def segment_definitions(spark: SparkSession, segments: list[Segment] | None = None) -> DataFrame:
    return spark.createDataFrame([tuple(s) for s in segments or standard_segments()], SEGMENT)
