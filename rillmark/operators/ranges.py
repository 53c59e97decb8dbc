"""Time bounds that reach the scan."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmark.functions import DAY_MS


def _day(ms: int) -> date:
    return date(1970, 1, 1) + timedelta(days=ms // DAY_MS)


def between(rows: DataFrame, low_ms: int | None = None, high_ms: int | None = None) -> DataFrame:
    """Rows with ``timestamp_ms`` in the given bounds, both inclusive.

    The bounds are literals, so file statistics apply; on an event store, which
    has an ``event_date``, they also pick the date folders to read.
    """
    dated = "event_date" in rows.columns
    if low_ms is not None:
        rows = rows.where(F.col("timestamp_ms") >= low_ms)
        rows = rows.where(F.col("event_date") >= F.lit(_day(low_ms))) if dated else rows
    if high_ms is not None:
        rows = rows.where(F.col("timestamp_ms") <= high_ms)
        rows = rows.where(F.col("event_date") <= F.lit(_day(high_ms))) if dated else rows
    return rows
