"""Time expressions over epoch-millisecond columns.

Everything stays in integer milliseconds until the last step, so results do not
depend on the session time zone and comparisons against literals reach the scan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTE_MS = 60_000
HOUR_MS = 3_600_000
DAY_MS = 86_400_000


def event_time(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def floor_ms(ms: Column, unit_ms: int) -> Column:
    """Largest multiple of ``unit_ms`` not above ``ms`` (also before 1970)."""
    return ms - F.pmod(ms, F.lit(unit_ms).cast("long"))


def minute_floor(ms: Column) -> Column:
    return F.timestamp_millis(floor_ms(ms, MINUTE_MS))


def clock_seconds_between(start_ms: Column, end_ms: Column) -> Column:
    """Difference of the two whole-second clocks: 10.9 s to 86410.1 s is 86400."""
    start = F.call_function("div", floor_ms(start_ms, 1000), F.lit(1000).cast("long"))
    end = F.call_function("div", floor_ms(end_ms, 1000), F.lit(1000).cast("long"))
    return end - start


def utc_date(ms: Column) -> Column:
    days = F.call_function("div", floor_ms(ms, DAY_MS), F.lit(DAY_MS).cast("long"))
    return F.date_from_unix_date(days.cast("int"))


def timestamp_text(ms: Column) -> Column:
    """``2024-01-31 23:59:59.123``, in the session time zone."""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm:ss.SSS")
