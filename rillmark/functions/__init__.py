from rillmark.functions.amounts import FINE_TYPE, SPEND_TYPE, at_least, with_amount
from rillmark.functions.attributes import attribute, number_or_zero, price_of
from rillmark.functions.numbers import at_least_zero, ratio
from rillmark.functions.text import id_with_amount, money_text, padded_id, split_once
from rillmark.functions.time import (
    DAY_MS, HOUR_MS, MINUTE_MS, clock_seconds_between, event_time, floor_ms, minute_floor, timestamp_text,
    utc_date,
)

__all__ = [
    "attribute", "number_or_zero", "price_of", "with_amount", "at_least", "SPEND_TYPE", "FINE_TYPE", "at_least_zero", "ratio", "id_with_amount", "money_text",
    "padded_id", "split_once", "DAY_MS", "HOUR_MS", "MINUTE_MS", "clock_seconds_between", "event_time",
    "floor_ms", "minute_floor", "timestamp_text", "utc_date",
]
