from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def padded_id(prefix: str, number: Column, width: int) -> Column:
    """``prefix`` and the number, zero-filled to at least ``width`` digits."""
    digits = number.cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(digits) >= width, digits).otherwise(F.lpad(digits, width, "0")))


def money_text(amount: Column) -> Column:
    """Two decimal places, halves rounded away from zero."""
    return amount.cast("decimal(38,2)").cast("string")


def id_with_amount(identifier: Column, amount: Column) -> Column:
    """``identifier|12.50``."""
    return F.concat_ws("|", identifier, money_text(amount))


def split_once(text: Column, part: int) -> Column:
    """Part 0 or 1 of ``text`` split at its first ``|``."""
    return F.split(text, r"\|", 2)[part]
