"""Lookups in the open-ended attribute map."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# One number on its own; sums take the two parts of ``amounts``, which hold more.
NUMBER_TYPE = "decimal(38,10)"
NUMBER = r"\A[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?\z"


def attribute(attributes: Column, key: str) -> Column:
    """The value under ``key``; an absent key reads as the empty string."""
    return F.coalesce(attributes[key], F.lit(""))


def number_text(text: Column) -> Column:
    """``text`` if it is a number, else NULL; white space around a number is not allowed."""
    return F.when(F.rlike(text, F.lit(NUMBER)), text)


def number_or_zero(text: Column) -> Column:
    """Parse a number of up to 28 digits and ten places; anything missing or malformed is 0, and larger numbers
    are the largest of 28 digits."""
    number = number_text(text)
    largest = F.lit("9" * 28).cast(NUMBER_TYPE)
    beyond = F.when(number.try_cast("double") > 0, largest).when(number.isNotNull(), -largest)
    return F.coalesce(number.try_cast(NUMBER_TYPE), beyond, F.lit(0).cast(NUMBER_TYPE))


def price_of(attributes: Column) -> Column:
    return number_or_zero(attributes["price"])
