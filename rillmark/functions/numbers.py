from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def at_least_zero(value: Column) -> Column:
    return F.greatest(value, F.lit(0).cast("long"))


def ratio(part: Column, whole: Column, places: int = 6) -> Column:
    """``part / whole`` rounded; NULL when ``whole`` is 0."""
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")), places)
