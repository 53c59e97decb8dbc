"""Result rows as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_json_rows(df: DataFrame) -> DataFrame:
    """One JSON object per row, in column ``value``."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def json_body(df: DataFrame, generated_at: str) -> DataFrame:
    """One body ``{"generated_at", "rows": […]}``; for results of a few rows such as a summary."""
    rows = F.sort_array(F.collect_list(F.struct(*df.columns))).alias("rows")
    return df.agg(rows).select(
        F.to_json(F.struct(F.lit(generated_at).alias("generated_at"), "rows")).alias("body"))
