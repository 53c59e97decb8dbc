"""Fingerprints of a table that do not depend on row order or partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAN_OUT_BITS = 16


def _roll_up(rows: DataFrame, keys: list[str]) -> DataFrame:
    """SHA-256 over the texts of each key in order of ``_at``."""
    parts = F.sort_array(F.collect_list(F.struct("_at", "_text")))
    joined = F.array_join(F.transform(parts, lambda part: part["_text"]), ",")
    return rows.groupBy(*keys).agg(F.sha2(joined, 256).alias("_text"))


def state_digest(rows: DataFrame, device: str, sequence: str, value: Column) -> DataFrame:
    """One digest per device over its ``sequence:value`` pairs in sequence order.

    Built as a tree: the pairs of 65,536 consecutive sequences make one digest,
    65,536 of those the next, and so on; four levels cover every 64-bit sequence.
    No group holds more than 65,536 sequences, however large a device is.
    Repeated pairs are counted first and enter as ``sequence:value:copies``.
    """
    pairs = rows.groupBy(F.col(device), F.col(sequence).alias("_at"), value.cast("string").alias("_value")).agg(
        F.count(F.lit(1)).alias("_copies"))
    level = pairs.select(device, "_at", F.concat_ws(
        ":", F.col("_at").cast("string"), "_value",
        F.when(F.col("_copies") > 1, F.col("_copies").cast("string"))).alias("_text"))
    for _ in range(3):
        level = _roll_up(level.withColumn("_next", F.shiftright("_at", FAN_OUT_BITS)), [device, "_next"])
        level = level.withColumnRenamed("_next", "_at")
    return _roll_up(level, [device]).select(device, F.col("_text").alias("digest"))


def table_digest(digests: DataFrame, device: str) -> DataFrame:
    """One digest over all ``state_digest`` rows, again as a tree over hash prefixes."""
    named = digests.select(
        F.sha2(F.col(device), 256).alias("_at"), F.concat_ws(":", device, "digest").alias("_text"))
    level = named
    for prefix in (6, 3):
        level = _roll_up(level.withColumn("_next", F.substring("_at", 1, prefix)), ["_next"])
        level = level.withColumnRenamed("_next", "_at")
    return _roll_up(level, []).select(F.col("_text").alias("digest"))


def quick_fingerprint(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Row count and XOR of row hashes: one pass, no shuffle of rows.

    Pairs of equal rows cancel in the XOR, which is what the count is for.
    """
    return rows.agg(F.count(F.lit(1)).alias("rows_n"), F.bit_xor(F.xxhash64(*columns)).alias("fingerprint"))
