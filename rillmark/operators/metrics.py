"""Lag, percentile, loss and store metrics."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillmark.functions import at_least_zero, ratio
from rillmark.session import materialise


def event_lag(sent: DataFrame, received: DataFrame, id_column: str) -> DataFrame:
    """Milliseconds from sending to receiving; records of one side only are left out.

    ``sent`` holds one row per id, so only ``received`` can have a hot id, which
    adaptive execution splits.
    """
    pairs = received.select(id_column, "received_ms").join(sent.select(id_column, "sent_ms"), id_column)
    return pairs.select(id_column, (F.col("received_ms") - F.col("sent_ms")).alias("lag_ms"))


def floor_rank_percentiles(rows: DataFrame, value: str, shares: Mapping[str, float],
                           low: str = "min_ms", high: str = "max_ms", buckets: int = 1024) -> DataFrame:
    """Percentiles as the element at rank ``max(1, floor(share * n))``, plus minimum, maximum and n.

    Whole numbers are taken as long, others as double; NULLs do not count and NaN is larger than everything.  No rows gives zeros.
    Ranks are selected exactly by refining histograms: the values are stored once, then rows are counted in
    ``buckets`` per rank over the range still open, the bucket that holds the rank becomes the range, and so
    on until it holds one value.  Every round is a scan with counts combined in the map tasks; no row is moved
    or sorted.  Runs jobs at once.
    """
    whole = isinstance(rows.schema[value].dataType, T.IntegralType)
    kind = "long" if whole else "double"
    held = materialise(rows.where(F.col(value).isNotNull()).select(F.col(value).cast(kind).alias("_value")), "values")
    own, infinity = F.col("_value"), float("inf")
    finite = F.lit(True) if whole else ~F.isnan(own) & (F.abs(own) < infinity)
    ends = held.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(finite).alias("finite"),
        *[F.count_if(F.lit(False) if whole else test).alias(name) for name, test in (
            ("lowest", own == -infinity), ("highest", own == infinity))],
        F.min(F.when(finite, own)).alias("least"), F.max(F.when(finite, own)).alias("most")).first()

    def ranked(rank: int):
        """The value at ``rank``, or the rank among the finite values."""
        if rank <= ends["lowest"]:
            return -infinity, None
        rank -= ends["lowest"]
        if rank <= ends["finite"]:
            return None, rank
        return (infinity if rank - ends["finite"] <= ends["highest"] else float("nan")), None

    found, waiting = {}, {}
    wanted = {name: max(1, int(float(share) * ends["n"])) for name, share in shares.items()} | {low: 1, high: ends["n"]}
    for name, rank in wanted.items():
        found[name], among = ranked(rank) if ends["n"] else (0, None)
        if among is not None:
            waiting[name] = (among, _Range(ends["least"], ends["most"], ends["finite"]))
    while waiting:
        for name, (rank, span) in [*waiting.items()]:
            if span.low == span.high:
                found[name] = span.low
            elif rank in (1, span.rows):
                found[name] = span.low if rank == 1 else span.high
            else:
                continue
            del waiting[name]
        spans = sorted({span for _, span in waiting.values()})
        if spans:
            counted = _histograms(held, spans, buckets)
            waiting = {name: _narrowed(rank, span, counted[span]) for name, (rank, span) in waiting.items()}
    return rows.sparkSession.range(1).select(
        *[F.lit(found[name]).cast(kind).alias(name) for name in wanted], F.lit(ends["n"]).cast("long").alias("n"))


class _Range(NamedTuple):
    """Values between two that occur, both included, and how many rows have them; ``bent`` for buckets that widen from ``low`` on."""

    low: float
    high: float
    rows: int
    bent: bool = False

    def bucket(self, own: Column, buckets: int) -> Column:
        """A number that never falls with the value and differs between ``low`` and ``high``."""
        width = self.high - self.low
        if isinstance(self.low, int):
            if width >= 1 << 63:
                return (own >= 0).cast("long")
            return F.call_function("div", own - F.lit(self.low).cast("long"), F.lit(width // buckets + 1).cast("long"))
        if width == float("inf"):
            share = (own / 2 - self.low / 2) / (self.high / 2 - self.low / 2)
        else:
            share = (own - self.low) / width
        if self.bent:
            share = F.log1p(share * 2.0 ** 52) / math.log1p(2.0 ** 52)
        return F.floor(share * buckets).cast("long")


def _histograms(held: DataFrame, spans: Sequence[_Range], buckets: int) -> dict[_Range, list]:
    """Rows ``(least, most, rows)`` of the buckets of each range, ascending: at most ``buckets`` + 1 each."""
    own = F.col("_value")
    places = [F.when(own.between(span.low, span.high), F.struct(F.lit(number).alias("span"), span.bucket(own, buckets).alias("bucket")))
              for number, span in enumerate(spans)]
    inside = held.select("_value", F.explode(F.filter(F.array(*places), lambda place: place.isNotNull())).alias("p"))
    counts = inside.groupBy("p").agg(F.min("_value").alias("least"), F.max("_value").alias("most"), F.count(F.lit(1)).alias("rows"))
    out = {span: [] for span in spans}
    for row in sorted(counts.collect(), key=lambda row: row["p"]):
        out[spans[row["p"]["span"]]].append((row["least"], row["most"], row["rows"]))
    return out


def _narrowed(rank: int, span: _Range, counted: list) -> tuple[int, _Range]:
    """The bucket that holds ``rank`` as a range, and the rank within it."""
    for least, most, rows in counted:
        if rank <= rows:
            # Most rows in one bucket: their values are uneven, so the next buckets are.
            return rank, _Range(least, most, rows, rows * 4 > span.rows and not span.bent)
        rank -= rows
    raise AssertionError("a rank beyond the rows")


def approximate_percentiles(rows: DataFrame, value: str, shares: Mapping[str, float]) -> DataFrame:
    """One-pass estimate for values too varied to count."""
    return rows.agg(*[F.percentile_approx(value, share).alias(name) for name, share in shares.items()])


def consumer_lag(last_offsets: DataFrame, positions: DataFrame) -> DataFrame:
    """Records not yet read per partition; a partition without a position counts from 0.

    Both inputs have one row per partition of the topic.
    """
    return (last_offsets.join(positions, "partition", "left")
            .select("partition", at_least_zero(
                F.col("last") - F.coalesce(F.col("position"), F.lit(0))).alias("lag")))


def total_lag(lag: DataFrame) -> DataFrame:
    return lag.agg(F.coalesce(F.sum("lag"), F.lit(0)).alias("lag"))


def loss_by_rate(rows: DataFrame) -> DataFrame:
    """Diverted share per offered rate, and the lowest rate at which anything was diverted."""
    per_rate = rows.groupBy("rate").agg(
        F.count(F.lit(1)).alias("sent"), F.count_if("diverted").alias("diverted"))
    lossy = F.when(F.col("diverted") > 0, F.col("rate"))
    return per_rate.select(
        "rate", "sent", "diverted", ratio(F.col("diverted"), F.col("sent")).alias("fraction"),
        F.min(lossy).over(W.partitionBy(F.lit(0))).alias("first_lossy_rate"))


def store_counts(rows: DataFrame, column: str) -> DataFrame:
    """Rows, and exact distinct values of ``column``."""
    return rows.agg(F.count(F.lit(1)).alias("rows_n"), F.count_distinct(column).alias("profiles_n"))


def latest_time(rows: DataFrame) -> DataFrame:
    return rows.agg(F.max("timestamp_ms").alias("as_of_ms"))


def as_of(rows: DataFrame) -> int:
    """The newest event time as a plain number, for use as a literal in later filters; 0 for no rows."""
    return latest_time(rows).first()["as_of_ms"] or 0


def speed_up(slow: float, fast: float) -> float | None:
    return slow / fast if fast > 0 else None


def series(values: Sequence[float], spark) -> DataFrame:
    """A short list of measurements, such as query times, as a frame."""
    return spark.createDataFrame([(float(v),) for v in values], "value double")
