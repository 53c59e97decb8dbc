"""Sharding by a histogram sort.

Every row has a key of 24 bytes (hash of the text, id, row number), so equal texts are neighbours and no two keys are equal.
Splitters are found without moving rows: each round counts the exact bytes below a set of probe keys in every partition, and
refines the probes between the two that enclose a target, within the smallest and largest key that really lie there, until a
splitter is within the tolerance. Then every row goes to its shard in one exchange.

The law is ``bytes``: shards have near equal bytes. Equal texts stay together unless that would miss the tolerance; then their
group is cut by id.

Defined results: a null text has no bytes and sorts like a text of its own; null ids come before all others; repeated rows are
told apart by their row number; fewer rows than shards leave shards empty; an empty table gives an empty result. Input columns
named like an output column are replaced.

Scale: the keys are written once and read once per round; a round returns one row per probe, ``PROBES`` per splitter, so what
reaches the driver grows with the shards and not with the rows. Slots are numbered in ranges of about as many rows each, so a
shard is never ordered as a whole by one task.
"""

from __future__ import annotations

import bisect
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmark.llm.common import free_name, quoted
from rillmark.operators.scan import positions
from rillmark.session import materialise

#: Probes per open splitter and round.
PROBES = 64
_KEY = 24


def _ordered(value: Column) -> Column:
    """A long as 8 bytes in the order of the numbers."""
    return F.unhex(F.lpad(F.hex(value.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))


def sort_key(doc_id: str, text: str) -> Column:
    """Hash of the text, id, row number. The last differs from run to run and only tells equal rows apart."""
    hashed = F.when(quoted(text).isNull(), F.lit(0)).otherwise(F.xxhash64(quoted(text).cast("string")))
    # A null id takes the place of the lowest number.
    return F.concat(_ordered(hashed), _ordered(F.coalesce(quoted(doc_id).cast("long"), F.lit(-(1 << 63)))),
                    _ordered(F.monotonically_increasing_id()))


def keyed(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``df``'s ids with ``size`` (bytes of the text plus 1), ``text_crc32`` and ``sort_key``. To be stored before use."""
    content = F.coalesce(quoted(text).cast("string"), F.lit("")).cast("binary")
    return df.select(quoted(doc_id).alias("doc_id"), (F.octet_length(content) + 1).cast("long").alias("size"),
                     F.crc32(content).cast("long").alias("text_crc32"), sort_key(doc_id, text).alias("sort_key"))


def _number(key: bytes) -> int:
    return int.from_bytes(key, "big")


def _bytes(number: int) -> bytes:
    return min(number, (1 << 8 * _KEY) - 1).to_bytes(_KEY, "big")


def _array(keys) -> np.ndarray:
    return np.frombuffer(b"".join(keys), dtype=f"S{_KEY}")


def _keys(column: pa.Array) -> np.ndarray:
    """The keys of a batch as numpy strings; these drop zero bytes at the end, which does not change their order."""
    return _array(column.to_pylist())


def _histogram(keys: DataFrame, probes: list[bytes]) -> dict[int, tuple]:
    """Bytes, rows, smallest and largest key between each two neighbouring probes; bin i holds keys in [probe i-1, probe i)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges, bins = _array(probes), {}
        for batch in batches:
            if not batch.num_rows:
                continue
            own, sizes = _keys(batch.column("sort_key")), batch.column("size").to_numpy()
            order = np.argsort(own, kind="stable")
            own, sizes = own[order], sizes[order]
            place = np.searchsorted(edges, own, side="right")
            starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
            ends = np.r_[starts[1:], len(own)]
            for at, first, end, total in zip(place[starts].tolist(), starts, ends, np.add.reduceat(sizes, starts).tolist()):
                low, high = own[first].ljust(_KEY, b"\0"), own[end - 1].ljust(_KEY, b"\0")
                old = bins.get(at)
                bins[at] = (total, int(end - first), low, high) if old is None else (
                    old[0] + total, old[1] + int(end - first), min(old[2], low), max(old[3], high))
        yield pa.RecordBatch.from_pylist(
            [{"bin": at, "bytes": b, "rows": n, "low": low, "high": high} for at, (b, n, low, high) in bins.items()],
            pa.schema([("bin", pa.int32()), ("bytes", pa.int64()), ("rows", pa.int64()), ("low", pa.binary()), ("high", pa.binary())]))

    found = keys.select("sort_key", "size").mapInArrow(counted, "bin int, bytes long, rows long, low binary, high binary")
    merged = found.groupBy("bin").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.min("low").alias("low"),
                                      F.max("high").alias("high"))
    return {row["bin"]: (row["bytes"], row["rows"], bytes(row["low"]), bytes(row["high"])) for row in merged.collect()}


def splitters(keys: DataFrame, parts: int, tolerance: float) -> list[bytes]:
    """Keys that cut stored ``keys`` into ``parts`` of near equal bytes, each cut off by half of ``tolerance`` parts at most."""
    whole = _histogram(keys, [_bytes(0)])
    if not whole or parts < 2:
        return []
    total, _, low, high = whole[1]
    slack = max(1, int(total / parts * tolerance / 2))
    goals = [total * part // parts for part in range(1, parts)]
    # Per open splitter the interval of keys it lies in: its smallest key, and one past its largest.
    opened = {at: (_number(low), _number(high) + 1) for at in range(len(goals))}
    chosen: dict[int, int] = {}
    while opened:
        probes = set()
        for first, end in opened.values():
            probes |= {*range(first, end, max(1, -(-(end - first) // PROBES))), end}
        edges = sorted(probes)
        bins = _histogram(keys, [_bytes(edge) for edge in edges])
        below = list(itertools.accumulate(bins.get(at, (0,))[0] for at in range(len(edges))))  # exact bytes below each edge
        for at in list(opened):
            after = bisect.bisect_right(below, goals[at])  # the first edge with more bytes below it than wanted
            best = min(range(max(0, after - 1), min(after + 1, len(edges))), key=lambda i: abs(below[i] - goals[at]))
            _, rows, low, high = bins[after]
            # One row larger than the tolerance cannot be cut: the nearer side of it.
            if abs(below[best] - goals[at]) <= slack or rows == 1:
                chosen[at] = edges[best]
                del opened[at]
            else:
                opened[at] = (_number(low), _number(high) + 1)
    return [_bytes(chosen[at]) for at in range(len(goals))]


def place(keys: DataFrame, cuts: list[bytes], name: str, key: str = "sort_key") -> DataFrame:
    """``keys`` with the number of cuts at or below each key."""

    @F.arrow_udf("int")
    def placed(column: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(_array(cuts), _keys(column), side="right").astype(np.int32)) if cuts else pa.array(
            np.zeros(len(column), np.int32))

    return keys.withColumn(name, placed(F.col(key)))


def shard(df: DataFrame, shards: int = 8, tolerance: float = 0.02, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``shard`` (from 0), ``slot`` (from 0 in key order within the shard)."""
    keys = materialise(keyed(df, doc_id, text), "shard-keys")
    dealt = place(keys, splitters(keys, shards, tolerance), "shard")
    numbered = positions(dealt, ["shard"], ["sort_key"])
    return numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("position") - 1).cast("long").alias("slot"))


def write_shards(df: DataFrame, path: str, shards: int = 8, tolerance: float = 0.02, doc_id: str = "doc_id",
                 text: str = "text") -> None:
    """Write the rows of ``df`` to ``path/shard=n/``, in key order within each file, with one exchange of the rows."""
    keys = materialise(keyed(df, doc_id, text), "shard-keys")
    names = {name: free_name(df, name) for name in ("sort_key", "shard")}
    rows = df.withColumn(names["sort_key"], sort_key(doc_id, text))
    dealt = place(rows, splitters(keys, shards, tolerance), names["shard"], names["sort_key"])
    order = [names["shard"], names["sort_key"]]
    (dealt.repartitionByRange(*order).sortWithinPartitions(*order).drop(names["sort_key"])
     .write.partitionBy(names["shard"]).parquet(path))
