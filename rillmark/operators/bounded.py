"""Deduplication with a bounded memory per group.

A group remembers the last ``cap`` ids it admitted, first in first out; a repeat
does not refresh its place, and an id that fell out is admitted again.

A group with at most ``cap`` distinct ids never forgets one, so there the first
of each id is admitted: a plain aggregate.  In the other groups, whether a row is
admitted depends on the admissions before it, which SQL cannot say.

A task walks such a group in one pass.  The rows of groups of over ``WHOLE`` rows
are cut into stretches by (group, order), so a group with a third of all rows
becomes many stretches that run side by side.  A stretch needs to know the
memory it starts with: it begins from a guess, and stretches whose predecessor
ends differently from the guess are run again until nothing changes.  The first
stretch of a group is right at once and each round settles at least one more, so
the result is exact; as memories forget, two rounds are the common case.

NULL is a group and an id like any other.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillmark.operators.dedup import dedup_first, shard_of
from rillmark.operators.scan import null_safe_join
from rillmark.session import materialise

DEFAULT_CAP = 4096
#: A group of up to this many rows is walked by one task; larger ones are cut.
WHOLE = 1_000_000


class Memory:
    """The ids one group remembers."""

    def __init__(self, cap: int, held: Sequence = ()):
        self.cap = cap
        self.queue = deque(held)
        self.held = set(self.queue)

    def admit(self, identifier) -> bool:
        if identifier in self.held:
            return False
        self.held.add(identifier)
        self.queue.append(identifier)
        if len(self.queue) > self.cap:
            self.held.discard(self.queue.popleft())
        return True


_KEY = ["_part", "_group"]


def _stretches(batches, cap: int):
    """Walk sorted batches; yield ``(batch, verdicts, closed)`` where ``closed`` lists
    the stretches that ended with their memories.  A start row precedes its stretch."""
    key, memory = None, None
    for batch in batches:
        parts = batch.column("_part").to_pylist()
        groups = batch.column("_group").to_pylist()
        ids = batch.column("_id").to_pylist()
        starts = batch.column("_start")
        has_start = starts.is_valid().to_pylist()
        verdicts, closed = [], []
        for row, here in enumerate(zip(parts, groups)):
            if here != key:
                if key is not None:
                    closed.append((key, memory))
                key, memory = here, Memory(cap)
            if has_start[row]:
                memory = Memory(cap, starts[row].as_py())
                verdicts.append(False)
            else:
                verdicts.append(memory.admit(ids[row]))
        yield batch, verdicts, closed
    if key is not None:
        yield None, [], [(key, memory)]


def _admitted_rows(cap: int, columns: Sequence[str]):
    def run(batches):
        for batch, verdicts, _ in _stretches(batches, cap):
            if batch is not None:
                kept = batch.filter(pa.array(verdicts, pa.bool_()))
                yield pa.RecordBatch.from_arrays([kept.column(c) for c in columns], names=list(columns))
    return run


def _end_memories(cap: int, schema: pa.Schema):
    def run(batches):
        for _, _, closed in _stretches(batches, cap):
            if closed:
                yield pa.RecordBatch.from_arrays([
                    pa.array([key[0] for key, _ in closed], schema.field("_part").type),
                    pa.array([key[1] for key, _ in closed], schema.field("_group").type),
                    pa.array([list(memory.queue) for _, memory in closed], schema.field("_end").type),
                ], schema=schema)
    return run


def dedup_bounded(rows: DataFrame, group: str | None, id_column: str, order: Sequence[str],
                  cap: int = DEFAULT_CAP, stretches: int | None = None) -> DataFrame:
    """The admitted rows.  ``order`` must be unique within a group.

    With ``stretches`` the rows of all forgetting groups are cut into that many
    pieces; without, those of large groups into as many as the session's shuffle
    partitions.  The admitted rows are the same.  Runs jobs at once.
    """
    group_column = F.lit(0) if group is None else F.col(group)
    keyed = rows.withColumns({"_group": group_column, "_id": F.col(id_column)})
    copies = keyed.groupBy("_group", "_id").agg(F.count(F.lit(1)).alias("_copies"))
    groups = copies.groupBy("_group").agg(F.count(F.lit(1)).alias("_ids"), F.sum("_copies").alias("_rows"))
    whole = F.lit(False) if stretches else F.col("_rows") <= WHOLE
    kind = F.when(F.col("_ids") <= cap, "plain").when(whole, "whole").otherwise("cut")
    groups = materialise(groups.select("_group", kind.alias("_kind")), "groups")
    # At most three rows.
    kinds = {row["_kind"] for row in groups.select("_kind").distinct().collect()}
    parts = {name: null_safe_join(keyed, groups.where(F.col("_kind") == name), ["_group"], "left_semi") if len(kinds) > 1 else keyed
             for name in kinds}
    admitted = keyed.limit(0)
    if "plain" in parts:
        admitted = dedup_first(parts["plain"], ["_group", "_id"], order)
    if "whole" in parts:
        walked = _walk_whole(parts["whole"], order, cap)
        admitted = admitted.unionByName(walked) if "plain" in parts else walked
    if "cut" in parts:
        count = stretches or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        walked = _walk(parts["cut"], order, cap, count)
        admitted = admitted.unionByName(walked) if len(kinds) > 1 else walked
    return admitted.select(*rows.columns)


def _walk_whole(keyed: DataFrame, order: Sequence[str], cap: int) -> DataFrame:
    """Admitted rows of groups that one task each walks."""
    start_type = T.ArrayType(keyed.schema["_id"].dataType)
    sorted_groups = keyed.repartition("_group").sortWithinPartitions("_group", *order)
    marked = sorted_groups.withColumns({"_part": F.lit(0), "_start": F.lit(None).cast(start_type)})
    return marked.mapInArrow(_admitted_rows(cap, keyed.schema.names), keyed.schema)


def _walk(keyed: DataFrame, order: Sequence[str], cap: int, count: int) -> DataFrame:
    """Admitted rows of groups that forget.  The cut into stretches is written to
    the shared folder, so every round sees the same stretches."""
    spark = keyed.sparkSession
    sort_columns = [f"_order_{i}" for i in range(len(order))]
    out_schema = keyed.schema
    ordered = keyed.withColumns(dict(zip(sort_columns, [F.col(c) for c in order])))
    cut = materialise(
        ordered.repartitionByRange(count, "_group", *sort_columns).withColumn("_part", F.spark_partition_id()),
        "stretches")

    group_type, id_type = cut.schema["_group"].dataType, cut.schema["_id"].dataType
    start_type = T.ArrayType(id_type)
    end_schema = T.StructType([T.StructField("_part", T.IntegerType()), T.StructField("_group", group_type),
                               T.StructField("_end", start_type)])
    arrow_ends = pa.schema([("_part", pa.int32()), ("_group", _arrow_type(group_type)),
                            ("_end", pa.list_(_arrow_type(id_type)))])

    def sorted_with(data: DataFrame, starts: DataFrame) -> DataFrame:
        """Stretches on one task each, in order, each behind the memory it starts with."""
        both = data.withColumn("_start", F.lit(None).cast(start_type)).unionByName(
            starts.select("_part", "_group", "_start"), allowMissingColumns=True)
        return both.repartition(count, "_part").sortWithinPartitions(
            "_part", "_group", F.col("_start").isNull(), *sort_columns)

    # Groups that lie in one stretch are right at once.  At most two groups per
    # cut cross it, so this list is short and so are the memories.
    crossing = materialise(
        cut.groupBy("_group").agg(F.min("_part").alias("_low"), F.max("_part").alias("_high"))
           .where("_low < _high").select("_group"), "crossing")
    no_starts = spark.createDataFrame([], T.StructType([*end_schema.fields[:2], T.StructField("_start", start_type)]))
    starts = no_starts
    if not crossing.isEmpty():
        narrow = null_safe_join(cut.select("_part", "_group", "_id", *sort_columns), crossing, ["_group"], "left_semi")
        narrow = materialise(narrow, "crossing-rows")
        todo, todo_starts, ends = narrow, no_starts, None
        while True:
            fresh = materialise(sorted_with(todo, todo_starts).mapInArrow(_end_memories(cap, arrow_ends), end_schema),
                                "memories")
            if ends is not None:
                ends = materialise(null_safe_join(ends, fresh, _KEY, "left_anti").unionByName(fresh), "memories")
            else:
                ends = fresh
            before = F.lag("_end").over(W.partitionBy("_group").orderBy("_part"))
            guessed = ends.select("_part", "_group", before.alias("_start")).where(F.col("_start").isNotNull())
            changed = null_safe_join(guessed, starts.withColumnRenamed("_start", "_old"), _KEY, "left").where(
                ~F.col("_old").eqNullSafe(F.col("_start")))
            changed = materialise(changed.select("_part", "_group", "_start"), "changed")
            if changed.isEmpty():
                break
            starts = materialise(null_safe_join(starts, changed, _KEY, "left_anti").unionByName(changed), "starts")
            todo = null_safe_join(narrow, changed.select(*_KEY), _KEY, "left_semi")
            todo_starts = changed
    return sorted_with(cut, starts).mapInArrow(_admitted_rows(cap, out_schema.names), out_schema)


def _arrow_type(data_type: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(data_type)


def dedup_sharded(rows: DataFrame, id_column: str, order: Sequence[str], cap: int = 4_000_000,
                  shards: int = 64, stretches: int | None = None, shard: Column | None = None) -> DataFrame:
    """One memory of ``cap`` ids for everything, split over ``shards`` by id hash.

    An approximation of a single queue: each shard keeps its own last
    ``cap / shards`` ids, so what is forgotten when differs slightly, while a
    repeat always meets the shard of its first copy.  Shards that are hot are cut
    into stretches like any group.  ``shard`` deals the ids in another way.
    """
    sharded = rows.withColumn("_shard", shard_of(F.col(id_column), shards) if shard is None else shard)
    admitted = dedup_bounded(sharded, "_shard", id_column, order, max(1, cap // shards), stretches)
    return admitted.select(*rows.columns)
