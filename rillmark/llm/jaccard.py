"""Jaccard join of n-gram sets in their metric space.

One minus the Jaccard similarity is a metric, so distances to pivots bound distances: a document of a pivot's Voronoi region (it is the
nearest pivot) can only link with documents that are at most twice the radius further from this pivot than from their own nearest one. A
region holds its own documents and those in this window; the regions are joined one by one, again by pivots, until they are small.

Unrelated texts all lie at distance 1 from each other, where pivots tell nothing, so the root of the recursion is not the whole table but
the groups that a coarser bound leaves: the symmetric difference of two linked sets has at most t elements, t following from their
size, so of t + ``SPARE`` slices of the hash range at least ``SPARE`` are equal. Sets that agree on no slice are too far apart, and sets
connected by equal slices are a group. Sizes are in intervals with a t each; a set near the lower end of its interval is also cut as in the one below.

Groups and regions of more than ``REGION`` sets are dealt to Spark tasks in pieces, each with the pivots of its region (``PIVOTS`` on
average, chosen by hash); smaller ones are joined in one task. What windows do not separate (a dense group) is cut in pieces, and each pair
of pieces is joined in one task. Documents that links already connect are not compared with each other. All is exact up to the 64-bit hashes.

Defined results: texts without words and null texts have empty sets that are linked with nothing, not even each other; fewer words than a
shingle are one shingle; repeated rows and equal sets share a component; null ids stay rows of their own and name a component only if all
its ids are null; an empty table gives an empty result. Columns other than the id and the text are not used.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmark.llm.common import quoted
from rillmark.llm.simhash import components, set_number, shingle_set
from rillmark.session import materialise

#: Words of a shingle, and the similarity in hundredths from which sets are linked.
WORDS, PERCENT = 3, 90
#: Slices that linked sets have in common.
SPARE = 3
#: Sets of a region and bytes of their hashes for one task, pivots of a larger region, rounds of dividing regions by pivots in Spark.
REGION, BYTES, PIVOTS, ROUNDS = 1024, 8_000_000, 16, 3
#: Sets compared one by one, and pivots of a division within a task.
FEW, OWN_PIVOTS = 24, 6
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Intervals:
    """Size intervals and the number of slices in each."""

    def __init__(self, percent: int = PERCENT):
        self.percent = percent
        start = -(-percent // (100 - percent)) if percent < 100 else 1 << 40  # smaller sets link with equal ones only
        self.starts = [start]
        while self.starts[-1] < 1 << 40:
            self.starts.append(max(self.starts[-1] + 1, self.starts[-1] * 3 // 2))

    def of(self, size: int) -> list[int]:
        """The interval of a size, and the one below if sets in it may link with this size; none for sets that link with equal ones only."""
        own = bisect_right(self.starts, size) - 1
        if own < 0:
            return []
        below = own > 0 and 100 * (self.starts[own] - 1) >= self.percent * size
        return [own - 1, own] if below else [own]

    def slices(self, interval: int) -> int:
        """More by ``SPARE`` than two linked sets, the smaller one in this interval, have elements apart."""
        return (self.starts[interval + 1] - 1) * (100 - self.percent) // self.percent + SPARE

    def keys(self, own: np.ndarray) -> np.ndarray:
        """A number for each slice of a set. Sets that link, without being equal, share one.

        Empty slices are named only if there are ``SPARE`` or more: otherwise one of the common slices holds something.
        """
        out = [np.zeros(0, np.uint64)]
        for interval in self.of(len(own)):
            count = self.slices(interval)
            place = (own % np.uint64(count)).astype(np.int64)
            order = np.argsort(place, kind="stable")
            place = place[order]
            first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
            sums, used = np.add.reduceat(own[order] * _MIX, first), place[first]
            if count - len(used) >= SPARE:
                full = np.zeros(count, np.uint64)
                full[used] = sums
                sums, used = full, np.arange(count)
            salted = sums ^ (np.uint64(interval << 40) + used.astype(np.uint64)) * _MIX
            out.append((salted ^ (salted >> np.uint64(31))) * _MIX)
        return np.concatenate(out)


def linked(common: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of sizes ``a`` and ``b`` with ``common`` elements are similar enough."""
    return 100 * common >= percent * (a + b - common)


class Overlaps:
    """Sizes of the intersections of sets, from lists of the sets that hold each element."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(own) for own in sets], np.int64)
        self.elements, inverse = np.unique(np.concatenate(sets), return_inverse=True)
        self.inverse, self.ends = inverse, np.cumsum(self.sizes)
        order = np.argsort(inverse, kind="stable")
        self.holders = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.bounds = np.r_[0, np.cumsum(np.bincount(inverse, minlength=len(self.elements)))]

    def _count(self, numbers: np.ndarray) -> np.ndarray:
        starts, sizes = self.bounds[numbers], np.diff(self.bounds)[numbers]
        ends = np.cumsum(sizes)
        held = self.holders[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
        return np.bincount(held, minlength=len(self.sizes))

    def with_own(self, at: int) -> np.ndarray:
        return self._count(self.inverse[self.ends[at] - self.sizes[at]:self.ends[at]])

    def with_other(self, other: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.elements, other), len(self.elements) - 1)
        return self._count(at[self.elements[at] == other])


def regions(distances: np.ndarray, radius: float) -> Iterator[np.ndarray]:
    """Numbers of the columns in each pivot's region, from distances to pivots by row: its own ones, and those of later pivots in its window."""
    nearest = distances.argmin(axis=0)
    least = distances[nearest, np.arange(distances.shape[1])]
    for pivot in range(len(distances)):
        yield np.flatnonzero((nearest == pivot) | (nearest > pivot) & (distances[pivot] <= least + 2 * radius + 1e-9))


def joining_links(sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Pairs of numbers of linked sets that connect all linked sets."""
    label, edges = np.arange(len(sets)), []
    overlaps = Overlaps(sets)
    sizes, radius = overlaps.sizes, 1 - percent / 100

    def compare(at: int, own: np.ndarray) -> np.ndarray:
        """Distances of set ``at`` to those in ``own``; links are put down."""
        common = overlaps.with_own(at)[own]
        for other in own[linked(common, sizes[at], sizes[own], percent) & (label[own] != label[at])].tolist():
            if label[other] != label[at]:
                label[label == label[other]] = label[at]
                edges.append((at, other))
        return 1 - common / (sizes[at] + sizes[own] - common)

    def one_by_one(own: np.ndarray) -> None:
        # Those of the largest connected part need not be compared among themselves.
        names, counts = np.unique(label[own], return_counts=True)
        for at in own[label[own] != names[counts.argmax()]].tolist():
            compare(at, own)

    def join(own: np.ndarray) -> None:
        if len(own) <= FEW:
            return one_by_one(own)
        pivots = own[np.linspace(0, len(own) - 1, OWN_PIVOTS).astype(np.int64)]
        distances = np.stack([compare(int(pivot), own) for pivot in pivots])
        if (label[own] == label[own[0]]).all():
            return None
        for part in regions(distances, radius):
            if len(part) > 0.8 * len(own):
                one_by_one(own[part])
            elif len(part) > 1:
                join(own[part])
        return None

    if len(sets) > 1:
        join(np.argsort(sizes, kind="stable"))
    return edges


def _sketches(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """``docs`` (``doc_id``, ``hash``, ``text``) with ``point`` (number of the set), ``n`` (its size) and ``keys`` (its slices) for the text."""
    schema = pa.schema([("point", pa.int64()), ("n", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        intervals = Intervals(percent)
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch, made = whole.slice(start, 256), []
                for text in batch.column("text"):
                    own = shingle_set(text.as_py(), words)
                    made.append({"point": set_number(own), "n": len(own), "keys": intervals.keys(own).view(np.int64)})
                made = pa.RecordBatch.from_pylist(made, schema)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("hash"), *made.columns], ["doc_id", "hash", *schema.names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "hash", "text").mapInArrow(sketched, f"doc_id {kind}, hash long, point long, n long, keys array<long>")


def _stars(keys: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys and their smallest points, and pairs of every other point of a key with that."""
    order = np.lexsort((points, keys))
    keys, points = keys[order], points[order]
    first = np.r_[True, keys[1:] != keys[:-1]][:len(keys)]
    least = points[np.flatnonzero(first)][np.cumsum(first) - 1]
    pairs = np.unique(np.stack([points, least])[:, points != least], axis=1)
    return keys[first], points[first], pairs[0], pairs[1]


def _near(docs: DataFrame) -> DataFrame:
    """``a``, ``b``: pairs of points of stored ``docs`` that connect all points with an equal slice."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A slice that many sets of a batch share goes on as one row.
        for batch in batches:
            lists = batch.column("keys")
            sizes = np.diff(lists.offsets.to_numpy())
            keys, least, a, b = _stars(lists.flatten().to_numpy(), np.repeat(batch.column("point").to_numpy(), sizes))
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[keys, a]), pa.array(np.r_[least, b]),
                                              pa.array(np.r_[np.zeros(len(keys), bool), np.ones(len(a), bool)])], ["a", "b", "pair"])

    def over_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = least = None
        for batch in batches:
            keys, points, pair = (column.to_numpy(zero_copy_only=False) for column in batch.columns)
            done = [np.stack([keys[pair], points[pair]])]
            keys, points = keys[~pair], points[~pair]
            if len(keys):
                if key is not None and keys[0] == key:  # the slice goes on from the last batch
                    keys, points = np.r_[key, keys], np.r_[least, points]
                names, first, a, b = _stars(keys, points)
                done.append(np.stack([a, b]))
                key, least = names[-1], first[names == keys[-1]][0]
                key = keys[-1]
            a, b = np.concatenate(done, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    rows = docs.select("point", "keys").mapInArrow(local, "a long, b long, pair boolean")
    return rows.repartition("a").sortWithinPartitions("pair", "a", "b").mapInArrow(over_all, "a long, b long").distinct()


def _pieces(size: str = "sets", width: str = "bytes") -> Column:
    return F.greatest(F.ceil(F.col(size) / REGION), F.ceil(F.col(width) / BYTES)).cast("int")


def _sizes(rows: DataFrame) -> DataFrame:
    """``region``, ``pieces``, ``sets`` of the regions too large for one task."""
    sizes = rows.groupBy("region").agg(F.count("*").alias("sets"), F.sum(F.length("own")).alias("bytes"))
    return sizes.select("region", "sets", _pieces().alias("pieces")).where("pieces > 1")


def _divide(rows: DataFrame, large: DataFrame, number: int, percent: int) -> DataFrame:
    """The sets of large regions dealt to regions of pivots: ``region`` (null for a link of two points), ``parent``, ``point``, ``other``, ``own``."""
    schema = pa.schema([("region", pa.int64()), ("parent", pa.int64()), ("point", pa.int64()), ("other", pa.int64()), ("own", pa.binary())])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, pivots, points, overlaps = None, [], [], None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if (row["region"], row["piece"]) != piece:
                    piece, pivots, points, overlaps = (row["region"], row["piece"]), [], [], None
                own = np.frombuffer(row["own"], "<u8")
                if row["pivot"]:  # these come first
                    pivots.append(own)
                    points.append(row["point"])
                    continue
                overlaps = overlaps or Overlaps(pivots)
                common = overlaps.with_other(own)
                for at in np.flatnonzero(linked(common, overlaps.sizes, len(own), percent)).tolist():
                    if points[at] != row["point"]:
                        out.append({"region": None, "parent": piece[0], "point": row["point"], "other": points[at], "own": None})
                distances = (1 - common / (overlaps.sizes + len(own) - common))[:, None]
                for at, inside in enumerate(regions(distances, 1 - percent / 100)):
                    if len(inside):
                        name = set_number(np.array([piece[0], points[at]]))
                        out.append({"region": name, "parent": piece[0], "point": row["point"], "other": None, "own": row["own"]})
            yield pa.RecordBatch.from_pylist(out, schema)

    now = rows.join(large, "region")
    pivots = now.where(F.pmod(F.xxhash64("point", F.lit(number)), F.col("sets")) < PIVOTS)
    every = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))
    # A region of which no set is a pivot is not divided.
    divided = now.join(pivots.select("region").distinct(), "region", "left_semi")
    both = divided.select("region", F.pmod(F.xxhash64("point"), "pieces").cast("int").alias("piece"), F.lit(False).alias("pivot"), "point", "own").unionByName(
        pivots.select("region", every.alias("piece"), F.lit(True).alias("pivot"), "point", "own"))
    ordered = both.repartition("region", "piece").sortWithinPartitions("region", "piece", F.desc("pivot"), "point")
    return ordered.mapInArrow(dealt, "region long, parent long, point long, other long, own binary")


def _join_cells(rows: DataFrame, large: DataFrame, percent: int) -> DataFrame:
    """``a``, ``b``: links that connect the linked sets of each region; those of ``large`` are cut in pieces, each pair of them for one task."""
    links = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def put() -> pa.RecordBatch:
            points, sets = [*held], [*held.values()]
            found = joining_links(sets, percent)
            return pa.RecordBatch.from_pylist([{"a": points[at], "b": points[other]} for at, other in found], links)

        cell, held = None, {}
        for batch in batches:
            for region, low, high, point, own in zip(*[column.to_pylist() for column in batch.columns]):
                if (region, low, high) != cell:
                    if len(held) > 1:
                        yield put()
                    cell, held = (region, low, high), {}
                held[point] = np.frombuffer(own, "<u8")
        if len(held) > 1:
            yield put()

    whole = F.coalesce(F.col("pieces"), F.lit(1))
    piece = F.pmod(F.xxhash64("point"), whole).cast("int")
    cut = rows.join(large.select("region", "pieces"), "region", "left").select(
        "region", "point", "own", piece.alias("piece"), F.explode(F.sequence(F.lit(0), whole - 1)).alias("other"))
    cells = cut.select("region", F.least("piece", "other").alias("low"), F.greatest("piece", "other").alias("high"), "point", "own")
    ordered = cells.repartition("region", "low", "high").sortWithinPartitions("region", "low", "high")
    return ordered.mapInArrow(joined, "a long, b long")


def _metric_join(rows: DataFrame, percent: int, rounds: int = ROUNDS) -> DataFrame:
    """``a``, ``b``: links that connect all linked sets of ``rows`` (``region``, ``point``, ``own``) within their regions."""
    spark, found = rows.sparkSession, []
    for number in range(rounds):
        large = materialise(_sizes(rows), "jaccard-large")
        if large.isEmpty():
            break
        parts = materialise(_divide(rows, large, number, percent), "jaccard-regions")
        found.append(parts.where("region is null").select(F.col("point").alias("a"), F.col("other").alias("b")))
        parts = parts.where("region is not null")
        # Divided well if no part has most of the region.
        sizes = parts.groupBy("parent", "region").agg(F.count("*").alias("part")).groupBy("parent").agg(F.max("part").alias("part"))
        divided = materialise(sizes.join(large, sizes["parent"] == large["region"]).where("part <= 0.5 * sets").select("parent"), "jaccard-divided")
        rest = large.join(divided, large["region"] == divided["parent"], "left_anti")
        found.append(_join_cells(rows.join(rest.select("region"), "region", "left_semi"), rest, percent))
        done = rows.join(large.select("region"), "region", "left_anti")
        rows = done.unionByName(parts.join(divided, "parent", "left_semi").select("region", "point", "own"))
    found.append(_join_cells(rows, materialise(_sizes(rows), "jaccard-large"), percent))
    out = spark.createDataFrame([], "a long, b long")
    for links in found:
        out = out.unionByName(links)
    return out


def jaccard_components(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``: the smallest id among all that links reach."""
    texts = df.select(quoted(doc_id).alias("doc_id"), F.xxhash64(quoted(text)).alias("hash"), quoted(text).cast("string").alias("text"))
    docs = materialise(_sketches(texts, words, percent), "jaccard-docs")
    groups = materialise(components(_near(docs.where(F.size("keys") > 0))), "jaccard-groups")
    # The text of one row for each point of a group.
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")
    first = docs.join(groups, "point").groupBy("point", "root").agg(F.min(key).alias("own")).select(
        F.col("own.doc_id").alias("id"), F.col("own.hash").alias("own_hash"), "point", "root")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                own = [shingle_set(text.as_py(), words).tobytes() for text in batch.column("text")]
                yield pa.RecordBatch.from_arrays([batch.column("region"), batch.column("point"), pa.array(own, pa.binary())], ["region", "point", "own"])

    found = texts.join(first, texts["doc_id"].eqNullSafe(first["id"]) & (texts["hash"] == first["own_hash"]))
    rows = found.select(F.col("root").alias("region"), "point", "text").mapInArrow(sets, "region long, point long, own binary")
    links = _metric_join(materialise(rows, "jaccard-sets"), percent)
    roots = materialise(components(links), "jaccard-roots")
    named = docs.where("n > 0").groupBy("point").agg(F.min("doc_id").alias("first")).join(roots, "point", "left").withColumn(
        "root", F.coalesce("root", "point"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    known = named.join(smallest, "root").select("point", "component_id")
    alone = docs.where("n = 0").withColumn("component_id", F.col("doc_id"))
    return docs.where("n > 0").join(known, "point").unionByName(alone.select("point", "doc_id", "hash", "n", "keys", "component_id")).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id")
