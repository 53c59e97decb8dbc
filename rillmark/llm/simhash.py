"""SimHash near-duplicates, linked by BK-trees.

A fingerprint has a bit where more than half of the hashes of a document's word shingles have it. Equal fingerprints are one
point. Two points within r bits differ in at most r of the r + 2 blocks that the 64 bits are cut into, so they agree in 2 at least:
a point goes to one shard for each pair of blocks (15 for r = 4), and every link lies in some shard. Each shard is a BK-tree, whose
children are keyed by their Hamming distance to the parent; a search follows only edges within the radius of its own distance.
The trees are built in the tasks that hold their shards; all of them together grow with the data, so none is broadcast.

A shard gives a spanning forest of its links, not all pairs. Components come from alternating passes over these edges in which
every point moves to the smallest neighbour, each pass written to the shared folder.

``keep_one`` takes pairs whose sets of five-word shingles have a Jaccard similarity of ``LEAST`` or more. Such pairs lie some 10 of 64 bits
apart, too far for pairs of blocks, so it has fingerprints of ``WORDS`` * 64 bits over the distinct shingles, searched within ``REACH``
bits, in shards of its own: points that share one of ``BANDS`` groups of ``ROWS`` smallest shingles under hash orders. A pair of
similarity J shares one with probability 1 - (1 - J^4)^14: 0.9994 at 0.8. Their links give groups; the texts of a group's points meet
once, and a pair of a group within reach is linked if its shingle sets say so. Pairs that links already connect are not compared.

Defined results: no word gives fingerprint zero, linked like any other, and a null text has no word; fewer words than a shingle
make one shingle; null ids stay rows of their own and never name a component, unless all its ids are null (component null);
repeated rows share a component; an empty table gives an empty result. Input columns named like working columns are kept.

Scale: a shard of more than ``SHARD`` points (a group of copies that holds a third of all) is cut into pieces, and each pair of
pieces is a task's tree, so no task holds more than two pieces; for texts a piece is ``TEXTS``, or fewer long ones. Documents of one fingerprint are pre-aggregated before any shuffle.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmark.llm.common import free_name, quoted, without
from rillmark.session import materialise

RADIUS = 4
#: Similarity of near-duplicates, and the words of a long fingerprint.
LEAST, WORDS = 0.8, 4
#: Bits of a long fingerprint: at similarity 0.8 pairs lie 39 apart, with few shingles up to 50, with a deviation of 6.
REACH = 76
ROWS, BANDS = 4, 14
#: Points in a shard, or in a piece of a larger one.
SHARD = 2048
TEXTS, CHARACTERS = 512, 4_000_000
_SEED = 42
_MULTIPLIERS = np.random.default_rng(_SEED).integers(1, 1 << 63, WORDS + ROWS * BANDS, np.uint64) * np.uint64(2) + np.uint64(1)


def fingerprint_of(text: str | None, words: int = 4) -> int:
    """Unsigned fingerprint of one text."""
    tokens = (text or "").encode().lower().split()  # bytes: A-Z and the six ASCII white space characters only
    if not tokens:
        return 0
    joined, size = b" ".join(tokens), min(words, len(tokens))
    starts = list(itertools.accumulate((len(token) + 1 for token in tokens), initial=0))
    total, counts = len(tokens) - size + 1, np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for low in range(0, total, 1 << 16):
        high = min(total, low + (1 << 16))
        hashes = np.array([digest(joined[a:b - 1], _SEED) for a, b in zip(starts[low:high], starts[low + size:high + size])], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > total, bitorder="little").view("<u8")[0])


def fingerprint(text: Column, words: int = 4) -> Column:
    """Fingerprint as a long with the same 64 bits."""

    @F.arrow_udf("long")
    def fingerprints(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint_of(one, words) for one in texts.to_pylist()], np.uint64).view(np.int64))

    return fingerprints.asNondeterministic()(text.cast("string"))


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined, size = b" ".join(tokens), min(words, len(tokens))
    starts = list(itertools.accumulate((len(token) + 1 for token in tokens), initial=0))
    digest, total = xxhash.xxh64_intdigest, len(tokens) - size + 1
    return np.unique(np.fromiter((digest(joined[a:b - 1], _SEED) for a, b in zip(starts, starts[size:])), np.uint64, total))


def long_fingerprint(own: np.ndarray) -> np.ndarray:
    """``WORDS`` words with a bit where more than half of the hashes of a shingle set have it."""
    counts = np.zeros(64 * WORDS, np.int64)
    for low in range(0, len(own), 255):  # as many as a byte counts
        salted = own[low:low + 255, None] * _MULTIPLIERS[:WORDS]
        salted ^= salted >> np.uint64(29)
        salted *= _MULTIPLIERS[:WORDS]
        salted ^= salted >> np.uint64(32)
        bits = np.unpackbits(salted.astype("<u8").view(np.uint8), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(counts * 2 > len(own), bitorder="little").view("<u8")


def band_keys(own: np.ndarray) -> np.ndarray:
    """``BANDS`` shard keys of a shingle set; none for an empty one."""
    if not len(own):
        return np.zeros(0, np.int64)
    least = np.full(ROWS * BANDS, ~np.uint64(0))
    for low in range(0, len(own), 2048):
        least = np.minimum(least, (_MULTIPLIERS[WORDS:, None] * own[low:low + 2048]).min(axis=1))
    return np.array([xxhash.xxh64_intdigest(band.tobytes(), at) for at, band in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def set_number(own: np.ndarray) -> int:
    """Signed number of a shingle set, the same for equal sets."""
    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), _SEED)).view(np.int64))


class Likeness:
    """Jaccard similarities of shingle sets to one of them, from lists of the sets that hold each shingle."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(own) for own in sets])
        _, self.shingles = np.unique(np.concatenate(sets), return_inverse=True)
        self.ends = np.cumsum(self.sizes)
        self.holders = np.repeat(np.arange(len(sets)), self.sizes)[np.argsort(self.shingles, kind="stable")]
        self.bounds = np.r_[0, np.cumsum(np.bincount(self.shingles))]

    def to(self, at: int) -> np.ndarray:
        """The similarity of every set to set ``at``; 1 if both are empty."""
        own = self.shingles[self.ends[at] - self.sizes[at]:self.ends[at]]
        lists = [self.holders[low:high] for low, high in zip(self.bounds[own].tolist(), self.bounds[own + 1].tolist())]
        common = np.bincount(np.concatenate(lists), minlength=len(self.sizes)) if lists else np.zeros(len(self.sizes), np.int64)
        either = self.sizes + self.sizes[at] - common
        return np.where(either > 0, common / np.maximum(either, 1), 1.0)


def _distances(points: np.ndarray, point: int) -> np.ndarray:
    if points.ndim == 1:
        return np.bitwise_count(points ^ np.uint64(point)).astype(np.int16)
    return np.bitwise_count(points ^ np.frombuffer(point.to_bytes(8 * points.shape[1], "little"), "<u8")).sum(axis=1, dtype=np.int16)


class BkTree:
    """Points in a tree by Hamming distance; a node's children are keyed by their distance to it."""

    def __init__(self):
        self.points: list[int] = []
        self.children: list[dict[int, int]] = []

    def insert(self, point: int) -> None:
        at, new = 0, len(self.points)
        self.points.append(point)
        self.children.append({})
        while new:
            distance = (point ^ self.points[at]).bit_count()
            following = self.children[at].setdefault(distance, new)
            if following == new:
                return
            at = following

    def within(self, point: int, radius: int) -> Iterator[int]:
        """Numbers of the points within ``radius``."""
        waiting = [0] if self.points else []
        while waiting:
            at = waiting.pop()
            distance = (point ^ self.points[at]).bit_count()
            if distance <= radius:
                yield at
            children = self.children[at]
            if children:
                waiting += [child for edge, child in children.items() if -radius <= edge - distance <= radius]

    def stars(self, points: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """For each node the numbers of all ``points`` within ``radius`` of it: the searches of all points at once."""
        waiting = [(0, np.arange(len(points)))] if self.points else []
        while waiting:
            at, active = waiting.pop()
            distances = _distances(points[active], self.points[at])
            yield at, active[distances <= radius]
            for edge, child in self.children[at].items():
                if len(rest := active[np.abs(distances - edge) <= radius]):
                    waiting.append((child, rest))


def forest(points: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Edges (smaller first point, other) that join exactly the distinct ``points`` linked within ``radius``."""
    tree, label = BkTree(), np.arange(len(points))
    if len(points) > 64:
        for point in points.tolist():
            tree.insert(point)
        found = tree.stars(points, radius)
    else:
        found = []
        for number, point in enumerate(points.tolist()):
            found.append((number, np.fromiter(tree.within(point, radius), np.int64)))
            tree.insert(point)
    for at, near in found:
        own = label[at]
        for other in np.unique(label[near]) if len(near) else ():
            if other != own:
                low, high = min(own, other), max(own, other)
                label[label == high] = low
                own = low
    return [(int(points[low]), int(points[at])) for at, low in enumerate(label.tolist()) if low != at]


def long_forest(prints: np.ndarray, radius: int = REACH, sets: list[np.ndarray] | None = None, least: float = LEAST) -> list[tuple[int, int]]:
    """Numbers of pairs of long fingerprints that join all linked ones: within ``radius``, and as similar as ``least`` if there are ``sets``."""
    tree, label = BkTree(), np.arange(len(prints))
    whole = [int.from_bytes(one.tobytes(), "little") for one in prints]
    if len(prints) > 64:
        for point in whole:
            tree.insert(point)
        found = tree.stars(prints, radius)
    else:
        found = []
        for number, point in enumerate(whole):
            found.append((number, np.fromiter(tree.within(point, radius), np.int64)))
            tree.insert(point)
    edges, likeness = [], None if sets is None else Likeness(sets)
    for at, near in found:
        near = near[label[near] != label[at]]
        if likeness is not None and len(near):
            near = near[likeness.to(at)[near] >= least]
        while len(near):
            other = near[0]
            label[label == label[other]] = label[at]
            edges.append((int(other), int(at)))
            near = near[label[near] != label[at]]
    return edges


def _shard_keys(point: Column, radius: int) -> Column:
    """One number for each pair of the ``radius`` + 2 blocks and what stands in them."""
    edges = [64 * block // (radius + 2) for block in range(radius + 3)]
    cut = [F.shiftrightunsigned(point, start).bitwiseAND(F.lit((1 << end - start) - 1)) for start, end in itertools.pairwise(edges)]
    pairs = itertools.combinations(cut, 2)
    return F.array(*[F.lit(number << 32).cast("long") + F.shiftleft(a, 16) + b for number, (a, b) in enumerate(pairs)])


def _cells(spread: DataFrame, shard: int) -> DataFrame:
    """Rows of ``spread`` (``point``, ``key``, more) in cells ``key``, ``low``, ``high``: any two rows of a key meet in one of at most
    two pieces of about ``shard`` rows."""
    more = [name for name in spread.columns if name not in ("point", "key")]
    size = F.count("*") / shard
    if "text" in more:
        size = F.greatest(size, F.coalesce(F.sum(F.length("text")), F.lit(0)) / CHARACTERS)
    large = materialise(spread.groupBy("key").agg(F.ceil(size).cast("int").alias("pieces")).where("pieces > 1"), "simhash-large")
    whole = F.coalesce(F.col("pieces"), F.lit(1))
    piece = F.pmod(F.xxhash64("point"), whole).cast("int")
    cells = spread.join(large, "key", "left").select("point", "key", *more, piece.alias("piece"),
                                                     F.explode(F.sequence(F.lit(0), whole - 1)).alias("other"))
    return cells.select("point", "key", *more, F.least("piece", "other").alias("low"), F.greatest("piece", "other").alias("high"))


def _cell_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """(point, value) of each cell with several points, from rows ``key``, ``low``, ``high``, ``point``, value in order of cells."""
    own, rows = None, {}
    for batch in batches:
        for key, low, high, point, value in zip(*[column.to_pylist() for column in batch.columns]):
            if (key, low, high) != own:
                if len(rows) > 1:
                    yield list(rows.items())
                own, rows = (key, low, high), {}
            rows[point] = value
    if len(rows) > 1:
        yield list(rows.items())


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _joined(cells: DataFrame, value: str, pairs: Callable[[list], list[tuple[int, int]]]) -> DataFrame:
    """``a``, ``b``: the points that ``pairs`` names, by number, for the values of each cell."""

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _cell_rows(batches):
            found = [(rows[low][0], rows[high][0]) for low, high in pairs([value for _, value in rows])]
            if found:
                yield pa.RecordBatch.from_pylist([{"a": min(pair), "b": max(pair)} for pair in found], _EDGES)

    ordered = cells.select("key", "low", "high", "point", value).repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    return ordered.mapInArrow(edges, "a long, b long").distinct()


def candidate_groups(points: DataFrame, shard: int = SHARD) -> DataFrame:
    """``point``, ``root`` of the stored points (``point``, ``print``, ``keys``) that links of long fingerprints within a shard join to others."""
    spread = points.select("point", "print", F.explode("keys").alias("key"))

    def pairs(prints: list[bytes]) -> list[tuple[int, int]]:
        return long_forest(np.frombuffer(b"".join(prints), "<u8").reshape(-1, WORDS))

    return components(_joined(_cells(spread, shard), "print", pairs))


def similar(texts: DataFrame, words: int = 5, least: float = LEAST, shard: int = TEXTS) -> DataFrame:
    """``a`` < ``b``: edges that join the points (``point``, ``key`` of its group, ``text``) of a group as similar as ``least``."""

    def pairs(own: list[str]) -> list[tuple[int, int]]:
        sets = [shingle_set(one, words) for one in own]
        return long_forest(np.stack([long_fingerprint(one) for one in sets]), REACH, sets, least)

    return _joined(_cells(texts, shard), "text", pairs)


def links(points: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """``a`` < ``b``: edges of distinct stored ``point`` (long) values; points are linked if and only if edges connect them."""
    cells = _cells(points.select("point", F.explode(_shard_keys(F.col("point"), radius)).alias("key")), shard)

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 4), np.int64)
        for batch in itertools.chain(batches, [None]):
            rows = held if batch is None else np.concatenate(
                [held, np.stack([column.to_numpy().astype(np.int64) for column in batch.columns], axis=1)])
            if not len(rows):
                continue
            starts = np.flatnonzero(np.r_[True, (rows[1:, 1:] != rows[:-1, 1:]).any(axis=1)])
            ends = np.r_[starts[1:], len(rows)]
            if batch is not None:  # the last run may go on in the next batch
                held, starts, ends = rows[starts[-1]:], starts[:-1], ends[:-1]
            several = ends - starts > 1
            out = [edge for start, end in zip(starts[several], ends[several])
                   for edge in forest(np.ascontiguousarray(rows[start:end, 0]).view(np.uint64), radius)]
            if out:
                pairs = np.sort(np.array(out, np.uint64).view(np.int64), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    ordered = cells.select("point", "key", "low", "high").repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    return ordered.mapInArrow(edges, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``point``, ``root``: the smallest point that the edges (``a``, ``b``) reach, for every point of an edge."""
    edges = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "components")
    while True:
        # Each point tells its larger neighbours, then its smaller ones, of the smallest among them.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialise(large.where("u > v"), "components")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))).distinct()
        small = materialise(small, "components")
        # Done when every point has one neighbour, and that has no smaller one.
        deeper = small.join(small.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
        if small.count() == least.count() and deeper.isEmpty():
            return small.select(F.col("u").alias("point"), F.col("v").alias("root")).unionByName(
                small.select(F.col("v").alias("point"), F.col("v").alias("root")).distinct())
        edges = small


def _roots(points: DataFrame, radius: int) -> DataFrame:
    """``point``, ``root`` for all stored distinct points."""
    linked = components(links(points, radius)).withColumnRenamed("root", "linked")
    return points.join(linked, "point", "left").select("point", F.coalesce("linked", "point").alias("root"))


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 4,
                    radius: int = RADIUS) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``: the smallest id among all that links reach."""
    docs = materialise(df.select(quoted(doc_id).alias("doc_id"), fingerprint(quoted(text), words).alias("point")), "simhash-docs")
    points = materialise(docs.groupBy("point").agg(F.min("doc_id").alias("first")), "simhash-points")
    roots = materialise(_roots(points.select("point"), radius), "simhash-roots")
    named = points.join(roots, "point")
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    known = materialise(roots.join(smallest, "root").select("point", "component_id"), "simhash-known")
    return docs.join(known, "point").select("doc_id", F.lower(F.lpad(F.hex("point"), 16, "0")).alias("fingerprint"), "component_id")


def sketches(docs: DataFrame, words: int = 5) -> DataFrame:
    """``docs`` (``doc_id``, ``hash``, ``text``) with ``point``, ``print`` and ``keys`` of the text's shingle set in its place."""
    schema = pa.schema([("point", pa.int64()), ("print", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch, made = whole.slice(start, 512), []
                for text in batch.column("text"):
                    own = shingle_set(text.as_py(), words)
                    made.append({"point": set_number(own), "print": long_fingerprint(own).tobytes(), "keys": band_keys(own).tolist()})
                made = pa.RecordBatch.from_pylist(made, schema)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("hash"), *made.columns], ["doc_id", "hash", *schema.names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "hash", "text").mapInArrow(
        sketched, f"doc_id {kind}, hash long, point long, print binary, keys array<long>")


def near_roots(df: DataFrame, docs: DataFrame, words: int, least: float) -> DataFrame:
    """``point``, ``root`` for the points of stored ``docs`` that near-duplicates join to others."""
    points = docs.groupBy("point").agg(F.first("print").alias("print"), F.first("keys").alias("keys"),
                                       F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")).alias("own"))
    points = materialise(points, "simhash-points")
    groups = points.join(candidate_groups(points.select("point", "print", "keys")), "point").select("point", F.col("root").alias("key"), "own")
    texts = df.join(groups, df["doc_id"].eqNullSafe(F.col("own.doc_id")) & (df["hash"] == F.col("own.hash"))).select("point", "key", "text")
    return components(similar(materialise(texts, "simhash-texts"), words, least))


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, least: float = LEAST) -> DataFrame:
    """The rows of ``df`` less near-duplicates: of each component the row of the smallest id stays (null last, ties by text hash)."""
    hashed = F.xxhash64(quoted(text))
    texts = df.select(quoted(doc_id).alias("doc_id"), hashed.alias("hash"), quoted(text).cast("string").alias("text"))
    docs = materialise(sketches(texts, words), "simhash-docs")
    linked = near_roots(texts, docs, words, least).withColumnRenamed("root", "linked")
    equal = docs.groupBy("point", "doc_id", "hash").agg(F.count("*").alias("n")).join(linked, "point", "left").withColumn(
        "root", F.coalesce("linked", "point"))
    first = equal.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "hash", "n")).alias("first"))
    names = {name: free_name(df, f"simhash_{name}") for name in ("id", "hash", "n")}
    first = materialise(first.select(F.col("first.doc_id").alias(names["id"]), F.col("first.hash").alias(names["hash"]),
                                     F.col("first.n").alias(names["n"])), "simhash-first")
    rows = df.join(first, quoted(doc_id).eqNullSafe(F.col(names["id"])) & (hashed == F.col(names["hash"])))
    # Equal rows of a kept id are told apart by nothing: one of them stays.
    single = rows.where(F.col(names["n"]) == 1)
    equals = rows.where(F.col(names["n"]) > 1).dropDuplicates([names["id"], names["hash"]])
    return without(single.unionByName(equals), *names.values()).select(*map(quoted, df.columns))
