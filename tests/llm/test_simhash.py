"""SimHash links and components against all pairs."""

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from rillmark.llm import simhash
from rillmark.llm.queries import op5_simhash


def brute_fingerprint(text, words=4):
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(tokens[i:i + words]), 42) for i in range(max(1, len(tokens) - words + 1))]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def brute_components(points, radius=4):
    label = list(range(len(points)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(points):
            for j, b in enumerate(points):
                if label[j] < label[i] and (a ^ b).bit_count() <= radius:
                    label[i], changed = label[j], True
    return label


def clusters(seed, count):
    random.seed(seed)
    centres, points = [random.getrandbits(64) for _ in range(max(2, count // 15))], set()
    while len(points) < count:
        point = random.choice(centres)
        for _ in range(random.randint(0, 9)):
            point ^= 1 << random.randrange(64)
        points.add(point)
    return sorted(points)


def test_fingerprint():
    for text in (None, "", " \n", "one", "one two three", "A b C d e f", "x " * 5000, "É é a\x1cb \x0bc d e", "a b c d " * 70):
        assert simhash.fingerprint_of(text) == brute_fingerprint(text)


def test_bk_tree_finds_all_within_the_radius():
    points = clusters(1, 200)
    tree = simhash.BkTree()
    for point in points:
        tree.insert(point)
    for point in points[:40]:
        want = {other for other in points if (point ^ other).bit_count() <= 4}
        assert {tree.points[at] for at in tree.within(point, 4)} == want
    stars = {tree.points[at]: set(np.array(points, np.uint64)[near].tolist()) for at, near in tree.stars(np.array(points, np.uint64), 4)}
    assert all(stars[point] == {other for other in points if (point ^ other).bit_count() <= 4} for point in points)


def _as_long(points):
    return np.array(points, np.uint64).view(np.int64).tolist()


def test_links_and_components_with_split_shards(spark):
    for seed, radius, shard in ((2, 4, 2048), (3, 4, 7), (4, 6, 5)):
        points = clusters(seed, 160)
        longs = _as_long(points)
        df = spark.createDataFrame([(one,) for one in longs], "point long")
        edges = simhash.links(df, radius, shard)
        root = {row["point"]: row["root"] for row in simhash.components(edges).collect()}
        want = brute_components(points, radius)
        got = {}
        for at, one in enumerate(longs):
            got.setdefault(root.get(one, one), set()).add(at)
        expected = {}
        for at, label in enumerate(want):
            expected.setdefault(label, set()).add(at)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, expected.values()))


def test_long_chain_is_one_component(spark):
    df = spark.range(1, 300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    found = simhash.components(df)
    assert found.count() == 300 and found.select("root").distinct().collect() == [(1,)]
    assert simhash.components(df.limit(0)).count() == 0


def test_query_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    points = [brute_fingerprint(doc["text"]) for doc in docs]
    want = brute_components(points)
    found = {row["doc_id"]: row for row in op5_simhash(spark, "/root/testdata/sf0.001").collect()}
    for doc, point, label in zip(docs, points, want):
        row = found[doc["doc_id"]]
        assert (row["fingerprint"], row["component_id"]) == (f"{point:016x}", docs[label]["doc_id"])


def test_edges_and_keep_one(spark):
    long = " ".join(f"w{n}" for n in range(400))
    rows = [(3, long, 1), (1, long.upper(), 2), (1, long.upper(), 2), (None, long, 3), (7, None, 4), (8, "", 5), (9, "other words here", 6),
            (None, "alone in the world", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, simhash_id int")
    found = simhash.near_duplicates(df).collect()
    assert len(found) == len(rows)
    component = {(row["doc_id"], row["fingerprint"]): row["component_id"] for row in found}
    assert {value for (doc, _), value in component.items() if doc in (1, 3)} == {1}
    assert component[(7, "0" * 16)] == component[(8, "0" * 16)] == 7
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((row["doc_id"] or 0, row["text"] or "") for row in kept.collect()) == sorted(
        [(1, long.upper()), (7, ""), (9, "other words here"), (0, "alone in the world")])
    assert simhash.near_duplicates(df.limit(0)).count() == simhash.keep_one(df.limit(0)).count() == 0


def jaccard(a, b, words=5):
    a, b = ({tuple(own[i:i + words]) for i in range(max(1, len(own) - words + 1))} for own in (a.lower().split(), b.lower().split()))
    return len(a & b) / len(a | b)


def edited_pairs(seed, sizes=(6, 14, 40, 120, 300, 900)):
    """Texts and a copy of each with some words changed, whose similarities lie around 0.8."""
    random.seed(seed)
    pairs = []
    for size in sizes:
        for edits in range(1, 2 + max(1, size // 40)):
            for _ in range(6):
                own = [f"w{random.randrange(100_000)}" for _ in range(size)]
                other = list(own)
                for _ in range(edits):
                    other[random.randrange(size)] = f"v{random.randrange(100_000)}"
                pairs.append((" ".join(own), " ".join(other)))
            own = [f"u{random.randrange(100_000)}" for _ in range(size)]
            pairs.append((" ".join(own), " ".join(own[:-edits])))
    return pairs


def test_keep_one_takes_exactly_the_pairs_of_similar_texts(spark):
    pairs = edited_pairs(11)
    likeness = [jaccard(*pair) for pair in pairs]
    assert sum(0.8 <= one < 0.9 for one in likeness) > 10 and sum(0.6 < one < 0.8 for one in likeness) > 10
    df = spark.createDataFrame([(2 * n + side, text) for n, pair in enumerate(pairs) for side, text in enumerate(pair)], "doc_id long, text string")
    kept = {row["doc_id"] for row in simhash.keep_one(df).collect()}
    assert all(2 * n in kept for n in range(len(pairs)))
    assert [2 * n + 1 not in kept for n in range(len(pairs))] == [one >= 0.8 for one in likeness]


def test_similar_texts_meet_across_pieces(spark):
    pairs = [pair for pair in edited_pairs(12, (40, 120)) if jaccard(*pair) >= 0.8]
    texts = [text for pair in pairs for text in pair]
    df = spark.createDataFrame([(n, 0, text) for n, text in enumerate(texts)], "point long, key long, text string")
    edges = sorted((row["a"], row["b"]) for row in simhash.similar(df, shard=5).collect())
    assert edges == [(2 * n, 2 * n + 1) for n in range(len(pairs))]
    large = np.stack([simhash.long_fingerprint(simhash.shingle_set(text)) for text in texts])
    assert len(large) > 64 or sorted(simhash.long_forest(large)) == edges
