"""The metric join against plain sets, and the bound behind its groups."""

import random
import re

import numpy as np
import pytest

from rillmark.llm import jaccard
from rillmark.llm.queries import op12_jaccard


def shingles(text, size=3):
    words = [re.sub("[A-Z]", lambda c: c[0].lower(), word) for word in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + size]) for i in range(len(words) - size + 1)) if len(words) >= size else frozenset([tuple(words)])


def brute_force(rows, percent=90):
    sets, label = [shingles(text) for _, text in rows], list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, own in enumerate(sets):
        for j in range(i):
            common = len(own & sets[j])
            if own and sets[j] and 100 * common >= percent * (len(own) + len(sets[j]) - common):
                label[max(root(i), root(j))] = min(root(i), root(j))
    names = {}
    for i, (doc, _) in enumerate(rows):
        old = names.get(root(i))
        names[root(i)] = doc if old is None else old if doc is None else min(old, doc)
    return sorted([(doc, len(sets[i]), names[root(i)]) for i, (doc, _) in enumerate(rows)], key=str)


def versions(rng, count, sizes=(2, 5, 12, 30, 60, 120)):
    words, rows = [f"w{n}" for n in range(2000)], []
    while len(rows) < count:
        base = [rng.choice(words) for _ in range(rng.choice(sizes))]
        for _ in range(rng.choice([1, 1, 2, 5, 30])):
            text = base[:]
            for _ in range(rng.randrange(0, len(text) // 25 + 2)):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((len(rows) * 7 % 10007, " ".join(text)))
            if rng.random() < 0.2:
                base = text
    return rows


def found(spark, rows):
    return sorted(map(tuple, jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)


def test_linked_sets_share_a_slice():
    rng, checked = random.Random(5), 0
    for percent in (80, 90, 97):
        intervals = jaccard.Intervals(percent)
        for _ in range(4000):
            size = rng.choice([3, 4, 5, 8, 9, 10, 11, 13, 14, 19, 20, 21, 28, 30, 31, 45, 60, 130, 300])
            a = {rng.getrandbits(64) for _ in range(size)}
            b = set(a)
            for _ in range(rng.randrange(size * (100 - percent) // percent + 2)):
                if rng.random() < 0.5:
                    b.discard(next(iter(b), None))
                else:
                    (a if rng.random() < 0.3 else b).add(rng.getrandbits(64))
            if a != b and 100 * len(a & b) >= percent * len(a | b):
                checked += 1
                keys = [intervals.keys(np.array(sorted(one), np.uint64)) for one in (a, b)]
                assert len(np.intersect1d(*keys)), (percent, len(a), len(b), len(a & b))
    assert checked > 2000


def test_odd_rows(spark):
    rows = versions(random.Random(1), 400) + [
        (None, None), (None, ""), (3, " \n"), (None, "a b c d e f g h i j k l m"), (None, "A b c d e f g h i j k l m"), (9, "a b"), (8, "A\tB")]
    assert found(spark, rows) == brute_force(rows)
    clash = spark.createDataFrame([(1, "a b c", 5, "x")], "doc_id long, text string, point long, root string")
    assert [tuple(row) for row in jaccard.jaccard_components(clash).collect()] == [(1, 1, 1)]
    assert jaccard.jaccard_components(clash.limit(0)).count() == 0


@pytest.mark.parametrize("region", [40, 300])
def test_regions_are_divided_and_dense_ones_cut(spark, monkeypatch, region):
    monkeypatch.setattr(jaccard, "REGION", region)
    rng = random.Random(region)
    base = [f"w{n}" for n in range(110)]
    dense = []
    for number in range(500):
        text = base[:]
        for _ in range(rng.randrange(0, 6)):
            text[rng.randrange(len(text))] = f"x{rng.randrange(10 ** 6)}"
        dense.append((number, " ".join(text)))
    chain = [(1000 + number, " ".join(f"c{n}" for n in range(number, number + 100))) for number in range(300)]  # neighbours link, ends are far apart
    rows = dense + chain + [(5000, "long " * 3 + " ".join(f"l{n}" for n in range(30_000)))]
    assert found(spark, rows) == brute_force(rows)


def test_links_in_one_task_connect_all_linked_sets():
    rng = random.Random(7)
    for _ in range(20):
        pool = [rng.getrandbits(64) for _ in range(60)]
        sets = [np.array(sorted(rng.sample(pool, rng.randrange(50, 61))), np.uint64) for _ in range(120)]
        label = np.arange(len(sets))
        for a, b in jaccard.joining_links(sets, 90):
            common = len(np.intersect1d(sets[a], sets[b]))
            assert jaccard.linked(common, len(sets[a]), len(sets[b]), 90)
            label[label == label[a]] = label[b]
        for a in range(len(sets)):
            for b in range(a):
                if jaccard.linked(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b]), 90):
                    assert label[a] == label[b]


def test_query(spark):
    rows = [tuple(row) for row in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = op12_jaccard(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_force(rows)
