"""The manifest against SQL and against a tree of plain lists."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from rillmark.llm import merkle
from rillmark.llm.queries import op13_merkle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if value is None else f"{len(str(value).encode())}:{value}" for value in row))


def plain_tree(nodes):
    """Root, and for each node its siblings with whether it comes second."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for number, place in enumerate(at):
            paths[number].append((nodes[place ^ 1] if place ^ 1 < len(nodes) else "", place & 1))
        at = [place >> 1 for place in at]
        nodes = [sha("".join(nodes[i:i + 2])) for i in range(0, len(nodes), 2)]
    return nodes[0], paths


def plain(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    names = sorted(groups, key=lambda name: (name is not None, (name or "").encode()))
    for name in names:
        groups[name].sort(key=lambda row: (row[0] is not None, row[0] or 0, leaf(row)))
    trees = [plain_tree([leaf(row) for row in groups[name]]) for name in names]
    root, upper = plain_tree([subroot for subroot, _ in trees])
    out = []
    for name, (subroot, paths), above in zip(names, trees, upper):
        for row, path in zip(groups[name], paths):
            claim = row
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[3] is not None:
                claim = (*row[:3], row[3] + 1, row[4])
            version = [leaf(claim)]
            for sibling, second in path + above:
                version.append(sha(sibling + version[-1] if second else version[-1] + sibling))
            out.append((row[0], leaf(row), subroot, root, "".join(sibling for sibling, _ in path + above), version))
    return sorted(out, key=str)


def ours(df):
    altered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    rows = merkle.manifest(df, {"n_chars": F.when(altered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))})
    siblings = F.array_join(F.transform("path", lambda step: step["sibling"]), "")
    return sorted([tuple(row) for row in rows.select("doc_id", "leaf", "subroot", "root", siblings, "version").collect()], key=str)


def some(number, lang, rng):
    return number, rng.choice(["a", None]), lang, rng.choice([5, None, 7]), rng.choice(["", "xé", None, "y" * 30])


CASES = {
    "several langs": lambda rng: [some(n, rng.choice(["en", "en", "de", None, "é"]), rng) for n in rng.sample(range(9999), 1500)]
    + [some(None, "en", rng), some(None, "fr", rng)],
    "blocks": lambda rng: [some(n, "en", rng) for n in range(1025)],
    "many langs": lambda rng: [some(n, f"l{n:05}", rng) for n in range(1100)],
    "single": lambda rng: [some(1, "en", rng)],
    "lone leaves": lambda rng: [some(1, "en", rng), some(2, "de", rng), some(14, None, rng)],
    "equal rows": lambda rng: [(5, "a", "en", 1, "t")] * 3 + [(5, "a", "en", 2, "z" * 100_000)],
}


@pytest.mark.parametrize("case", CASES)
def test_manifest_and_versions(spark, case):
    rows = CASES[case](random.Random(case))
    df = spark.createDataFrame([(*row, 1, "x") for row in rows],
                               "doc_id long, source string, lang string, n_chars long, text string, index long, digest string")
    assert ours(df) == plain(rows)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")
    assert ours(df) == []


def test_query(spark, equals_sql):
    equals_sql(op13_merkle)
    rows = op13_merkle(spark, "/root/testdata/sf0.01").groupBy("verified").count().collect()
    assert {row["verified"] for row in rows} == {True, False}
