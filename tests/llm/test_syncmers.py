"""Closed syncmers: context-free anchors, the order of documents, likeness."""

import hashlib
import random
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from rillmark.llm import common, syncmers
from rillmark.llm.queries import op10_syncmers


def anchors_of(spark, texts):
    df = spark.createDataFrame([(n, text) for n, text in enumerate(texts)], "n int, text string")
    rows = df.select("n", syncmers.anchors(F.col("text")).alias("a")).collect()
    return [[(one["place"], one["hash"]) for one in row["a"]] for row in sorted(rows, key=lambda row: row["n"])]


def test_anchors_do_not_depend_on_context(spark):
    passage = " ".join(f"word{n}" for n in range(200))
    alone, inside, short, one, none, null = anchors_of(spark, [passage, f"some other words here {passage} and more", "a b c", "x", " \n", None])
    assert 0.35 < len(alone) / 196 < 0.65  # two of four inner places
    shifted = {(place - 4, h) for place, h in inside}
    assert set(alone) <= shifted
    assert len(short) == len(one) == 1 and none == null == []


def test_anchors_are_the_closed_syncmers(spark):
    text = " ".join(f"t{n * n % 37}" for n in range(120))
    inner = spark.createDataFrame([(text,)], "text string").select(F.split("text", " ").alias("w")).select(
        F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1)))).first()[0]
    want = [i for i in range(len(inner) - 3) if min(inner[i:i + 4]) in (inner[i], inner[i + 3])]
    assert [place for place, _ in anchors_of(spark, [text])[0]] == want


def test_offset_and_likeness(spark):
    passage = " ".join(f"word{n}" for n in range(100))
    df = spark.createDataFrame([(passage, "x y z " + passage, None)], "a string, b string, c string")
    row = df.select(syncmers.offset(syncmers.anchors(F.col("a")), syncmers.anchors(F.col("b"))).alias("offset"),
                    syncmers.likeness(syncmers.fingerprint(F.col("a")), syncmers.fingerprint(F.col("a"))).alias("same"),
                    syncmers.likeness(syncmers.fingerprint(F.col("a")), syncmers.fingerprint(F.col("c"))).alias("none"),
                    syncmers.likeness(syncmers.fingerprint(F.col("c")), syncmers.fingerprint(F.col("c"))).alias("empty")).first()
    assert (row["offset"], row["same"], row["none"], row["empty"]) == (3, 1.0, 0.0, 1.0)


def test_next_document(spark, monkeypatch):
    monkeypatch.setattr(common, "CELL_ROWS", 3)
    monkeypatch.setattr(syncmers, "id_cell", lambda df, doc_id, key: common.id_cell(df, doc_id, key, rows=3))
    rows = [(n, f"text {n}") for n in range(40)] + [(None, "n1"), (None, "n2"), (7, "text 7"), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    out = syncmers.with_next(df.fillna("", "text"), "doc_id", "text").collect()
    assert len(out) == len(rows)
    following = {}
    for row in out:
        following.setdefault(row["doc_id"], []).append((row["text"], row["next_text"]))
    for n in range(39, 0, -1):
        if n not in (7, 8, 9, 10):
            assert following[n] == [(f"text {n}", f"text {n - 1}")]
    assert sorted(following[7]) == [("text 7", "text 6"), ("text 7", "text 7")]
    last = [after for _, after in following[None] if after not in ("n1", "n2")]
    assert last == ["text 39"]
    assert syncmers.with_next(df.limit(0), "doc_id", "text").count() == 0
    only = syncmers.with_next(spark.createDataFrame([(1, "a")], "doc_id long, text string"), "doc_id", "text").collect()
    assert [row["next_text"] for row in only] == ["a"]


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy(F.desc("doc_id")).collect()
    found = {row["doc_id"]: row for row in op10_syncmers(spark, "/root/testdata/sf0.001").collect()}
    texts = [doc["text"] or "" for doc in docs]
    near = []
    for doc, text, after in zip(docs, texts, texts[1:] + texts[:1]):
        row, third = found[doc["doc_id"]], len(text) // 3
        edited = text[:len(text) - third] + after[:third]
        assert row["n_chars"] == len(text) and row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= row["near_next"] <= 1 and 0 <= row["near_edited"] <= 1
        if len(text.split()) > 150:
            near.append(row["near_edited"] > row["near_next"])
    assert sum(near) > 0.98 * len(near)
    prints = {}
    for doc in docs:
        prints.setdefault(doc["text"] or "", set()).add(found[doc["doc_id"]]["fingerprint"])
    assert all(len(own) == 1 for own in prints.values())


def test_short_texts_have_an_anchor(spark):
    texts = [" ".join(f"w{n}x{at}s{size}" for at in range(size)) for size in range(1, 9) for n in range(60)]
    found = anchors_of(spark, texts)
    assert all(found)
    assert len({tuple(own) for own in found}) == len(texts)
    # Some have no syncmer and stand for themselves as a whole, from place 0.
    df = spark.createDataFrame([(texts[60 * 4 + n], texts[60 * 5 + n]) for n in range(60)], "a string, b string")
    alike = syncmers.likeness(syncmers.fingerprint(F.col("a")), syncmers.fingerprint(F.col("b")))
    assert df.select(alike.alias("l")).where("l = 1").isEmpty()


def signed(number):
    return number - (1 << 64) if number >= 1 << 63 else number


def plain_anchors(text):
    """The closed syncmers of a text as a loop: (place, hash)."""
    words = [word.encode() for word in re.findall(r"[^\x20\x09-\x0D]+", text or "")]

    def chained(parts):
        seed = 42
        for part in parts:
            seed = xxhash.xxh64_intdigest(part, seed)
        return signed(seed)

    inner = [chained(words[i:i + 2]) for i in range(len(words) - 1)]
    found = []
    for i in range(len(words) - 4):
        own = inner[i:i + 4]
        if min(own) in (own[0], own[3]):
            found.append((i, chained([struct.pack("<q", own[part]) for part in (0, 2, 3)]) >> 32))
    return found or ([(0, signed(xxhash.xxh64_intdigest(b" ".join(words), 42)) >> 32)] if words else [])


def plain_likeness(a, b):
    least = sorted(set(a) | set(b))[:128]
    return sum(one in a and one in b for one in least) / len(least) if least else 1.0


def test_query_against_plain_loops(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy(F.desc("doc_id")).collect()
    found = {row["doc_id"]: row for row in op10_syncmers(spark, "/root/testdata/sf0.001").collect()}
    texts = [doc["text"] or "" for doc in docs]
    sketch = lambda text: sorted({h for _, h in plain_anchors(text)})[:128]
    shown = lambda own: "".join(f"{h & 0xFFFFFFFF:08x}" for h in own)
    assert len(found) == len(docs)
    for doc, text, after in zip(docs, texts, texts[1:] + texts[:1]):
        row, third = found[doc["doc_id"]], len(text) // 3
        own, edited, following = sketch(text), sketch(text[:len(text) - third] + after[:third]), sketch(after)
        assert (row["fingerprint"], row["edited_fingerprint"]) == (shown(own), shown(edited))
        assert row["near_edited"] == pytest.approx(plain_likeness(own, edited))
        assert row["near_next"] == pytest.approx(plain_likeness(own, following))


def plain_passages(a, b):
    places = [{}, {}]
    for side, own in zip(places, (a, b)):
        for place, h in plain_anchors(own):
            side.setdefault(h, []).append(place)
    shifts = {}
    for h, first in places[0].items():
        second = places[1].get(h, [])
        if len(first) == len(second) == 1:
            shifts.setdefault(second[0] - first[0], []).append(first[0])
    return [(shift, min(own), max(own) + 4, len(own)) for shift, own in sorted(shifts.items())]


def test_passages_are_found_by_place(spark):
    rng = random.Random(11)
    words = lambda n, name: [f"{name}{rng.randrange(10 ** 9)}" for _ in range(n)]
    shared, twice = words(200, "s"), words(40, "t")
    long_a = words(9000, "a") + shared + words(9000, "a")
    long_b = words(200, "b") + shared + words(17000, "b")
    pairs = [(long_a, long_b), (shared + twice + shared, shared), (twice + shared, shared + twice), (shared, words(50, "c")),
             (shared, shared), ([], shared), ([], []), (["x"], ["x"]), (["x"], ["y"])]
    pairs = [(" ".join(a), " ".join(b)) for a, b in pairs] + [(None, "x")]
    df = spark.createDataFrame([(n, a, b) for n, (a, b) in enumerate(pairs)], "n int, a string, b string")
    out = df.select("n", syncmers.passages(syncmers.anchors(F.col("a")), syncmers.anchors(F.col("b"))).alias("p")).collect()
    for row in out:
        assert [tuple(one) for one in row["p"]] == plain_passages(*pairs[row["n"]])
    (only,) = next(row["p"] for row in out if row["n"] == 0)
    # The likeness of these two is 0; the passage is found whole but for a few words at its ends.
    assert only["shift"] == 200 - 9000 and only["last"] - only["first"] >= 185
