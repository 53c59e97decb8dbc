"""Shards of near equal bytes, slots without gaps, whole groups where the tolerance lets them."""

import random
import zlib
from collections import defaultdict

import xxhash
from pyspark.sql import functions as F

from rillmark.llm import sharding
from rillmark.llm.queries import op8_sharding


def check(rows, shards, tolerance, largest):
    sizes, slots = defaultdict(int), defaultdict(list)
    for row in rows:
        sizes[row["shard"]] += row["size"]
        slots[row["shard"]].append(row["slot"])
    total = sum(sizes.values())
    for shard in range(shards):
        assert abs(sizes[shard] - total / shards) <= tolerance * total / shards + 2 * largest + 2
        assert sorted(slots[shard]) == list(range(len(slots[shard])))


def test_near_equal_bytes_with_a_hot_text(spark):
    random.seed(4)
    texts = ["copy of a third"] * 1000 + ["t%d " % n * random.randint(1, 9) for n in range(2000)] + [None, "", "", "é"]
    rows = [(n, text, n) for n, text in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int").repartition(5)
    out = sharding.shard(df, 8, 0.02).collect()
    assert sorted(row["doc_id"] for row in out) == list(range(len(texts)))
    check(out, 8, 0.02, max(row["size"] for row in out))
    for row in out:
        data = (texts[row["doc_id"]] or "").encode()
        assert (row["size"], row["text_crc32"]) == (len(data) + 1, zlib.crc32(data))
    groups = defaultdict(set)
    for row in out:
        groups[texts[row["doc_id"]]].add(row["shard"])
    assert len(groups["copy of a third"]) > 1  # larger than two shards
    assert all(len(found) == 1 for text, found in groups.items() if text != "copy of a third")


def test_equal_rows_null_ids_and_few_rows(spark):
    df = spark.createDataFrame([(None, "same")] * 400, "doc_id long, text string")
    check(sharding.shard(df, 4, 0.02).collect(), 4, 0.02, 5)
    few = sharding.shard(df.limit(3), 8).collect()
    assert len(few) == 3 and all(row["slot"] == 0 for row in few)
    one = sharding.shard(df.limit(1), 8).collect()
    assert [row["slot"] for row in one] == [0]
    assert sharding.shard(df.limit(0), 8).count() == 0


def test_written_shards(spark, path):
    df = spark.range(500).select(F.col("id").alias("doc_id"), F.repeat(F.col("id").cast("string"), 5).alias("text"), F.lit(1).alias("piece"))
    sharding.write_shards(df, path, 4)
    back = spark.read.parquet(path)
    assert back.count() == 500 and back.select("shard").distinct().count() == 4
    assert sorted(back.columns) == ["doc_id", "piece", "shard", "text"]


def test_histogram_orders_high_bytes(spark):
    keys = [bytes([high]) + bytes(22) + bytes([low]) for high in (0, 127, 128, 255) for low in (0, 1, 255)]
    df = spark.createDataFrame([(bytearray(key), 1) for key in keys], "sort_key binary, size long")
    bins = sharding._histogram(df, sorted(keys))
    assert [bins[at][1] for at in range(1, len(keys) + 1)] == [1] * len(keys)


def test_query_against_a_plain_sort(spark):
    docs = {row["doc_id"]: row["text"] for row in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}

    def key(doc):
        text = docs[doc]
        hashed = 0 if text is None else xxhash.xxh64_intdigest(text.encode(), 42)
        return (hashed - (1 << 64) if hashed >= 1 << 63 else hashed), doc

    found = {row["doc_id"]: row for row in op8_sharding(spark, "/root/testdata/sf0.001").collect()}
    assert found.keys() == docs.keys()
    sizes, filled, shard = [0] * 8, [0] * 8, 0
    for doc in sorted(docs, key=key):
        row, data = found[doc], (docs[doc] or "").encode()
        assert (row["size"], row["text_crc32"], row["law"], row["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        assert row["shard"] >= shard and row["slot"] == filled[row["shard"]]
        shard = row["shard"]
        filled[shard] += 1
        sizes[shard] += row["size"]
    # Each cut is off by half the tolerance, or by half of one row that it cannot cut.
    goal, most = sum(sizes) / 8, max(row["size"] for row in found.values())
    assert all(abs(size - goal) <= max(0.02 * goal, most) for size in sizes)


def test_probes_do_not_grow_with_the_rows(spark, monkeypatch):
    asked, histogram = [], sharding._histogram
    monkeypatch.setattr(sharding, "_histogram", lambda keys, probes: asked.append(len(probes)) or histogram(keys, probes))
    for rows in (2_000, 200_000):
        asked.clear()
        df = spark.range(rows).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
        out = sharding.shard(df, 3).groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("slots"),
                                                         F.max("slot").alias("last")).collect()
        assert len(out) == 3 and all(row["n"] == row["slots"] == row["last"] + 1 for row in out)
        assert max(asked) <= 2 * (sharding.PROBES + 1)
