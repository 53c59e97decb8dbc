"""The three record flows from delivery to checked result."""

import json
import random

from helpers import members, pairs, random_events, readings, storefront
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillmark.operators import delivery
from rillmark.operators.dedup import dedup_first
from rillmark.operators.definitions import standard_segments
from rillmark.operators.digest import quick_fingerprint, state_digest, table_digest
from rillmark.operators.reconcile import lost_records, multiset_equal, reconcile, reconcile_totals
from rillmark.schemas import READING, STOREFRONT_EVENT
from rillmark.sinks.keyed import keyed_messages
from rillmark.sources import decode_records, parquet_topic, parse_webhooks, read_topic_snapshot, read_topic_stream
from rillmark.streaming.dedup import dedup_stream
from rillmark.streaming.delivery import minute_rollup_stream, read_rollup
from rillmark.streaming.replay import deliver_with_replay, drain_undelivered
from rillmark.streaming.running import append_files, finish
from rillmark.streaming.segments import finalize_segments, incremental_segments

MESSAGES = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])


def shuffled_with_copies(rows, seed, share=0.2):
    rng = random.Random(seed)
    delivered = rows + [row for row in rows if rng.random() < share]
    rng.shuffle(delivered)
    return delivered


def topic_of(spark, df, path, files=3):
    df.repartition(files).write.parquet(path)
    return parquet_topic(path, df.schema, maxFilesPerTrigger="1")


def whole_digest(df):
    return table_digest(state_digest(df, "device_id", "sequence", F.col("value")), "device_id").first().digest


def test_readings_survive_copies_disorder_and_an_outage(spark, path):
    unique = [(f"d{i % 4}", i // 4, i) for i in range(80)]
    delivered = readings(spark, shuffled_with_copies(unique, 1))
    messages = keyed_messages(delivered, "device_id")
    stream = read_topic_stream(spark, topic_of(spark, messages, f"{path}/in"))
    admitted = dedup_stream(decode_records(stream, "value", READING), ["device_id", "sequence"])
    offers = []

    def sink(rows, name):
        offers.append(name)
        if len(offers) <= 2:
            raise ConnectionError("down")
        rows.write.mode("overwrite").parquet(f"{path}/out/parcel={name}")

    finish(deliver_with_replay(admitted, sink, f"{path}/kept", f"{path}/check"))
    assert drain_undelivered(spark, f"{path}/kept", READING, sink) == 0
    landed = spark.read.schema(READING).parquet(f"{path}/out")
    numbered = delivered.withColumn("arrival", F.monotonically_increasing_id())
    expected = dedup_first(numbered, ["device_id", "sequence"], ["arrival"]).select(*READING.names)
    assert whole_digest(landed) == whole_digest(expected)
    assert tuple(quick_fingerprint(landed, READING.names).first()) == tuple(
        quick_fingerprint(expected, READING.names).first())
    assert tuple(lost_records(expected, landed, ["device_id", "sequence"]).first()) == (80, 80, 0)


def test_storefront_events_to_segments(spark, path):
    unique, chosen = random_events(21, events=150), standard_segments()
    delivered = storefront(spark, shuffled_with_copies(unique, 2))
    stream = read_topic_stream(spark, topic_of(spark, keyed_messages(delivered, "profile_id"), f"{path}/in"))
    events = dedup_stream(decode_records(stream, "value", STOREFRONT_EVENT), ["event_id"])
    finish(incremental_segments(events, chosen, f"{path}/state", f"{path}/check", shards=2))
    now = max(r[3] for r in unique)
    assert pairs(finalize_segments(spark, f"{path}/state", chosen)) == members(chosen, unique, now)


def test_webhook_bodies_to_reconciled_rollup(spark, path):
    rng = random.Random(3)
    bodies = [json.dumps({"webhook_id": f"w{i}", "message_id": f"m{i // 2}", "channel": rng.choice(["sms", "email"]),
                          "status": rng.choice(["sent", "failed"]), "provider": "p",
                          "timestamp_ms": 1_704_067_200_000 + rng.randrange(600_000)}) for i in range(100)]
    delivered = shuffled_with_copies(bodies, 4) + ["{", '{"webhook_id":""}']
    received = spark.createDataFrame([(b,) for b in delivered], "body string")
    source = topic_of(spark, received, f"{path}/in")
    now = 1_704_067_200_000

    def hooks():
        return dedup_stream(parse_webhooks(read_topic_stream(spark, source), now), ["webhook_id"])

    finish(append_files(hooks(), f"{path}/log", f"{path}/check-log"))
    finish(minute_rollup_stream(hooks(), f"{path}/rollup", f"{path}/check-rollup"))
    log = spark.read.parquet(f"{path}/log")
    snapshot = parse_webhooks(read_topic_snapshot(spark, parquet_topic(f"{path}/in", received.schema)), now)
    assert multiset_equal(log, snapshot.dropDuplicates(["webhook_id"]), "webhook_id") and log.count() == 100
    rollup = read_rollup(spark, f"{path}/rollup")
    totals = reconcile_totals(reconcile(delivery.recompute_counts(log), delivery.rollup_counts(rollup),
                                        ["channel", "status"], "count")).first()
    assert totals.exact and totals.actual_n == 100
    start = now + 125_000
    assert delivery.dashboard_raw(log, start).collect() == delivery.dashboard_rollup(rollup, start).collect()
