import json

import pytest
from helpers import column, readings
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillmark.functions.attributes import number_or_zero
from rillmark.operators.dedup import dedup_verdict
from rillmark.operators.definitions import standard_segments
from rillmark.operators.metrics import as_of, floor_rank_percentiles
from rillmark.operators.ranges import between
from rillmark.operators.reconcile import lost_records
from rillmark.operators.segments import evaluate_segments
from rillmark.operators.timeline import profile_timeline
from rillmark.schemas import DELIVERY_WEBHOOK, READING, STOREFRONT_EVENT
from rillmark.operators.segment_state import FACTS
from rillmark.session import child_names, materialise, path_exists, scratch
from rillmark.sinks import ensure_table, read_keyed, truncate_table, write_keyed
from rillmark.sinks.keyed import keyed_messages
from rillmark.sinks.logs import read_log
from rillmark.sources import (
    decode_records, kafka_topic, merge_topics, parquet_topic, parse_webhooks, read_topic_snapshot, read_topic_stream,
    reject_undecodable,
)
from rillmark.sources.decode import rejected_webhooks
from rillmark.streaming.lag import event_lag_stream
from rillmark.streaming.replay import deliver_with_replay, drain_undelivered, open_parcels, pending, replay_undelivered
from rillmark.streaming.running import append_files, finish, late_rows, source_lag
from rillmark.streaming.segments import current_segments, finalize_segments, fold_batch, incremental_segments
from rillmark.streaming.store import append_event_store, publish_stream

SCHEMA = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])


def test_decode_skips_and_reports(spark):
    payloads = ['{"a":1,"b":"x"}', "{", "", None, '{"a":"no number"}', '{"b":"y"}']
    df = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "i int, payload string")
    assert [tuple(r) for r in decode_records(df, "payload", SCHEMA, keep=("i",)).orderBy("i").collect()] == [
        (0, 1, "x"), (5, 0, "y")]
    assert column(reject_undecodable(df, "payload", SCHEMA), "i") == [1, 2, 3, 4]
    with pytest.raises(ValueError):
        decode_records(df, "payload", SCHEMA, format="avro")


def test_decode_of_bytes(spark):
    df = spark.createDataFrame([(bytearray(b'{"a":7}'),)], "payload binary")
    assert decode_records(df, "payload", SCHEMA).first().a == 7


def body(**fields):
    return json.dumps({"webhook_id": "w", "message_id": "m", "channel": "sms", "status": "sent", "provider": "p",
                       "timestamp_ms": 5, **fields})


def test_webhook_bodies(spark):
    limit = 65_536
    long_id = "x" * (limit - len(body(webhook_id="")))
    bodies = [body(), body(timestamp_ms=0), '{"webhook_id":"w3","channel":"sms"}', "{not json", body(webhook_id=""),
              body(channel=""), '{"channel":"sms"}', body(webhook_id=long_id), body(webhook_id=long_id + "x")]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, body string")
    got = parse_webhooks(df, now_ms=99, max_body_bytes=limit)
    assert parse_webhooks(df, now_ms=99).count() == got.count() + 1
    assert sorted((r.webhook_id[:3], r.status, r.timestamp_ms) for r in got.collect()) == [
        ("w", "sent", 5), ("w", "sent", 99), ("w3", "", 99), ("xxx", "sent", 5)]
    reasons = {r.i: r.reason for r in rejected_webhooks(df, max_body_bytes=limit).collect()}
    assert reasons == {3: "invalid json", 4: "webhook_id and channel are required",
                       5: "webhook_id and channel are required", 6: "webhook_id and channel are required",
                       8: "invalid json"}


def test_kafka_options():
    source = kafka_topic("host:9092", "readings", maxOffsetsPerTrigger="10000")
    assert source["options"]["subscribe"] == "readings" and source["options"]["maxOffsetsPerTrigger"] == "10000"


def test_snapshot_and_stream_read_the_same(spark, path):
    rows = readings(spark, [("d", i, i) for i in range(20)])
    rows.repartition(3).write.parquet(f"{path}/in")
    source = parquet_topic(f"{path}/in", READING, maxFilesPerTrigger="1")
    query = append_files(read_topic_stream(spark, source), f"{path}/out", f"{path}/check")
    finish(query)
    assert late_rows(query) == 0 and source_lag(query) == {}
    snapshot = read_topic_snapshot(spark, parquet_topic(f"{path}/in", READING))
    assert merge_topics(snapshot.where("sequence < 5"), snapshot.where("sequence >= 5")).count() == 20
    assert merge_topics(read_topic_stream(spark, source), read_topic_stream(spark, source)).isStreaming
    assert tuple(lost_records(snapshot, spark.read.parquet(f"{path}/out"), ["sequence"]).first()) == (20, 20, 0)


def test_keyed_files_keep_keys_together_and_in_order(spark, path):
    rows = readings(spark, [("hot" if i % 2 else f"d{i % 7}", i, i) for i in range(400)])
    write_keyed(rows, "device_id", {"format": "parquet", "path": path}, ["sequence"], partitions=3, files=8)
    back = read_keyed(spark, path, READING)
    assert back.count() == 400
    assert back.groupBy("device_id").agg(F.count_distinct("partition").alias("n")).where("n <> 1").isEmpty()
    files = back.where("device_id = 'hot'").groupBy(F.input_file_name().alias("f")).agg(
        F.min("sequence").alias("low"), F.max("sequence").alias("high")).orderBy("f").collect()
    assert len(files) > 1 and all(a.high < b.low for a, b in zip(files, files[1:]))
    message = keyed_messages(rows.where("sequence = 3"), "device_id").first()
    assert message.key == "hot" and json.loads(message.value)["sequence"] == 3


def test_publish_stream(spark, path):
    readings(spark, [("d", i, i) for i in range(10)]).write.parquet(f"{path}/in")
    stream = read_topic_stream(spark, parquet_topic(f"{path}/in", READING))
    finish(publish_stream(stream, "device_id", {"format": "parquet", "path": f"{path}/out"}, f"{path}/check"))
    assert spark.read.parquet(f"{path}/out").count() == 10


def test_event_store_is_partitioned_by_date(spark, path):
    readings(spark, [("d", i * 50_000, i) for i in range(4)]).write.parquet(f"{path}/in")
    stream = read_topic_stream(spark, parquet_topic(f"{path}/in", READING))
    finish(append_event_store(stream, f"{path}/out", f"{path}/check"))
    stored = spark.read.parquet(f"{path}/out")
    assert stored.select("event_date").distinct().count() == 3 and stored.count() == 4
    low = 1_700_000_000_000 + 50_000_000
    recent = between(stored, low, low + 50_000_000)
    assert column(recent, "sequence") == [50_000, 100_000]
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan and "GreaterThanOrEqual(timestamp_ms" in plan


def test_tables(spark, path):
    for _ in range(2):
        ensure_table(spark, "edge_hooks", DELIVERY_WEBHOOK, path, ["channel"])
    ordered = spark.table("edge_hooks").columns
    row = spark.createDataFrame([("w", "m", "sms", "sent", 1, "p")], DELIVERY_WEBHOOK)
    row.select(*ordered).write.insertInto("edge_hooks")
    assert spark.table("edge_hooks").count() == 1
    truncate_table(spark, "edge_hooks")
    assert spark.table("edge_hooks").count() == 0
    truncate_table(spark, "no_such_table")


class FlakySink:
    """Down for the first ``failures`` offers; then takes all rows but those ``refused`` once."""

    def __init__(self, path, failures=0, refused=None):
        self.path, self.failures, self.refused = path, failures, refused

    def __call__(self, rows, name):
        if self.failures:
            self.failures -= 1
            raise ConnectionError("down")
        if self.refused:
            condition, self.refused = self.refused, None
            rows.where(f"NOT ({condition})").write.mode("overwrite").parquet(f"{self.path}/parcel={name}")
            return rows.where(condition)
        rows.write.mode("overwrite").parquet(f"{self.path}/parcel={name}")
        return None


def delivered(spark, path):
    return column(spark.read.schema(READING).parquet(path), "sequence")


def start(spark, path, sink, count=12, files=4):
    rows = readings(spark, [("d", i, i) for i in range(count)])
    rows.repartitionByRange(files, "sequence").write.parquet(f"{path}/in")
    stream = read_topic_stream(spark, parquet_topic(f"{path}/in", READING, maxFilesPerTrigger="1"))
    finish(deliver_with_replay(stream, sink, f"{path}/kept", f"{path}/check"))


def test_nothing_is_lost_when_the_sink_fails_first(spark, path):
    sink = FlakySink(f"{path}/out", failures=3)
    start(spark, path, sink)
    assert len(open_parcels(spark, f"{path}/kept")) == 3
    kept = column(pending(spark, f"{path}/kept", READING), "sequence")
    assert sorted(kept + delivered(spark, f"{path}/out")) == list(range(12))
    assert drain_undelivered(spark, f"{path}/kept", READING, sink) == 0
    assert pending(spark, f"{path}/kept", READING).isEmpty()
    assert delivered(spark, f"{path}/out") == list(range(12))


def test_a_sink_that_stays_down_keeps_everything(spark, path):
    sink = FlakySink(f"{path}/out", failures=100)
    start(spark, path, sink, 6, 2)
    assert replay_undelivered(spark, f"{path}/kept", READING, sink) == 2
    assert column(pending(spark, f"{path}/kept", READING), "sequence") == list(range(6))


def test_single_refused_rows_are_kept(spark, path):
    sink = FlakySink(f"{path}/out", refused="sequence % 2 = 0")
    start(spark, path, sink, 4, 1)
    assert column(pending(spark, f"{path}/kept", READING), "sequence") == [0, 2]
    sink.refused = "sequence = 2"
    assert replay_undelivered(spark, f"{path}/kept", READING, sink) == 1
    assert drain_undelivered(spark, f"{path}/kept", READING, sink) == 0
    assert delivered(spark, f"{path}/out") == [0, 1, 2, 3]


def test_lag_stream(spark, path):
    base = 1_700_000_000_000
    sent = spark.createDataFrame([(f"e{i}", base + i * 1000) for i in range(20)], "id string, sent_ms long")
    pairs = {f"e{i}": base + i * 1000 + lag for i, lag in ((0, 0), (2, 2), (4, -10), (6, 700_000), (8, 10**9))}
    received = spark.createDataFrame([*pairs.items(), ("x", base)], "id string, received_ms long")
    for name, df in (("sent", sent), ("received", received)):
        df.write.parquet(f"{path}/{name}")
    read = lambda name, df: read_topic_stream(spark, parquet_topic(f"{path}/{name}", df.schema))
    lags = event_lag_stream(read("sent", sent), read("received", received), "id")
    finish(append_files(lags, f"{path}/out", f"{path}/check"))
    assert column(spark.read.parquet(f"{path}/out"), "lag_ms") == [-10, 0, 2, 700_000, 10**9]


def test_null_keys_stay(spark):
    rows = spark.createDataFrame([(None, "e1", 5), (None, "e0", 5), ("p", "e2", None), ("p", "e3", 7)],
                                 "profile_id string, event_id string, timestamp_ms long")
    got = sorted((r.profile_id or "", r.event_id, r.position) for r in profile_timeline(rows).collect())
    assert got == [("", "e0", 1), ("", "e1", 2), ("p", "e2", 1), ("p", "e3", 2)]
    verdicts = dedup_verdict(rows, ["profile_id"], ["event_id"]).collect()
    assert sorted(r.event_id for r in verdicts if r.accepted) == ["e0", "e2"]


def test_absent_fields_have_defaults(spark):
    df = spark.createDataFrame([("{}",), ('{"event_id":"e","attributes":{"a":"b"}}',)], "payload string")
    got = sorted(tuple(r) for r in decode_records(df, "payload", STOREFRONT_EVENT).collect())
    assert got == [("", "", "", 0, {}), ("e", "", "", 0, {"a": "b"})]


def test_odd_numbers_and_empty_tables(spark):
    texts = ["5", "\t5", " 5", "5 ", "5\n", "1e2", "-.5", "5.", "", ".", "1e", "0x1", "1_0", "NaN", "5d", None]
    df = spark.createDataFrame([(n, text) for n, text in enumerate(texts)], "n int, t string")
    got = [float(r.v) for r in df.select("n", number_or_zero(F.col("t")).alias("v")).orderBy("n").collect()]
    assert got == [5, 0, 0, 0, 0, 100, -0.5, 5] + [0] * 8
    values = spark.createDataFrame([(0.4,), (0.9,), (10.574,)], "v double")
    row = floor_rank_percentiles(values, "v", {"p50": 0.5}, "low", "high").first()
    assert (row.p50, row.low, row.high, row.n) == (0.4, 0.4, 10.574, 3)
    empty = spark.createDataFrame([], STOREFRONT_EVENT)
    assert as_of(empty) == 0 and evaluate_segments(empty, standard_segments(), as_of(empty)).count() == 0


def test_a_late_batch_keeps_memberships(spark, path):
    day, now, chosen = 86_400_000, 1_706_745_600_000, standard_segments()
    event = lambda n, kind, at, attributes: (f"e{n}", "p", kind, at, attributes)
    batches = [[event(0, "purchase", now, {"price": "600"})], [event(1, "page_view", now - 60 * day, {"category": "toys"})]]
    for number, rows in enumerate(batches):
        fold_batch(spark, spark.createDataFrame(rows, STOREFRONT_EVENT), number, chosen, path, shards=2)
    whole = spark.createDataFrame([row for rows in batches for row in rows], STOREFRONT_EVENT)
    want = {tuple(r) for r in evaluate_segments(whole, chosen, now).collect()}
    assert {tuple(r) for r in current_segments(spark, path).collect()} == want and len(want) > 9


def test_a_stream_merges_its_logs(spark, path):
    now, chosen = 1_706_745_600_000, standard_segments()
    rows = [(f"e{n}", f"p{n % 3}", "purchase", now + n * 86_400_000, {"price": "60"}) for n in range(8)]
    for row in rows:
        spark.createDataFrame([row], STOREFRONT_EVENT).coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = read_topic_stream(spark, parquet_topic(f"{path}/in", STOREFRONT_EVENT, maxFilesPerTrigger="1"))
    finish(incremental_segments(stream, chosen, f"{path}/state", f"{path}/check", shards=1, compact_every=4))
    assert child_names(spark, f"{path}/state/facts/base") == ["upto=3", "upto=7"]
    read = read_log(spark, f"{path}/state/facts", FACTS)
    assert all("/base/upto=7/" in name for name in read.inputFiles())
    whole = spark.createDataFrame(rows, STOREFRONT_EVENT)
    want = {tuple(r) for r in evaluate_segments(whole, chosen, as_of(whole)).collect()}
    assert {tuple(r) for r in finalize_segments(spark, f"{path}/state", chosen).collect()} == want


def test_scratch_removes_what_was_made_inside(spark):
    outside = materialise(spark.range(3))
    with scratch(spark):
        inside = materialise(spark.range(3))
        files = inside.inputFiles()
        assert inside.count() == 3
    assert outside.count() == 3 and not any(path_exists(spark, name) for name in files)
