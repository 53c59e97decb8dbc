"""The registered queries: one or more per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillmark.functions import (
    DAY_MS, HOUR_MS, MINUTE_MS, attribute, clock_seconds_between, floor_ms, id_with_amount, minute_floor, padded_id,
    price_of, split_once, timestamp_text,
)
from rillmark.operators import bounded, dedup, delivery, digest, metrics, reconcile, segments, timeline
from rillmark.operators.definitions import segment_definitions, standard_segments
from rillmark.plans import samples
from rillmark.plans.samples import ARRIVAL_ORDER, JANUARY_END_MS
from rillmark.schemas import DELIVERY_WEBHOOK, READING, STOREFRONT_EVENT
from rillmark.session import new_path
from rillmark.sinks import (
    ensure_table, json_body, read_keyed, read_membership, to_json_rows, truncate_table, write_keyed, write_membership,
)
from rillmark.sources import decode_records, parquet_topic, parse_webhooks, read_topic_snapshot, read_topic_stream
from rillmark.streaming.delivery import minute_rollup_stream, minute_windows_stream, read_rollup, read_windows
from rillmark.streaming.replay import deliver_with_replay, drain_undelivered
from rillmark.streaming.dedup import dedup_bounded_stream, dedup_sharded_stream, dedup_stream
from rillmark.streaming.lag import event_lag_stream
from rillmark.streaming.running import append_files, finish, rocksdb_state
from rillmark.streaming.segments import current_segments, finalize_segments, incremental_segments
from rillmark.streaming.store import append_event_store

Query = Callable[[SparkSession, str], DataFrame]

REGISTERED: dict[str, Query] = {}


def register(query: Query) -> Query:
    REGISTERED[query.__name__] = query
    return query


def _readings(spark, sf_dir):
    return samples.readings(samples.base(spark, sf_dir))


def _storefront(spark, sf_dir):
    return samples.storefront(samples.base(spark, sf_dir))


def _webhooks(spark, sf_dir):
    return samples.webhooks(samples.base(spark, sf_dir))


def _event_source(sf_dir: str) -> dict:
    return parquet_topic(sf_dir, samples.EVENTS, pathGlobFilter="events.parquet")


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return samples.project_base(read_topic_stream(spark, _event_source(sf_dir)))


def _staged_stream(spark: SparkSession, rows: DataFrame, order: list[str], files: int) -> DataFrame:
    """``rows`` as a file topic in arrival order, read in several micro-batches."""
    path = new_path(spark, "topic")
    rows.repartitionByRange(files, *order).write.parquet(path)
    return read_topic_stream(spark, parquet_topic(path, rows.schema, maxFilesPerTrigger="1"))


def _arriving(rows: DataFrame) -> DataFrame:
    """Out of order: any time can come in any micro-batch."""
    return rows.withColumn("arrival", F.col("n") * 7919 % 1000003)


def _one_by_one(spark: SparkSession, rows: DataFrame, files: int) -> DataFrame:
    """``rows`` as a file topic whose files really are read in arrival order: each is written after the one before."""
    path = new_path(spark, "topic")
    low, high = rows.agg(F.min("arrival"), F.max("arrival")).first()
    part = F.floor((F.col("arrival") - F.lit(low)) * files / F.lit(high - low + 1))
    for number in range(files):
        rows.where(part == number).coalesce(1).write.mode("append").parquet(path)
    return read_topic_stream(spark, parquet_topic(path, rows.schema, maxFilesPerTrigger="1"))


def _membership(spark, sf_dir, days_back: int = 0) -> DataFrame:
    events = _storefront(spark, sf_dir)
    return segments.evaluate_segments(events, standard_segments(), metrics.as_of(events) - days_back * DAY_MS)


def _segment_groups(spark) -> DataFrame:
    return segment_definitions(spark).select(F.col("id").alias("segment_id"))


# Sources and sinks -----------------------------------------------------------------------

EVENT_COLUMNS = ["event_id", "profile_id", "event_type", "timestamp_ms"]


@register
def topic_snapshot(spark, sf_dir):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    rows = samples.project_base(read_topic_snapshot(spark, _event_source(sf_dir)))
    return samples.storefront(rows).select(*EVENT_COLUMNS)


@register
def topic_stream(spark, sf_dir):
    rows = samples.storefront(_event_stream(spark, sf_dir)).select(*EVENT_COLUMNS)
    path = new_path(spark, "topic-stream")
    finish(append_files(rows, f"{path}/rows", f"{path}/checkpoint"))
    return spark.read.schema(rows.schema).parquet(f"{path}/rows")


@register
def decode_records(spark, sf_dir, _decode=decode_records):
    events = samples.events(spark, sf_dir).select("event_id", "props")
    broken, empty = F.col("event_id") % 50 == 0, F.col("event_id") % 50 == 1
    payloads = (F.when(broken, F.array(F.col("props"), F.lit("{"))).when(empty, F.array(F.col("props"), F.lit("{}")))
                .otherwise(F.array("props")))
    received = events.select("event_id", F.explode(payloads).alias("payload"))
    schema = T.StructType([T.StructField("k", T.LongType())])
    return _decode(received, "payload", schema, keep=("event_id",))


@register
def parse_webhooks(spark, sf_dir, _parse=parse_webhooks):
    n = F.col("n")
    sent = _webhooks(spark, sf_dir).select(F.to_json(F.struct(
        F.when(n % 40 == 0, "").otherwise(F.col("webhook_id")).alias("webhook_id"), "message_id",
        F.when(n % 60 == 0, "").otherwise(F.col("channel")).alias("channel"), "status", "provider",
        F.when(n % 30 == 0, 0).otherwise(F.col("timestamp_ms")).alias("timestamp_ms"))).alias("body"), "n")
    broken = F.when(n % 50 == 0, F.array(F.col("body"), F.lit("{"), F.lit("[1]"))).otherwise(F.array("body"))
    return _parse(sent.select(F.explode(broken).alias("body")), JANUARY_END_MS)


@register
def keyed_partitions(spark, sf_dir):
    readings = _readings(spark, sf_dir).select(*READING.names)
    path = new_path(spark, "keyed")
    write_keyed(readings, "device_id", {"format": "parquet", "path": path}, ["timestamp_ms", "sequence"])
    # Rows as they lie in the files, with the row before of the same device.
    found = read_keyed(spark, path, READING).select("*", "_metadata.file_name", "_metadata.row_index")
    here = F.struct("timestamp_ms", "sequence")
    before = F.lag(here).over(W.partitionBy("device_id").orderBy("file_name", "row_index"))
    return found.withColumn("misplaced", F.coalesce(before > here, F.lit(False))).groupBy("device_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("partition").alias("n_partitions"),
        F.count_if("misplaced").alias("n_misplaced"))


@register
def event_store_append(spark, sf_dir):
    """Three micro-batches in arrival order, read back whole."""
    rows = _arriving(_storefront(spark, sf_dir)).select(*STOREFRONT_EVENT.names, "arrival")
    path = new_path(spark, "event-store")
    stream = _staged_stream(spark, rows, ["arrival"], 3).drop("arrival")
    finish(append_event_store(stream, f"{path}/rows", f"{path}/checkpoint"))
    return spark.read.parquet(f"{path}/rows").select(
        "event_id", "profile_id", "event_type", "timestamp_ms", F.col("attributes")["category"].alias("category"),
        F.col("attributes")["price"].alias("price"), F.col("event_date").cast("string").alias("event_date"))


@register
def undelivered_replay(spark, sf_dir):
    """A sink that is down for the first three micro-batches and then recovers."""
    readings = _readings(spark, sf_dir).select(*READING.names)
    path = new_path(spark, "replay")
    offers = []

    def sink(rows: DataFrame, name: str) -> None:
        offers.append(name)
        if len(offers) <= 3:
            raise ConnectionError("sink is down")
        rows.write.mode("overwrite").parquet(f"{path}/delivered/parcel={name}")

    stream = _staged_stream(spark, readings, ["timestamp_ms", "device_id", "sequence"], 4)
    finish(deliver_with_replay(stream, sink, f"{path}/undelivered", f"{path}/checkpoint"))
    if drain_undelivered(spark, f"{path}/undelivered", READING, sink):
        raise RuntimeError("rows are still undelivered")
    return spark.read.schema(READING).parquet(f"{path}/delivered").select("device_id", "sequence")


@register
def table_reset(spark, sf_dir):
    webhooks = _webhooks(spark, sf_dir).select(*DELIVERY_WEBHOOK.names)
    path = new_path(spark, "table")
    name = "rillmark_" + path.rsplit("-", 1)[1]
    ensure_table(spark, name, DELIVERY_WEBHOOK, path)
    ensure_table(spark, name, DELIVERY_WEBHOOK, path)
    webhooks.write.insertInto(name)
    before = spark.table(name).count()
    truncate_table(spark, name)
    return spark.table(name).agg(F.lit(before).alias("n_before"), F.count(F.lit(1)).alias("n"))


@register
def membership_snapshot(spark, sf_dir):
    before, after = _membership(spark, sf_dir, 7), _membership(spark, sf_dir)
    path = new_path(spark, "membership")
    write_membership(before.withColumn("change", F.lit("added")), path, 0)
    write_membership(segments.membership_delta(read_membership(spark, path), after), path, 1)
    return read_membership(spark, path)


@register
def membership_delta(spark, sf_dir):
    return segments.membership_delta(_membership(spark, sf_dir, 7), _membership(spark, sf_dir))


@register
def summary_json(spark, sf_dir):
    rows = delivery.summary(delivery.minute_rollup(_webhooks(spark, sf_dir)))
    return json_body(rows, "2024-02-01T00:00:00Z")


@register
def json_rows(spark, sf_dir):
    return to_json_rows(delivery.summary(delivery.minute_rollup(_webhooks(spark, sf_dir))))


# Scalar functions ------------------------------------------------------------------------

@register
def scalar_time(spark, sf_dir):
    ms = F.col("timestamp_ms")
    return _webhooks(spark, sf_dir).select(
        "webhook_id", minute_floor(ms).alias("minute"), (ms - DAY_MS).alias("day_ago_ms"),
        clock_seconds_between(F.lit(0).cast("long"), ms).alias("clock_sec"), timestamp_text(ms).alias("at_text"))


@register
def scalar_map(spark, sf_dir):
    return _storefront(spark, sf_dir).select(
        "event_id", attribute(F.col("attributes"), "category").alias("category"),
        price_of(F.col("attributes")).cast("double").alias("price_or_zero"))


@register
def scalar_string(spark, sf_dir):
    text = id_with_amount(F.col("event_id"), price_of(F.col("attributes")))
    return _storefront(spark, sf_dir).select(
        "event_id", padded_id("evt-", F.col("n"), 8).alias("padded_id"), text.alias("price_text"),
        split_once(text, 1).alias("price_part"))


@register
def filter_events(spark, sf_dir):
    events = _storefront(spark, sf_dir)
    as_of = metrics.as_of(events)
    return events.where((F.col("event_type") == "purchase") & (F.col("timestamp_ms") <= as_of)
                        & (F.col("timestamp_ms") >= as_of - 30 * DAY_MS)).select("event_id")


# Deduplication ---------------------------------------------------------------------------

@register
def dedup_readings(spark, sf_dir):
    rows = samples.delivered(_readings(spark, sf_dir)).select("device_id", "sequence")
    return dedup.unique_per_stream(rows)


@register
def dedup_events(spark, sf_dir):
    return dedup.dedup(samples.delivered(_storefront(spark, sf_dir)).select("event_id"), ["event_id"])


@register
def dedup_webhooks(spark, sf_dir):
    return dedup.dedup(samples.delivered(_webhooks(spark, sf_dir)).select("webhook_id"), ["webhook_id"])


@register
def dedup_first(spark, sf_dir):
    rows = samples.delivered(_readings(spark, sf_dir))
    return dedup.dedup_first(rows, ["device_id", "sequence"], ARRIVAL_ORDER).select("device_id", "sequence", "copy")


@register
def dedup_verdict(spark, sf_dir):
    rows = samples.delivered(_storefront(spark, sf_dir)).select("event_id", *ARRIVAL_ORDER)
    return dedup.dedup_verdict(rows, ["event_id"], ARRIVAL_ORDER).select("event_id", "copy", "accepted")


@register
def dedup_counts(spark, sf_dir):
    return dedup.dedup_counts(samples.delivered(_storefront(spark, sf_dir)), ["event_id"])


@register
def dedup_bounded(spark, sf_dir):
    """A memory so small that it forgets."""
    rows = samples.delivered(_readings(spark, sf_dir)).select("device_id", "sequence", *ARRIVAL_ORDER)
    return bounded.dedup_bounded(rows, "device_id", "sequence", ARRIVAL_ORDER, 3).select("device_id", "sequence", "copy")


@register
def dedup_bounded_stream(spark, sf_dir, _stream=dedup_bounded_stream):
    rows = samples.delivered(_readings(spark, sf_dir)).select("device_id", "sequence", *ARRIVAL_ORDER)
    path = new_path(spark, "bounded")
    with rocksdb_state(spark):
        stream = _stream(_one_by_one(spark, rows, 3), "device_id", "sequence", ARRIVAL_ORDER, 3)
        finish(append_files(stream, f"{path}/rows", f"{path}/checkpoint"))
    return spark.read.schema(rows.schema).parquet(f"{path}/rows").select("device_id", "sequence", "copy")


@register
def dedup_stream_late(spark, sf_dir, _stream=dedup_stream):
    """A topic out of order: every id comes through, however late."""
    rows = samples.delivered(_storefront(spark, sf_dir)).select("event_id", "timestamp_ms", *ARRIVAL_ORDER)
    path = new_path(spark, "dedup-stream")
    with rocksdb_state(spark):
        stream = _stream(_staged_stream(spark, rows, ARRIVAL_ORDER, 3), ["event_id"]).select("event_id", "timestamp_ms")
        finish(append_files(stream, f"{path}/rows", f"{path}/checkpoint"))
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def _md5_shard(shards: int):
    return (F.conv(F.substring(F.md5(F.col("event_id").cast("binary")), 1, 8), 16, 10).cast("long") % shards).cast("int")


@register
def dedup_sharded(spark, sf_dir):
    """Sixteen shards that remember 64 ids each, so that they forget; ids are dealt by MD5, which SQL has too."""
    rows = samples.delivered(_storefront(spark, sf_dir)).select("event_id", *ARRIVAL_ORDER)
    return bounded.dedup_sharded(rows, "event_id", ARRIVAL_ORDER, 1024, 16, shard=_md5_shard(16)).select("event_id", "copy")


@register
def dedup_sharded_stream(spark, sf_dir, _stream=dedup_sharded_stream):
    rows = samples.delivered(_storefront(spark, sf_dir)).select("event_id", *ARRIVAL_ORDER)
    path = new_path(spark, "sharded")
    with rocksdb_state(spark):
        stream = _stream(_one_by_one(spark, rows, 3), "event_id", ARRIVAL_ORDER, 1024, 16, _md5_shard(16))
        finish(append_files(stream, f"{path}/rows", f"{path}/checkpoint"))
    return spark.read.schema(rows.schema).parquet(f"{path}/rows").select("event_id", "copy")


@register
def dedup_state_size(spark, sf_dir):
    rows = samples.delivered(_readings(spark, sf_dir))
    return dedup.state_size(rows, "device_id", "sequence", 16).withColumnRenamed("groups", "devices")


@register
def dedup_state_peak(spark, sf_dir):
    rows = samples.delivered(_readings(spark, sf_dir))
    trace = dedup.state_trace(rows, "device_id", "sequence", ARRIVAL_ORDER, 16, 500)
    return dedup.state_peak(trace, rows, "device_id", 16)


@register
def dedup_state_trace(spark, sf_dir):
    rows = samples.delivered(_readings(spark, sf_dir))
    return dedup.state_trace(rows, "device_id", "sequence", ARRIVAL_ORDER, 16, 500)


@register
def duplicate_stats(spark, sf_dir):
    return dedup.duplicate_stats(samples.delivered(_storefront(spark, sf_dir)), ["event_id"])


# Comparison ------------------------------------------------------------------------------

@register
def diff_sets(spark, sf_dir):
    return reconcile.diff_sets(_membership(spark, sf_dir), _membership(spark, sf_dir, 1),
                               "segment_id", "profile_id", _segment_groups(spark))


@register
def multiset_diff(spark, sf_dir):
    events = _storefront(spark, sf_dir)
    return reconcile.multiset_diff(samples.delivered(events), events, "event_id")


@register
def rollup_reconcile(spark, sf_dir):
    webhooks = _webhooks(spark, sf_dir)
    rollup = delivery.minute_rollup(webhooks)
    minute_number = F.call_function("div", F.unix_seconds("minute"), F.lit(60).cast("long"))
    damaged = rollup.where(~((F.col("channel") == "mail") & (minute_number % 7 == 0)))
    return reconcile.reconcile(delivery.recompute_counts(webhooks), delivery.rollup_counts(damaged),
                               ["channel", "status"], "count")


@register
def lost_records(spark, sf_dir):
    readings = _readings(spark, sf_dir)
    return reconcile.lost_records(readings, readings.where(F.col("n") % 97 != 0), ["device_id", "sequence"])


@register
def state_digest(spark, sf_dir):
    thousandths = F.round(F.col("value") * 1000).cast("long")
    return digest.state_digest(_readings(spark, sf_dir), "device_id", "sequence", thousandths)


@register
def table_digest(spark, sf_dir):
    return digest.table_digest(state_digest(spark, sf_dir), "device_id")


def _sent_and_received(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Some receipts are lost, some come before they were sent, some only days later."""
    events, n = _storefront(spark, sf_dir), F.col("n")
    late = F.when(n % 40 == 1, -10).when(n % 40 == 2, 300_000_000).otherwise(n * 37 % 250)
    return events.select("event_id", F.col("timestamp_ms").alias("sent_ms")), events.where(n % 50 != 0).select(
        "event_id", (F.col("timestamp_ms") + late).alias("received_ms"))


def _lags(spark, sf_dir):
    return metrics.event_lag(*_sent_and_received(spark, sf_dir), "event_id")


@register
def event_lag_stream(spark, sf_dir, _stream=event_lag_stream):
    sent, received = _sent_and_received(spark, sf_dir)
    path = new_path(spark, "lag-stream")
    with rocksdb_state(spark):
        lags = _stream(_staged_stream(spark, sent, ["sent_ms"], 2), _staged_stream(spark, received, ["received_ms"], 2), "event_id")
        finish(append_files(lags, f"{path}/rows", f"{path}/checkpoint"))
    return spark.read.schema(lags.schema).parquet(f"{path}/rows")


@register
def event_lag(spark, sf_dir):
    return _lags(spark, sf_dir)


@register
def lag_percentiles(spark, sf_dir):
    return metrics.floor_rank_percentiles(_lags(spark, sf_dir), "lag_ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@register
def lag_percentiles_fractional(spark, sf_dir):
    lags = _lags(spark, sf_dir).select((F.col("lag_ms") / 8).alias("lag_ms"))
    return metrics.floor_rank_percentiles(lags, "lag_ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@register
def consumer_lag(spark, sf_dir):
    rows = _storefront(spark, sf_dir).withColumn("partition", (F.col("n") % 6).cast("int"))
    last = rows.groupBy("partition").agg(F.count(F.lit(1)).alias("last"))
    read = rows.where((F.col("n") % 10 != 0) & (F.col("partition") != 5))
    positions = read.groupBy("partition").agg(F.count(F.lit(1)).alias("position"))
    return metrics.consumer_lag(last, positions)


# Metrics ---------------------------------------------------------------------------------

@register
def loss_by_rate(spark, sf_dir):
    rates = F.array(*[F.lit(rate) for rate in (30, 50, 70, 90, 110, 150, 200, 300)])
    rate = F.element_at(rates, (F.col("n") % 8 + 1).cast("int"))
    rows = samples.base(spark, sf_dir).select(rate.alias("rate"), "k")
    over = F.call_function("div", F.col("rate") - 100, F.lit(2))
    return metrics.loss_by_rate(rows.withColumn("diverted", (F.col("rate") > 100) & (F.col("k") < over)))


@register
def throughput(spark, sf_dir):
    return delivery.throughput(_webhooks(spark, sf_dir))


@register
def store_counts(spark, sf_dir):
    return metrics.store_counts(_storefront(spark, sf_dir), "profile_id")


@register
def rollup_ratio(spark, sf_dir):
    webhooks = _webhooks(spark, sf_dir)
    return delivery.rollup_ratio(webhooks, delivery.minute_rollup(webhooks))


# Delivery --------------------------------------------------------------------------------

@register
def delivery_recompute(spark, sf_dir):
    return delivery.recompute_counts(_webhooks(spark, sf_dir))


@register
def delivery_rollup_counts(spark, sf_dir):
    return delivery.rollup_counts(delivery.minute_rollup(_webhooks(spark, sf_dir)))


@register
def delivery_summary(spark, sf_dir):
    return delivery.summary(delivery.minute_rollup(_webhooks(spark, sf_dir)))


@register
def channel_counts(spark, sf_dir):
    return delivery.channel_counts(_webhooks(spark, sf_dir))


@register
def minute_rollup(spark, sf_dir):
    return delivery.minute_rollup(_webhooks(spark, sf_dir))


@register
def minute_rollup_merge(spark, sf_dir):
    """Three partial rollups, of every third webhook each, merged on read."""
    webhooks = _webhooks(spark, sf_dir).withColumn("part", F.col("n") % 3)
    minute = floor_ms(F.col("timestamp_ms"), MINUTE_MS)
    partial = (webhooks.groupBy("part", minute.alias("minute_ms"), "channel", "status")
               .agg(F.count(F.lit(1)).alias("event_count"))
               .withColumn("minute", F.timestamp_millis("minute_ms")))
    return delivery.merge_rollup(partial)


@register
def minute_rollup_stream(spark, sf_dir, _stream=minute_rollup_stream):
    """Four micro-batches out of order, so that most minutes are added to more than once."""
    rows = _arriving(_webhooks(spark, sf_dir)).select(*DELIVERY_WEBHOOK.names, "arrival")
    path = new_path(spark, "rollup")
    finish(_stream(_staged_stream(spark, rows, ["arrival"], 4), f"{path}/rollup", f"{path}/checkpoint"))
    return read_rollup(spark, f"{path}/rollup")


@register
def minute_windows(spark, sf_dir):
    rows = _arriving(_webhooks(spark, sf_dir)).select(*DELIVERY_WEBHOOK.names, "arrival")
    path = new_path(spark, "windows")
    with rocksdb_state(spark):
        finish(minute_windows_stream(_staged_stream(spark, rows, ["arrival"], 3), f"{path}/rows", f"{path}/checkpoint"))
    return read_windows(spark, f"{path}/rows")


def _dashboard_start(webhooks) -> int:
    return metrics.as_of(webhooks) - 6 * HOUR_MS


@register
def dashboard_raw(spark, sf_dir):
    webhooks = _webhooks(spark, sf_dir)
    return delivery.dashboard_raw(webhooks, _dashboard_start(webhooks))


@register
def dashboard_rollup(spark, sf_dir):
    webhooks = _webhooks(spark, sf_dir)
    return delivery.dashboard_rollup(delivery.minute_rollup(webhooks), _dashboard_start(webhooks))


@register
def dashboard_totals(spark, sf_dir):
    return delivery.dashboard_totals(delivery.summary(delivery.minute_rollup(_webhooks(spark, sf_dir))))


@register
def message_lifecycle(spark, sf_dir):
    return delivery.message_lifecycle(_webhooks(spark, sf_dir)).select(
        "message_id", "position", "webhook_id", "status", "timestamp_ms")


# Profiles --------------------------------------------------------------------------------

@register
def as_of(spark, sf_dir):
    return metrics.latest_time(_storefront(spark, sf_dir))


@register
def profile_stats(spark, sf_dir):
    return segments.profile_stats(_storefront(spark, sf_dir))


@register
def category_views(spark, sf_dir):
    return segments.category_views(_storefront(spark, sf_dir))


@register
def profile_timeline(spark, sf_dir):
    return timeline.profile_timeline(_storefront(spark, sf_dir)).select("profile_id", "event_id", "position")


@register
def rolling_purchases(spark, sf_dir):
    days = (7, 30, 90)
    rows = timeline.rolling_purchases(_storefront(spark, sf_dir), days)
    return rows.select("event_id", *[f"n_{d}d" for d in days],
                       *[F.col(f"value_{d}d").cast("double").alias(f"value_{d}d") for d in days])


@register
def membership_timeline(spark, sf_dir):
    return timeline.membership_timeline(_storefront(spark, sf_dir), standard_segments()).select(
        "profile_id", "event_id", "segment_id", "change")


def _register_family(name: str, operator, **parameters) -> None:
    def query(spark, sf_dir):
        events = _storefront(spark, sf_dir)
        return operator(events, metrics.as_of(events), **parameters)

    query.__name__ = name
    register(query)


_register_family("segment_purchase_count", segments.segment_purchase_count, min_count=2, window_days=30)
_register_family("segment_purchase_value", segments.segment_purchase_value, min_value=100.0, window_days=90)
_register_family("segment_cart_abandon", segments.segment_cart_abandon, min_days=7)
_register_family("segment_category_views", segments.segment_category_views, category="electronics", min_count=3)
_register_family("segment_recently_active", segments.segment_recently_active, min_hours=24)
_register_family("segment_never_purchased", segments.segment_never_purchased)
_register_family("segment_churn_risk", segments.segment_churn_risk, min_days=30)
_register_family("segment_multi_category", segments.segment_multi_category, min_distinct=3)


@register
def segment_definitions_in_use(spark, sf_dir):
    """Every definition with all its parameters and its number of members."""
    definitions = segment_definitions(spark)
    sizes = segments.segment_sizes(_membership(spark, sf_dir), definitions)
    return definitions.join(sizes.withColumnRenamed("segment_id", "id"), "id")


REGISTERED["segment_definitions"] = REGISTERED.pop("segment_definitions_in_use")


@register
def segment_membership_all(spark, sf_dir):
    return _membership(spark, sf_dir)


@register
def segments_incremental(spark, sf_dir):
    """The membership the stream itself writes over three micro-batches out of order, without a final pass.
    After the second one the logs are merged and purchases out of reach are trimmed."""
    path = new_path(spark, "segments")
    rows = _arriving(_storefront(spark, sf_dir)).select(*STOREFRONT_EVENT.names, "arrival")
    events = _staged_stream(spark, rows, ["arrival"], 3)
    finish(incremental_segments(events, standard_segments(), path, f"{path}/checkpoint", compact_every=2))
    return current_segments(spark, path)


def _finalized(spark, stream: DataFrame) -> DataFrame:
    path = new_path(spark, "segments")
    finish(incremental_segments(stream, standard_segments(), path, f"{path}/checkpoint"))
    return finalize_segments(spark, path, standard_segments())


@register
def segments_finalize(spark, sf_dir):
    """From a repeated and shuffled topic: deduplicated, folded in two micro-batches, finalised."""
    rows = samples.delivered(_storefront(spark, sf_dir))
    stream = _staged_stream(spark, rows, ARRIVAL_ORDER, 2)
    with rocksdb_state(spark):
        return _finalized(spark, dedup_stream(stream, ["event_id"]))


@register
def segments_validate(spark, sf_dir):
    """The incremental result of a shuffled topic, read in three micro-batches, against the full one."""
    rows = _arriving(_storefront(spark, sf_dir))
    incremental = _finalized(spark, _staged_stream(spark, rows, ["arrival", "n"], 3))
    return reconcile.diff_sets(incremental, _membership(spark, sf_dir), "segment_id", "profile_id",
                               _segment_groups(spark))


@register
def segment_sizes(spark, sf_dir):
    return segments.segment_sizes(_membership(spark, sf_dir), segment_definitions(spark))


@register
def members_of(spark, sf_dir):
    return segments.members_of(_membership(spark, sf_dir), "purchase_count_min_2_30d")


@register
def profile_segments(spark, sf_dir):
    rows = segments.profile_segments(_membership(spark, sf_dir))
    return rows.select("profile_id", F.array_join("segments", ",").alias("segments"))
