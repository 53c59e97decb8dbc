from rillmark.operators import delivery
from rillmark.operators.dedup import dedup
from rillmark.operators.reconcile import reconcile, reconcile_totals
from rillmark.schemas import DELIVERY_WEBHOOK
from rillmark.sinks import json_body, read_log, to_json_rows
from rillmark.sources import parquet_topic, read_topic_stream
from rillmark.schemas import MINUTE_ROLLUP
from rillmark.streaming.delivery import compact_rollup, minute_rollup_stream, minute_windows_stream, read_rollup, read_windows
from rillmark.streaming.running import finish

START = 1_704_067_200_000


def webhooks(spark, rows):
    """``rows`` of (webhook, message, channel, status, ms after START)."""
    return spark.createDataFrame([(w, m, c, s, START + ms, "p") for w, m, c, s, ms in rows], DELIVERY_WEBHOOK)


ROWS = [("w1", "m1", "email", "sent", 0), ("w2", "m1", "email", "delivered", 59_999), ("w3", "m2", "email", "sent", 60_000),
        ("w4", "m3", "sms", "sent", 61_000), ("w5", "m4", "sms", "sent", 185_000), ("w6", "m4", "sms", "failed", 185_001)]


def counts(df, value="count"):
    return {(r.channel, r.status): r[value] for r in df.collect()}


def test_rollup_sums_to_the_recompute(spark):
    hooks = webhooks(spark, ROWS)
    rollup = delivery.minute_rollup(hooks)
    assert rollup.count() == 6
    want = {("email", "sent"): 2, ("email", "delivered"): 1, ("sms", "sent"): 2, ("sms", "failed"): 1}
    assert counts(delivery.recompute_counts(hooks)) == counts(delivery.rollup_counts(rollup)) == want
    assert counts(delivery.summary(rollup)) == want
    assert counts(delivery.rollup_counts(rollup.unionByName(rollup))) == {k: 2 * v for k, v in want.items()}
    assert delivery.merge_rollup(rollup.unionByName(rollup)).count() == 6


def test_dashboards_agree_from_inside_a_minute_and_with_duplicates(spark):
    hooks = webhooks(spark, [*ROWS, ROWS[2]])
    rollup = delivery.minute_rollup(dedup(hooks, ["webhook_id"]))
    for start in (START, START + 60_500, START + 119_999, START + 10**9):
        raw = [tuple(r) for r in delivery.dashboard_raw(hooks, start).collect()]
        assert raw == [tuple(r) for r in delivery.dashboard_rollup(rollup, start).collect()]
        assert raw == sorted(raw)
    assert len(delivery.dashboard_raw(hooks, START + 60_500).collect()) == 4


def test_totals_and_share(spark):
    rows = delivery.dashboard_totals(delivery.summary(delivery.minute_rollup(webhooks(spark, ROWS)))).collect()
    got = {(r.channel, r.status): (r.channel_total, r.grand_total, r.share) for r in rows}
    assert got[("email", "delivered")] == (3, 6, 0.5) and got[("sms", "sent")] == (3, 6, 1.0)


def test_lifecycle_throughput_ratio(spark):
    hooks = webhooks(spark, ROWS)
    life = {r.webhook_id: r.position for r in delivery.message_lifecycle(hooks, 30_000).collect()}
    assert life == {"w1": 1, "w2": 2, "w3": 1, "w4": 1, "w5": 1, "w6": 2}
    assert sorted(r.rows_per_sec for r in delivery.throughput(hooks).collect()) == [0.033333] * 3
    assert delivery.overall_throughput(hooks).first().asDict() == {"rows_n": 6, "rows_per_sec": 0.032432}
    rollup = delivery.minute_rollup(hooks).limit(3)
    assert delivery.rollup_ratio(hooks, rollup).first().asDict() == {"raw_n": 6, "rollup_n": 3, "ratio": 0.5}
    assert counts(delivery.channel_counts(hooks).selectExpr("channel", "'' AS status", "count")) == {
        ("email", ""): 3, ("sms", ""): 3}


def test_reconcile_shows_keys_of_either_side(spark):
    expected = spark.createDataFrame([("a", 1), ("b", 2)], "k string, count long")
    actual = spark.createDataFrame([("a", 1), ("c", 3)], "k string, count long")
    result = reconcile(expected, actual, ["k"], "count")
    assert sorted(tuple(r) for r in result.collect()) == [("a", 1, 1, True), ("b", 2, 0, False), ("c", 0, 3, False)]
    assert reconcile_totals(result).first().asDict() == {
        "pairs_n": 3, "exact_n": 1, "expected_n": 3, "actual_n": 4, "exact": False}


def test_json(spark):
    rows = delivery.summary(delivery.minute_rollup(webhooks(spark, ROWS[:1])))
    assert to_json_rows(rows).first().value == '{"channel":"email","status":"sent","count":1}'
    assert json_body(rows, "now").first().body == (
        '{"generated_at":"now","rows":[{"channel":"email","status":"sent","count":1}]}')


def test_rollup_stream_with_compaction(spark, path):
    hooks = webhooks(spark, ROWS)
    hooks.repartition(3).write.parquet(f"{path}/in")
    source = parquet_topic(f"{path}/in", DELIVERY_WEBHOOK, maxFilesPerTrigger="1")
    finish(minute_rollup_stream(read_topic_stream(spark, source), f"{path}/rollup", f"{path}/check"))
    want = sorted(map(tuple, delivery.minute_rollup(hooks).collect()))
    assert sorted(map(tuple, read_rollup(spark, f"{path}/rollup").collect())) == want
    last = compact_rollup(spark, f"{path}/rollup")
    assert last is not None and compact_rollup(spark, f"{path}/rollup") == last
    assert read_log(spark, f"{path}/rollup", MINUTE_ROLLUP).count() == len(want)
    webhooks(spark, [("w9", "m9", "sms", "sent", 61_000)]).write.mode("append").parquet(f"{path}/in")
    finish(minute_rollup_stream(read_topic_stream(spark, source), f"{path}/rollup", f"{path}/check"))
    assert counts(delivery.rollup_counts(read_rollup(spark, f"{path}/rollup")))[("sms", "sent")] == 3


def test_windowed_rollup(spark, path):
    rows = [*ROWS, ("w9", "m9", "sms", "sent", 10**8)]
    webhooks(spark, rows[-1:]).write.parquet(f"{path}/in")  # the newest comes first
    source = parquet_topic(f"{path}/in", DELIVERY_WEBHOOK)
    finish(minute_windows_stream(read_topic_stream(spark, source), f"{path}/out", f"{path}/check"))
    webhooks(spark, rows[:-1]).coalesce(1).write.mode("append").parquet(f"{path}/in")
    finish(minute_windows_stream(read_topic_stream(spark, source), f"{path}/out", f"{path}/check"))
    got = sorted(map(tuple, read_windows(spark, f"{path}/out").collect()))
    assert got == sorted(map(tuple, delivery.minute_rollup(webhooks(spark, rows)).collect()))
