import random

import pytest
from helpers import readings
from pyspark.sql import functions as F

from rillmark.operators import digest, metrics, reconcile
from rillmark.operators.scan import in_ranges, positions, running


def sets(spark, **groups):
    return spark.createDataFrame([(g, i) for g, ids in groups.items() for i in ids], "g string, i string")


@pytest.mark.parametrize("left,right,want", [
    (["p1", "p2"], ["p1", "p2"], (2, 2, 0, 0, True)), (["p1", "p2"], ["p1", "p3"], (2, 2, 1, 1, False)),
    (["p1", "p1"], ["p1"], (1, 1, 0, 0, True)), ([], ["p1"], (0, 1, 0, 1, False))])
def test_diff_sets(spark, left, right, want):
    groups = spark.createDataFrame([("s",), ("empty",)], "g string")
    got = reconcile.diff_sets(sets(spark, s=left), sets(spark, s=right), "g", "i", groups)
    rows = {r.g: tuple(r)[1:] for r in got.collect()}
    assert rows == {"s": want, "empty": (0, 0, 0, 0, True)}


def test_multisets_count_copies(spark):
    left, right = sets(spark, s=["a", "a", "b"]), sets(spark, s=["a", "b", "c"])
    got = {r.i: (r.left_n, r.right_n) for r in reconcile.multiset_diff(left, right, "i").collect()}
    assert got == {"a": (2, 1), "c": (0, 1)}
    assert not reconcile.multiset_equal(left, right, "i") and reconcile.multiset_equal(left, left, "i")


def test_lost_records(spark):
    sent, landed = sets(spark, s=["a", "b", "c"]), sets(spark, s=["a", "a", "x"])
    assert tuple(reconcile.lost_records(sent, landed, ["i"]).first()) == (3, 2, 2)
    assert sorted(r.i for r in reconcile.lost_ids(sent, landed, ["i"]).collect()) == ["b", "c"]
    assert [r.i for r in reconcile.lost_ids(landed, sent, ["i"]).collect()] == ["x"]


def digests(df):
    rows = digest.state_digest(df, "device_id", "sequence", F.col("value"))
    return {r.device_id: r.digest for r in rows.collect()}, digest.table_digest(rows, "device_id").first().digest


def test_digest_depends_on_content_only(spark):
    rows = [("d2", 1, 1), ("d1", 2, 2), ("d1", 70_000, 7), ("d1", 1, 1), ("d1", 2**40, 3)]
    table = readings(spark, rows)
    assert digests(table) == digests(readings(spark, rows[::-1]).repartition(3))
    devices, whole = digests(readings(spark, [*rows, ("d3", 1, 99)]))
    assert whole != digests(table)[1] and devices["d1"] == digests(table)[0]["d1"]
    for changed in ([*rows, rows[0]], [("d2", 1, 2), *rows[1:]], rows[1:]):
        assert digests(readings(spark, changed)) != digests(table)
    quick = lambda df: tuple(digest.quick_fingerprint(df, ["device_id", "sequence", "value"]).first())
    assert quick(table) == quick(readings(spark, rows[::-1])) != quick(readings(spark, rows[1:]))


def naive_percentile(values, share):
    if not values:
        return 0
    return sorted(values)[max(0, min(len(values) - 1, int(share * len(values)) - 1))]


@pytest.mark.parametrize("values", [list(range(1, 21)), list(range(1, 31)), [7], [], [5, 5, 5, 9000, -3]])
def test_floor_rank_percentiles(spark, values):
    shares = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    rows = spark.createDataFrame([(v,) for v in values], "v long")
    got = metrics.floor_rank_percentiles(rows, "v", shares, "low", "high", buckets=4).first().asDict()
    want = {name: naive_percentile(values, share) for name, share in shares.items()}
    assert got == {**want, "low": min(values, default=0), "high": max(values, default=0), "n": len(values)}
    assert metrics.approximate_percentiles(rows, "v", shares).count() == 1


def test_lag_offsets_and_loss(spark):
    sent = spark.createDataFrame([("a", 10), ("b", 20)], "i string, sent_ms long")
    received = spark.createDataFrame([("a", 15), ("a", 17), ("z", 1)], "i string, received_ms long")
    assert sorted(r.lag_ms for r in metrics.event_lag(sent, received, "i").collect()) == [5, 7]
    last = spark.createDataFrame([(0, 10), (1, 5), (2, 3)], "partition int, last long")
    read = spark.createDataFrame([(0, 4), (1, 9)], "partition int, position long")
    lag = metrics.consumer_lag(last, read)
    assert {r.partition: r.lag for r in lag.collect()} == {0: 6, 1: 0, 2: 3}
    assert metrics.total_lag(lag).first().lag == 9
    rates = spark.createDataFrame([(30, False), (110, True), (110, False), (200, True)], "rate int, diverted boolean")
    got = {r.rate: (r.fraction, r.first_lossy_rate) for r in metrics.loss_by_rate(rates).collect()}
    assert got == {30: (0.0, 110), 110: (0.5, 110), 200: (1.0, 110)}
    none = metrics.loss_by_rate(rates.where("NOT diverted")).first()
    assert none.first_lossy_rate is None
    assert metrics.speed_up(10, 2) == 5 and metrics.speed_up(1, 0) is None


def test_running_and_positions_like_a_loop(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.randrange(-50, 50), rng.randrange(9), i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, at long, v long, i long")
    for r in running(df, ["k"], "at", 7, sums=["v"], highs=["i"]).collect():
        upto = [x for x in rows if x[0] == r.k and x[1] <= r["at"]]
        assert (r.run_v, r.run_i) == (sum(x[2] for x in upto), max(x[3] for x in upto))
    ranked = {r.i: r.position for r in positions(df, ["k"], ["at", "i"]).collect()}
    for key in "ab":
        own = sorted((x[1], x[3]) for x in rows if x[0] == key)
        assert [ranked[i] for _, i in own] == list(range(1, len(own) + 1))
    everything = {r.i: r.position for r in positions(df, [], ["at", "i"]).collect()}
    assert [everything[i] for _, i in sorted((x[1], x[3]) for x in rows)] == list(range(1, 301))


def test_positions_split_a_hot_moment(spark):
    rows = spark.range(30_000).selectExpr("if(id % 3 = 0, 'hot', concat('k', id % 50)) AS k", "if(id % 3 = 0, 7, id) AS at", "id AS i")
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = sorted(r["count"] for r in in_ranges(rows, ["k"], ["at", "i"]).groupBy("_range").count().collect())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert len(sizes) > 2 and sizes[-1] <= 1.5 * sizes[len(sizes) // 2]
    hot = positions(rows, ["k"], ["at", "i"], total="n").where("k = 'hot'")
    assert hot.where("position = i / 3 + 1 AND n = 10000").count() == 10_000


@pytest.mark.parametrize("buckets", [3, 1024])
def test_percentiles_of_any_values(spark, buckets):
    rng = random.Random(buckets)
    inf, nan = float("inf"), float("nan")
    cases = {
        "fractions": [rng.random() for _ in range(2000)],
        "ties": [rng.choice([-1.5, 0.0, 2.25]) for _ in range(500)] + [7.0],
        "magnitudes": [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300) for _ in range(500)] + [1.7e308, -1.7e308, 5e-324, 0.0],
        "not finite": [nan, inf, -inf, nan, 1.0, -inf, 3.0],
        "one": [4.5], "all nan": [nan, nan], "none": []}
    shares = {"p01": 0.01, "p50": 0.5, "p95": 0.95, "p99": 0.99}
    for name, values in cases.items():
        rows = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
        got = metrics.floor_rank_percentiles(rows, "v", shares, "low", "high", buckets).first().asDict()
        ordered = sorted(values, key=lambda v: (v != v, 0 if v != v else v))
        want = {key: ordered[max(1, int(share * len(ordered))) - 1] if ordered else 0.0 for key, share in shares.items()}
        want |= {"low": ordered[0] if ordered else 0.0, "high": ordered[-1] if ordered else 0.0, "n": len(values)}
        assert repr(got) == repr({key: want[key] for key in got}), name
    ends = [-2 ** 63, 2 ** 63 - 1, 2 ** 62, 2 ** 62 + 1, 2 ** 62 + 2, -5, 0]
    rows = spark.createDataFrame([(v,) for v in ends], "v long")
    got = metrics.floor_rank_percentiles(rows, "v", {"p50": 0.5, "p90": 0.9}, buckets=buckets).first()
    assert (got.p50, got.p90, got.min_ms, got.max_ms) == (sorted(ends)[2], sorted(ends)[5], min(ends), max(ends))


def test_percentiles_leave_no_rows_to_one_task(spark):
    rows = spark.range(0, 200_000, 1, 8).select(F.rand(7).alias("v"))
    got = metrics.floor_rank_percentiles(rows, "v", {"p50": 0.5}).first()
    values = sorted(row.v for row in rows.collect())
    assert got.p50 == values[99_999] and got.n == 200_000
