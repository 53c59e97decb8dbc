import random

import pytest
from helpers import column, readings
from pyspark.sql import functions as F

from rillmark.operators import bounded, dedup
from rillmark.operators.bounded import Memory
from rillmark.sources import parquet_topic, read_topic_stream
from rillmark.streaming.dedup import dedup_bounded_stream, dedup_sharded_stream, dedup_stream
from rillmark.streaming.running import append_files, finish, rocksdb_state

ORDER = ["arrival"]


def arrivals(spark, rows):
    return spark.createDataFrame([(d, s, i) for i, (d, s) in enumerate(rows)], "device string, seq long, arrival long")


def random_arrivals(seed, ids=60, rows=1500):
    rng = random.Random(seed)
    return [("hot" if rng.random() < 0.5 else f"d{rng.randrange(4)}", rng.randrange(ids)) for _ in range(rows)]


def test_verdicts_accept_lower_unseen_sequences(spark):
    rows = arrivals(spark, [("d1", 5), ("d1", 5), ("d1", 3), ("d2", 5)])
    got = dedup.dedup_verdict(rows, ["device", "seq"], ORDER).orderBy("arrival").collect()
    assert [r.accepted for r in got] == [True, False, True, True]


def test_five_copies_are_accepted_once(spark):
    rows = arrivals(spark, [("d1", 7)] * 5)
    assert dedup.dedup_counts(rows, ["device", "seq"]).first().asDict() == {"accepted": 1, "rejected": 4}
    assert dedup.dedup(rows, ["device", "seq"]).count() == 1


def test_counts_of_nothing(spark):
    rows = arrivals(spark, [("d", 1)]).where("false")
    assert dedup.dedup_counts(rows, ["device", "seq"]).first().asDict() == {"accepted": 0, "rejected": 0}
    assert dedup.duplicate_stats(rows, ["device", "seq"]).first().dup_fraction is None


@pytest.mark.parametrize("seed", range(3))
def test_first_wins_like_a_loop(spark, seed):
    delivered = random_arrivals(seed)
    seen, want = set(), []
    for place, key in enumerate(delivered):
        if key not in seen:
            seen.add(key)
            want.append(place)
    rows = arrivals(spark, delivered)
    assert column(dedup.dedup_first(rows, ["device", "seq"], ORDER), "arrival") == want
    verdicts = dedup.dedup_verdict(rows, ["device", "seq"], ORDER)
    assert column(verdicts.where("accepted"), "arrival") == want
    assert verdicts.count() == len(delivered)


def naive_bounded(delivered, cap):
    memories, want = {}, []
    for place, (device, seq) in enumerate(delivered):
        if memories.setdefault(device, Memory(cap)).admit(seq):
            want.append(place)
    return want


def test_memory_is_first_in_first_out():
    memory = Memory(4)
    assert all(memory.admit(i) for i in range(1, 6))
    assert memory.admit(1)
    assert not memory.admit(5)
    memory = Memory(2)
    assert [memory.admit(i) for i in (1, 2, 1, 3, 1)] == [True, True, False, True, True]


def test_forgotten_ids_are_admitted_again(spark):
    rows = arrivals(spark, [("d1", i) for i in (1, 2, 3, 4, 5, 1, 5)] + [("d2", 1)])
    got = bounded.dedup_bounded(rows, "device", "seq", ORDER, cap=4, stretches=3)
    assert column(got, "arrival") == [0, 1, 2, 3, 4, 5, 7]


@pytest.mark.parametrize("cap,stretches", [(3, 7), (16, 4), (50, 2), (4096, 5)])
def test_bounded_like_a_loop(spark, cap, stretches):
    delivered = random_arrivals(cap)
    got = bounded.dedup_bounded(arrivals(spark, delivered), "device", "seq", ORDER, cap, stretches)
    assert column(got, "arrival") == naive_bounded(delivered, cap)


def test_whole_cut_and_plain_groups_side_by_side(spark, monkeypatch):
    rng = random.Random(5)
    delivered = [(rng.choice(["hot", "hot", "hot", "d1", None, "few"]), rng.randrange(25)) for _ in range(900)]
    delivered = [(device, seq % 4 if device == "few" else None if seq == 24 else seq) for device, seq in delivered]
    rows = spark.createDataFrame([(d, s, n) for n, (d, s) in enumerate(delivered)], "device string, seq long, arrival long")
    want = naive_bounded(delivered, 6)
    for whole in (200, 0, 10_000):  # the hot group is cut, all that forget are, none is
        monkeypatch.setattr(bounded, "WHOLE", whole)
        assert column(bounded.dedup_bounded(rows, "device", "seq", ["arrival"], 6), "arrival") == want
    assert column(bounded.dedup_bounded(rows, "device", "seq", ["arrival"], 6, 5), "arrival") == want
    assert bounded.dedup_bounded(rows.limit(0), "device", "seq", ["arrival"], 6).count() == 0
    assert column(bounded.dedup_bounded(rows, None, "seq", ["arrival"], 6), "arrival") == naive_bounded([(0, s) for _, s in delivered], 6)


def test_sharded_is_exact_while_nothing_is_forgotten(spark):
    delivered = random_arrivals(11)
    got = bounded.dedup_sharded(arrivals(spark, delivered), "seq", ORDER, cap=1000, shards=4)
    assert column(got, "seq") == sorted({s for _, s in delivered})


def test_state_size_and_trace(spark):
    delivered = random_arrivals(5)
    rows, cap, every = arrivals(spark, delivered), 10, 100
    memories, trace, peak = {}, {}, 0
    for place, (device, seq) in enumerate(delivered):
        memories.setdefault(device, Memory(cap)).admit(seq)
        if (place + 1) % every == 0:
            trace[(place + 1) // every] = sum(len(m.held) for m in memories.values())
    peak = sum(len(m.held) for m in memories.values())
    size = dedup.state_size(rows, "device", "seq", cap).first()
    assert (size.entries, size.groups) == (peak, len(memories))
    got = dedup.state_trace(rows, "device", "seq", ORDER, cap, every)
    listed = {r["sample"]: r["entries"] for r in got.collect()}
    carried = 0
    for sample in sorted(trace):
        carried = listed.get(sample, carried)
        assert carried == trace[sample]
    result = dedup.state_peak(got, rows, "device", cap).first()
    assert (result.peak, result.bound, result.ok) == (peak, cap * len(memories), True)


def topic(spark, rows, path, order, files=4):
    """Files written one after the other, since a file stream reads the oldest first."""
    low, high = rows.agg(F.min(order), F.max(order)).first()
    part = F.least(F.floor((F.col(order) - low) * files / (high - low + 1)), F.lit(files - 1))
    for number in range(files):
        rows.where(part == number).coalesce(1).write.mode("append").parquet(path)
    return read_topic_stream(spark, parquet_topic(path, rows.schema, maxFilesPerTrigger="1"))


def test_stream_dedup_over_micro_batches(spark, path):
    delivered = [(f"d{i % 3}", i // 2 % 40, 1) for i in range(200)]
    rows = readings(spark, delivered)
    stream = dedup_stream(topic(spark, rows, f"{path}/in", "sequence"), ["device_id", "sequence"])
    finish(append_files(stream, f"{path}/out", f"{path}/check"))
    got = spark.read.parquet(f"{path}/out")
    assert got.count() == len({d[:2] for d in delivered})


def test_bounded_stream_like_a_loop(spark, path):
    delivered = random_arrivals(9, rows=600)
    rows = arrivals(spark, delivered)
    with rocksdb_state(spark):
        stream = dedup_bounded_stream(topic(spark, rows, f"{path}/in", "arrival", 3), "device", "seq", ORDER, cap=12)
        finish(append_files(stream, f"{path}/out", f"{path}/check"))
    assert column(spark.read.parquet(f"{path}/out"), "arrival") == naive_bounded(delivered, 12)


def test_sharded_stream(spark, path):
    delivered = random_arrivals(10, rows=300)
    rows = arrivals(spark, delivered)
    with rocksdb_state(spark):
        stream = dedup_sharded_stream(topic(spark, rows, f"{path}/in", "arrival", 2), "seq", ORDER, 1000, 3)
        finish(append_files(stream, f"{path}/out", f"{path}/check"))
    assert column(spark.read.parquet(f"{path}/out"), "seq") == sorted({s for _, s in delivered})
