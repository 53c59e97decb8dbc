import random
from contextlib import contextmanager

import pytest
from helpers import DAY, column, holds, members, pairs, random_events, storefront

from rillmark.operators import definitions as d
from rillmark.operators import segments, timeline
from rillmark.operators.definitions import Segment, segment_definitions, standard_segments
from rillmark.operators.reconcile import diff_sets, diff_totals
from rillmark.session import dealt_by_rows
from rillmark.sinks.logs import merged_upto
from rillmark.sinks.membership import compact_membership, read_membership, write_membership
from rillmark.streaming import segments as streaming_segments
from rillmark.streaming.segments import (
    compact_segments, current_segments, finalize_segments, fold_batch, incremental_segments,
)
from rillmark.sources import parquet_topic, read_topic_stream
from rillmark.streaming.running import finish

NOW = 1_706_000_000_000


def test_fifty_unique_definitions(spark):
    chosen = standard_segments()
    assert len(chosen) == len({s.id for s in chosen}) == 50
    families = [s.family for s in chosen]
    assert [families.count(f) for f in (d.PURCHASE_COUNT, d.CART_ABANDON, d.CATEGORY_VIEWS, d.PURCHASE_VALUE,
                                        d.RECENTLY_ACTIVE, d.NEVER_PURCHASED, d.CHURN_RISK, d.MULTI_CATEGORY)
            ] == [12, 5, 16, 6, 4, 1, 3, 3]
    row = segment_definitions(spark).where("id = 'purchase_value_min_250_90d'").first()
    assert (row.family, row.min_value, row.window_days, row.category) == ("purchase_value_min", 250.0, 90, "")


def test_unknown_family_is_refused(spark):
    with pytest.raises(ValueError):
        segments.evaluate_segments(storefront(spark, []), [Segment("x", "no_such_family")], NOW)


def test_cart_abandon_uses_whole_second_clocks(spark):
    events = storefront(spark, [("e1", "p1", "add_to_cart", 10_900, {}), ("e2", "p2", "page_view", 10_900, {})])
    assert column(segments.segment_cart_abandon(events, DAY + 10_100, 1), "profile_id") == ["p1"]
    assert column(segments.segment_cart_abandon(events, DAY + 9_999, 1), "profile_id") == []


def test_window_start_is_inclusive_to_the_millisecond(spark):
    rows = [("e1", "p1", "purchase", NOW - 7 * DAY, {}), ("e2", "p2", "purchase", NOW - 90 * DAY, {}),
            ("e3", "p3", "purchase", NOW - 7 * DAY - 1, {}), ("e4", "p4", "purchase", NOW - 90 * DAY - 1, {})]
    events = storefront(spark, rows)
    assert column(segments.segment_purchase_count(events, NOW, 1, 7), "profile_id") == ["p1"]
    assert column(segments.segment_purchase_count(events, NOW, 1, 90), "profile_id") == ["p1", "p2", "p3"]


def test_prices_that_are_no_numbers_count_zero(spark):
    events = storefront(spark, [
        ("e1", "p1", "purchase", NOW, {"price": "x"}), ("e2", "p1", "purchase", NOW, {}),
        ("e3", "p1", "purchase", NOW, {"price": "10.005"})])
    assert column(segments.segment_purchase_value(events, NOW, 10.005, 30), "profile_id") == ["p1"]
    assert column(segments.segment_purchase_value(events, NOW, 10.006, 30), "profile_id") == []


def test_last_times_do_not_depend_on_arrival(spark):
    events = storefront(spark, [("e2", "p1", "add_to_cart", NOW - DAY, {}), ("e1", "p1", "purchase", NOW - 2 * DAY, {})])
    assert column(segments.segment_cart_abandon(events, NOW, 1), "profile_id") == ["p1"]


def test_later_events_are_left_out(spark):
    events = storefront(spark, [("e1", "p1", "page_view", NOW, {}), ("e2", "p1", "purchase", NOW + 1, {})])
    assert column(segments.segment_never_purchased(events, NOW), "profile_id") == ["p1"]
    assert ("never_purchased", "p1") in pairs(segments.evaluate_segments(events, standard_segments(), NOW))


def test_a_view_without_category_counts_unless_ignored(spark):
    events = storefront(spark, [("e1", "p1", "page_view", NOW, {}), ("e2", "p1", "page_view", NOW, {"category": "toys"})])
    assert column(segments.segment_multi_category(events, NOW, 2), "profile_id") == ["p1"]
    assert column(segments.segment_multi_category(events, NOW, 2, ignore_missing=True), "profile_id") == []
    two = [s for s in standard_segments() if s.id == "multi_category_shopper_min_2"]
    assert pairs(segments.evaluate_segments(events, two, NOW)) == {("multi_category_shopper_min_2", "p1")}
    assert pairs(segments.evaluate_segments(events, two, NOW, ignore_missing=True)) == set()


def test_category_names_are_taken_literally(spark):
    name = "it's a \\ test"
    events = storefront(spark, [("e1", "p1", "page_view", NOW, {"category": name})])
    chosen = [Segment("own's", d.CATEGORY_VIEWS, min_count=1, category=name)]
    assert pairs(segments.evaluate_segments(events, chosen, NOW)) == {("own's", "p1")}


def families(events, now):
    return {
        **{s.id: segments.segment_purchase_count(events, now, s.min_count, s.window_days)
           for s in standard_segments() if s.family == d.PURCHASE_COUNT and s.min_count == 2},
        "purchase_value_min_250_90d": segments.segment_purchase_value(events, now, 250.0, 90),
        "cart_abandon_7d": segments.segment_cart_abandon(events, now, 7),
        "category_view_min_toys_3": segments.segment_category_views(events, now, "toys", 3),
        "recently_active_72h": segments.segment_recently_active(events, now, 72),
        "never_purchased": segments.segment_never_purchased(events, now),
        "churn_risk_14d": segments.segment_churn_risk(events, now, 14),
        "multi_category_shopper_min_3": segments.segment_multi_category(events, now, 3),
    }


@pytest.mark.parametrize("seed", range(3))
def test_all_definitions_like_a_loop(spark, seed):
    rows = random_events(seed)
    now = max(r[3] for r in rows) - random.Random(seed).randrange(20) * DAY
    events = storefront(spark, rows)
    want = members(standard_segments(), rows, now)
    assert pairs(segments.evaluate_segments(events, standard_segments(), now)) == want
    for segment_id, result in families(events, now).items():
        assert {(segment_id, p) for p in column(result, "profile_id")} == {w for w in want if w[0] == segment_id}


def test_sizes_members_and_deltas(spark):
    rows = random_events(4)
    now = max(r[3] for r in rows)
    events = storefront(spark, rows)
    before = segments.evaluate_segments(events, standard_segments(), now - 7 * DAY)
    after = segments.evaluate_segments(events, standard_segments(), now)
    want_before, want = members(standard_segments(), rows, now - 7 * DAY), members(standard_segments(), rows, now)
    sizes = {r.segment_id: r.n for r in segments.segment_sizes(after, segment_definitions(spark)).collect()}
    assert len(sizes) == 50 and sizes == {s.id: sum(w[0] == s.id for w in want) for s in standard_segments()}
    assert set(column(segments.members_of(after, "never_purchased"), "profile_id")) == {
        p for s, p in want if s == "never_purchased"}
    for row in segments.profile_segments(after).collect():
        assert row.segments == sorted(s for s, p in want if p == row.profile_id)
    delta = segments.membership_delta(before, after)
    changes = {(r.segment_id, r.profile_id): r.change for r in delta.collect()}
    assert {k for k, v in changes.items() if v == "added"} == want - want_before
    assert {k for k, v in changes.items() if v == "removed"} == want_before - want
    assert pairs(segments.apply_delta(before, delta)) == want
    assert pairs(segments.apply_delta(after, delta)) == want


def test_rolling_purchases_like_a_loop(spark):
    rows = random_events(6)
    bought = [r for r in rows if r[2] == "purchase"]
    got = timeline.rolling_purchases(storefront(spark, rows), (7, 30), stretch_ms=DAY * 5).collect()
    assert len(got) == len(bought)
    by_id = {r.event_id: r for r in got}
    for event in bought:
        for days in (7, 30):
            window = [e for e in bought if e[1] == event[1] and event[3] - days * DAY <= e[3] <= event[3]]
            row = by_id[event[0]]
            assert row[f"n_{days}d"] == len(window)
            spend = sum(float(e[4].get("price", "0")) if e[4].get("price") != "x" else 0 for e in window)
            assert abs(float(row[f"value_{days}d"]) - spend) < 1e-6


def test_membership_timeline_like_a_loop(spark):
    rows = random_events(7, profiles=5, events=150)
    chosen = standard_segments()
    want = []
    for profile in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == profile]
        for segment in chosen:
            was = False
            for now in sorted({r[3] for r in own}):
                member = holds(segment, own, now)
                if member != was:
                    first = min(r[0] for r in own if r[3] == now)
                    want.append((profile, first, segment.id, "enter" if member else "exit"))
                was = member
    for stretch in (DAY * 3, DAY * 1000):
        got = timeline.membership_timeline(storefront(spark, rows), chosen, stretch)
        assert sorted((r.profile_id, r.event_id, r.segment_id, r.change) for r in got.collect()) == sorted(want)


def test_profile_timeline(spark):
    rows = random_events(8)
    got = {r.event_id: r.position for r in timeline.profile_timeline(storefront(spark, rows), DAY).collect()}
    for profile in {r[1] for r in rows}:
        own = sorted((r[3], r[0]) for r in rows if r[1] == profile)
        assert [got[e] for _, e in own] == list(range(1, len(own) + 1))


def test_incremental_equals_full_with_late_events_retries_and_compaction(spark, path):
    rows = random_events(9)
    random.Random(1).shuffle(rows)
    chosen, now = standard_segments(), max(r[3] for r in rows)
    parts = [rows[i::4] for i in range(4)]
    for batch_id, part in enumerate(parts):
        fold_batch(spark, storefront(spark, part), batch_id, chosen, path, shards=3)
        if batch_id == 1:
            fold_batch(spark, storefront(spark, part), batch_id, chosen, path, shards=3)
            compact_segments(spark, path, chosen)
            compact_membership(spark, f"{path}/membership")
    assert merged_upto(spark, f"{path}/facts") == 1
    with pytest.raises(ValueError):
        fold_batch(spark, storefront(spark, rows), 9, chosen, path, shards=5)
    fold_batch(spark, storefront(spark, []), 4, chosen, path, shards=3)
    assert pairs(finalize_segments(spark, path, chosen)) == members(chosen, rows, now)
    assert pairs(current_segments(spark, path)) == members(chosen, rows, now)
    later = now + 40 * DAY
    assert pairs(finalize_segments(spark, path, chosen, later)) == members(chosen, rows, later)
    full = segments.evaluate_segments(storefront(spark, rows), chosen, later)
    totals = diff_totals(diff_sets(current_segments(spark, path), full, "segment_id", "profile_id",
                                   segment_definitions(spark).selectExpr("id AS segment_id"))).first()
    assert totals.asDict() == {"groups_n": 50, "exact_n": 50, "mismatched_n": 0}
    with pytest.raises(ValueError):
        finalize_segments(spark, path, chosen, now - 1)


def test_each_batch_decides_the_profiles_it_touches(spark, path):
    chosen = [s for s in standard_segments() if s.id in ("never_purchased", "recently_active_1h")]
    fold_batch(spark, storefront(spark, [("e1", "p1", "page_view", NOW, {}), ("e2", "p2", "page_view", NOW, {})]),
               0, chosen, path, shards=3)
    fold_batch(spark, storefront(spark, [("e3", "p1", "purchase", NOW + DAY, {})]), 1, chosen, path, shards=3)
    assert pairs(current_segments(spark, path)) == {
        ("recently_active_1h", "p1"), ("never_purchased", "p2"), ("recently_active_1h", "p2")}
    assert pairs(finalize_segments(spark, path, chosen)) == {("recently_active_1h", "p1"), ("never_purchased", "p2")}


def test_incremental_stream(spark, path):
    rows, chosen = random_events(10, events=120), standard_segments()
    events = storefront(spark, rows)
    events.repartition(2).write.parquet(f"{path}/in")
    stream = read_topic_stream(spark, parquet_topic(f"{path}/in", events.schema, maxFilesPerTrigger="1"))
    finish(incremental_segments(stream, chosen, f"{path}/state", f"{path}/check", shards=2))
    assert pairs(finalize_segments(spark, f"{path}/state", chosen)) == members(chosen, rows, max(r[3] for r in rows))


def test_membership_store(spark, path):
    def change(batch_id, *rows):
        write_membership(spark.createDataFrame(list(rows), "segment_id string, profile_id string, change string"),
                         path, batch_id, shards=2)

    change(0, ("s", "p1", "added"), ("s", "p2", "added"))
    change(1, ("s", "p1", "removed"), ("t", "p1", "added"))
    change(1, ("s", "p1", "removed"), ("t", "p1", "added"))
    want = {("s", "p2"), ("t", "p1")}
    assert pairs(read_membership(spark, path)) == want
    assert pairs(read_membership(spark, path, before=1)) == {("s", "p1"), ("s", "p2")}
    assert compact_membership(spark, path) == 1
    assert pairs(read_membership(spark, path)) == want
    change(2, ("t", "p1", "removed"))
    assert pairs(read_membership(spark, path)) == {("s", "p2")}
    assert set.union(*[pairs(read_membership(spark, path, shards=[k])) for k in range(2)]) == {("s", "p2")}
    pruned = read_membership(spark, path, shards=[1])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [shard" in pruned or "PartitionFilters: [isnotnull(shard" in pruned


def test_shuffles_of_the_logs_are_dealt_by_rows(spark, path, monkeypatch):
    seen, key = [], "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)

    @contextmanager
    def dealt(session, rows):
        with dealt_by_rows(session, rows, most=20):
            seen.append((rows, int(session.conf.get(key))))
            yield

    monkeypatch.setattr(streaming_segments, "dealt_by_rows", dealt)
    rows = [(f"e{n}", f"p{n % 40}", "purchase" if n % 3 else "page_view", NOW - n * DAY // 7, {"price": str(n), "category": "books"})
            for n in range(300)]
    rows += [("n1", None, "purchase", NOW, {"price": "9"})]
    for batch_id, part in enumerate([rows[:150], rows[150:]]):
        fold_batch(spark, storefront(spark, part), batch_id, standard_segments(), path)
    compact_segments(spark, path, standard_segments())
    got = finalize_segments(spark, path, standard_segments(), NOW)
    assert len(seen) == 4 and seen[0][0] >= 150 and all(tasks == max(int(before), -(-count // 20)) for count, tasks in seen)
    assert seen[1][1] > seen[0][1] > int(before) == int(spark.conf.get(key))
    full = segments.evaluate_segments(storefront(spark, rows[:-1]), standard_segments(), NOW)
    assert pairs(got.where("profile_id is not null")) == pairs(full)
    dealt_out = read_membership(spark, f"{path}/membership", tasks=7)
    assert dealt_out.rdd.getNumPartitions() == 7 and sorted(map(str, dealt_out.collect())) == sorted(map(str, got.collect()))
