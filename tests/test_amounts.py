"""Amounts too wide and too fine for one decimal, against Python's exact decimals."""

import random
from decimal import Decimal, localcontext

from helpers import DAY, pairs, storefront
from pyspark.sql import functions as F

from rillmark.functions.amounts import LARGEST, PARTS, at_least, with_amount
from rillmark.functions.attributes import number_or_zero
from rillmark.operators import definitions as d
from rillmark.operators.definitions import Segment
from rillmark.operators.segments import evaluate_segments, segment_purchase_value
from rillmark.operators.timeline import membership_timeline, rolling_purchases
from rillmark.streaming.segments import current_segments, fold_batch

NOW = 1_706_000_000_000
TEXTS = ["1e25", "-1e25", "5.0000004", "0.00000000000000000001", "-0.99999999999999999999", "999999999999999999.5",
         "1234567890123456789.25", "9" * 26, "19.999999", "0.1234567", "7.5000000", "3", "-7.125", "1e-3", ".5", "12."]


def exact(text: str) -> int:
    with localcontext() as context:
        context.prec = 80
        return int(Decimal(text) * PARTS)


def test_parts_are_exact(spark):
    df = spark.createDataFrame([(n, t) for n, t in enumerate(TEXTS)], "n int, t string")
    for row in with_amount(df, F.col("t"), "u", "p").collect():
        assert exact(str(row.u)) + int(row.p or 0) == exact(TEXTS[row.n])


def test_no_numbers_and_numbers_beyond_the_range(spark):
    texts = [None, "", "x", " 5", "1e26", "-1e400", "1e-400"]
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, t string")
    got = [(int(r.u), int(r.p or 0)) for r in with_amount(df, F.col("t"), "u", "p").orderBy("n").collect()]
    assert got == [(0, 0)] * 4 + [(LARGEST, 0), (-LARGEST, 0), (0, 0)]


def test_one_number(spark):
    texts = ["1e25", "5.0000004", "1e40", "-1e40", "x"]
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, t string")
    got = [r.v for r in df.select("n", number_or_zero(F.col("t")).alias("v")).orderBy("n").collect()]
    assert got == [Decimal("1e25"), Decimal("5.0000004"), Decimal(10 ** 28 - 1), Decimal(1 - 10 ** 28), 0]


def test_sums_in_any_order_meet_thresholds_exactly(spark):
    random.seed(3)
    groups = {g: random.choices(TEXTS, k=random.randint(1, 40)) for g in range(60)}
    # Cancels to a hair below and a hair above the threshold.
    groups[60] = ["1e25", "-1e25", "99.99999999999999999999"]
    groups[61] = ["-1e25", "100", "1e25"]
    groups[62] = ["101", "-0.99999999999999999999", "-0.00000000000000000001"]
    rows = [(g, t) for g, ts in groups.items() for t in ts]
    random.shuffle(rows)
    sums = with_amount(spark.createDataFrame(rows, "g int, t string").repartition(7), F.col("t")).groupBy("g").agg(
        F.sum("_amount").alias("u"), F.sum("_fine").alias("p"))
    for value in (100.0, 0.1, 0.0, -3.5):
        want = {g for g, ts in groups.items() if sum(map(exact, ts)) >= exact(repr(value))}
        assert {r.g for r in sums.where(at_least("u", "p", value)).collect()} == want
    assert {60, 61, 62} & {r.g for r in sums.where(at_least("u", "p", 100.0)).collect()} == {61, 62}


def test_every_form_of_the_segment_agrees(spark, path):
    prices = {"below": ["1e25", "-1e25", "99.99999999999999999999"], "at": ["-1e25", "100", "1e25"],
              "fine": ["99.9999996", "0.0000004"], "wide": ["1e25"]}
    rows = [(f"{p}{n}", p, "purchase", NOW - DAY + n, {"price": t}) for p, ts in prices.items() for n, t in enumerate(ts)]
    rows.append(("view", "no purchase", "page_view", NOW - DAY, {}))
    events = storefront(spark, rows)
    chosen = [Segment("rich", d.PURCHASE_VALUE, min_value=100.0, window_days=30)]
    want = {"at", "fine", "wide"}
    assert {r.profile_id for r in segment_purchase_value(events, NOW, 100.0, 30).collect()} == want
    assert pairs(evaluate_segments(events, chosen, NOW)) == {("rich", p) for p in want}
    for number in range(3):
        batch = [row for n, row in enumerate(rows) if n % 3 == number]
        fold_batch(spark, storefront(spark, batch), number, chosen, path, shards=2)
    assert pairs(current_segments(spark, path)) == {("rich", p) for p in want}
    last = {}
    for row in membership_timeline(events, chosen).orderBy("timestamp_ms").collect():
        last[row.profile_id] = row.change
    assert {p for p, change in last.items() if change == "enter"} == want
    values = {r.event_id: r.value_30d for r in rolling_purchases(events).collect()}
    assert values["at2"] == 100 and values["fine1"] == Decimal("99.999999") and values["wide0"] == Decimal("1e25")
