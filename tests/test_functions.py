from decimal import Decimal

from pyspark.sql import functions as F

from rillmark import functions as fn


def one(spark, **columns):
    row = spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()
    return row.asDict()


def test_time(spark):
    ms = F.lit(1_704_067_259_999).cast("long")
    got = one(spark, minute=fn.minute_floor(ms).cast("string"), text=fn.timestamp_text(ms),
              floor=fn.floor_ms(F.lit(-1).cast("long"), 1000), day=fn.utc_date(F.lit(-1).cast("long")).cast("string"))
    assert got == {"minute": "2024-01-01 00:00:00", "text": "2024-01-01 00:00:59.999", "floor": -1000,
                   "day": "1969-12-31"}


def test_clock_seconds_ignore_the_fraction(spark):
    got = one(spark, s=fn.clock_seconds_between(F.lit(10_900).cast("long"), F.lit(86_410_100).cast("long")))
    assert got["s"] == 86_400


def test_number_or_zero(spark):
    rows = [("10.005",), ("x",), (None,), ("",), ("1e2",), (" 2",), ("1.5d",), ("-3",)]
    df = spark.createDataFrame(rows, "t string").select(fn.number_or_zero(F.col("t")).alias("v"))
    assert [r.v for r in df.collect()] == [Decimal(v) for v in ("10.005", "0", "0", "0", "100", "0", "0", "-3")]


def test_attribute_and_price(spark):
    df = spark.createDataFrame([({"category": "toys", "price": "2.50"},), ({},), (None,)], "a map<string,string>")
    got = df.select(fn.attribute(F.col("a"), "category").alias("c"), fn.price_of(F.col("a")).alias("p")).collect()
    assert [(r.c, float(r.p)) for r in got] == [("toys", 2.5), ("", 0.0), ("", 0.0)]


def test_text(spark):
    got = one(spark, a=fn.padded_id("evt-", F.lit(42), 8), b=fn.padded_id("e", F.lit(12345), 3),
              c=fn.id_with_amount(F.lit("e1"), F.lit("2.5").cast("decimal(10,3)")))
    assert got == {"a": "evt-00000042", "b": "e12345", "c": "e1|2.50"}
    split = one(spark, a=fn.split_once(F.lit("a|b|c"), 0), b=fn.split_once(F.lit("a|b|c"), 1))
    assert split == {"a": "a", "b": "b|c"}


def test_numbers(spark):
    got = one(spark, a=fn.at_least_zero(F.lit(-4)), b=fn.ratio(F.lit(1), F.lit(3)), c=fn.ratio(F.lit(1), F.lit(0)))
    assert got == {"a": 0, "b": 0.333333, "c": None}
