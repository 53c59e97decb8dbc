"""Record views derived from the ``events`` table, for queries, tests and bench.

Each view is a projection of ``events`` over the whole table; columns nobody
asks for are pruned at the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillmark.operators.definitions import CATEGORIES

JANUARY_END_MS = 1_706_745_600_000
JANUARY_START_MS = 1_704_067_200_000


EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet")


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return project_base(events(spark, sf_dir))


def project_base(rows: DataFrame) -> DataFrame:
    """Add the number in ``props`` as ``k`` and the event time as ``ms``."""
    return rows.select(
        F.col("event_id").alias("n"), "user_id", "event_type", "value", "props",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"),
    )


def readings(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.concat(F.lit("dev-"), F.lpad(F.col("user_id").cast("string"), 5, "0")).alias("device_id"),
        F.col("n").alias("sequence"), F.col("ms").alias("timestamp_ms"), "value", "n",
    )


def _pick(number: Column, names: list[str]) -> Column:
    """``names[number % len(names)]``."""
    return F.element_at(F.array(*[F.lit(name) for name in names]), (number % len(names) + 1).cast("int"))


def storefront(rows: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    by_number = _pick(F.col("k"), list(CATEGORIES))
    category = (F.when(F.col("k") == 99, F.lit(None).cast("string"))
                .when(F.col("k") < 30, F.lit("electronics")).otherwise(by_number))
    price = F.when(kind.isin("click", "purchase"),
                   (F.col("value").cast("decimal(18,2)") * 3).cast("decimal(18,2)"))
    shopper = F.col("user_id") * 7 + F.least(F.col("n") % 13, F.lit(6))
    return rows.select(
        F.concat(F.lit("evt-"), F.lpad(F.col("n").cast("string"), 8, "0")).alias("event_id"),
        F.concat(F.lit("profile-"), F.lpad(shopper.cast("string"), 8, "0")).alias("profile_id"),
        F.when(kind.isin("view", "signup"), "page_view").when(kind == "click", "add_to_cart")
         .when(kind == "purchase", "purchase").otherwise("cart_abandon").alias("event_type"),
        (F.lit(JANUARY_END_MS) - (F.lit(JANUARY_END_MS) - F.col("ms")) * 4).alias("timestamp_ms"),
        F.create_map(F.lit("category"), category, F.lit("price"), price.cast("string")).alias("attributes"),
        "n",
    )


def webhooks(rows: DataFrame) -> DataFrame:
    message = F.call_function("div", F.col("n"), F.lit(2).cast("long"))
    spread = F.call_function("div", F.col("ms") - F.lit(JANUARY_START_MS), F.lit(60).cast("long"))
    return rows.select(
        F.concat(F.lit("wh-"), F.lpad(F.col("n").cast("string"), 9, "0")).alias("webhook_id"),
        F.concat(F.lit("msg-"), F.lpad(message.cast("string"), 9, "0")).alias("message_id"),
        _pick(message, ["mail", "text", "push"]).alias("channel"),
        F.when(F.col("n") % 2 == 0, "sent").when(F.col("k") < 90, "delivered")
         .when(F.col("k") < 97, "bounced").otherwise("failed").alias("status"),
        (F.lit(JANUARY_START_MS) + spread).alias("timestamp_ms"),
        _pick(message, ["north", "south", "west"]).alias("provider"),
        "n",
    )


def delivered(view: DataFrame) -> DataFrame:
    """The view as an at-least-once source hands it over: repeated and shuffled.

    Every 20th record comes twice.  The copies are made in place from each row,
    so no join is needed; order by ``(arrival, copy, n)``.
    """
    copies = F.when(F.col("n") % 20 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    repeated = view.withColumn("copy", F.explode(copies))
    return repeated.withColumn("arrival", (F.col("n") * 7919 + F.col("copy") * 104729) % 1000003)


ARRIVAL_ORDER = ["arrival", "copy", "n"]
