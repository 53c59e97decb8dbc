"""Payload decoding.  Bad records are set aside and never stop a stream.

The functions are projections and filters, so the same code serves batch and
streaming frames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillmark.schemas import DELIVERY_WEBHOOK

_CORRUPT = "_corrupt"


def _parsed(df: DataFrame, payload: str, schema: T.StructType) -> DataFrame:
    """Add ``_record``.  Exploding a one-element array keeps the optimizer from pushing
    the parse into every use of a field, so each payload is parsed once."""
    with_corrupt = T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    record = F.from_json(F.col(payload).cast("string"), with_corrupt, options)
    return df.select("*", F.explode(F.array(record)).alias("_record"))


def _is_bad() -> Column:
    return F.col("_record").isNull() | F.col(f"_record.{_CORRUPT}").isNotNull()


def _defaulted(schema: T.StructType) -> list[Column]:
    """Fields of ``_record``; an absent one has its protobuf default: '', 0, false or an empty map or list."""
    def default(kind: T.DataType) -> Column | None:
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.lit("").cast(kind)
        if isinstance(kind, T.NumericType):
            return F.lit(0).cast(kind)
        if isinstance(kind, T.BooleanType):
            return F.lit(False)
        if isinstance(kind, T.MapType):
            return F.create_map().cast(kind)
        return F.array().cast(kind) if isinstance(kind, T.ArrayType) else None

    fields = [(F.col(f"_record.{field.name}"), default(field.dataType), field.name) for field in schema.fields]
    return [(value if other is None else F.coalesce(value, other)).alias(name) for value, other, name in fields]


def decode_records(df: DataFrame, payload: str, schema: T.StructType, format: str = "json",
                   keep: tuple[str, ...] = (), message: str | None = None, descriptor: str | None = None) -> DataFrame:
    """Decoded records plus the columns in ``keep``; undecodable payloads are skipped, absent fields have their default.

    ``format="protobuf"`` takes the message name and a descriptor file and needs
    the protobuf package on the classpath.
    """
    if format == "json":
        good = _parsed(df, payload, schema).where(~_is_bad())
        return good.select(*keep, *_defaulted(schema))
    if format == "protobuf":
        from pyspark.sql.protobuf.functions import from_protobuf
        record = from_protobuf(F.col(payload), message, descriptor, {"mode": "PERMISSIVE"})
        good = df.withColumn("_record", record).where(F.col("_record").isNotNull())
        return good.select(*keep, *_defaulted(schema))
    raise ValueError(f"unknown payload format {format!r}")


def reject_undecodable(df: DataFrame, payload: str, schema: T.StructType) -> DataFrame:
    """The rows ``decode_records`` skips, unchanged."""
    return _parsed(df, payload, schema).where(_is_bad()).select(*df.columns)


def _webhook_reason(body: Column, max_body_bytes: int | None) -> Column:
    blank = lambda name: F.coalesce(F.col(f"_record.{name}"), F.lit("")) == ""
    too_long = F.lit(False) if max_body_bytes is None else F.octet_length(body) > max_body_bytes
    return (F.when(too_long | _is_bad(), "invalid json")
            .when(blank("webhook_id") | blank("channel"), "webhook_id and channel are required"))


def _judged(df: DataFrame, body: str, max_body_bytes: int | None) -> DataFrame:
    return _parsed(df, body, DELIVERY_WEBHOOK).withColumn("reason", _webhook_reason(F.col(body), max_body_bytes))


def parse_webhooks(df: DataFrame, now_ms: int, body: str = "body", max_body_bytes: int | None = None) -> DataFrame:
    """Webhook bodies as typed rows; a missing or zero time becomes ``now_ms``.

    Bodies over ``max_body_bytes`` count as invalid; by default there is no limit.

    Invalid bodies and those without id or channel are left out, see ``rejected_webhooks``.
    """
    text = lambda name: F.coalesce(F.col(f"_record.{name}"), F.lit("")).alias(name)
    time = F.coalesce(F.nullif(F.col("_record.timestamp_ms"), F.lit(0)), F.lit(now_ms)).cast("long")
    return _judged(df, body, max_body_bytes).where(F.col("reason").isNull()).select(
        text("webhook_id"), text("message_id"), text("channel"), text("status"), text("provider"),
        time.alias("timestamp_ms"))


def rejected_webhooks(df: DataFrame, body: str = "body", max_body_bytes: int | None = None) -> DataFrame:
    return _judged(df, body, max_body_bytes).where(F.col("reason").isNotNull()).select(*df.columns, "reason")
