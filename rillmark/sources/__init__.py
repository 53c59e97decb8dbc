from rillmark.sources.decode import decode_records, parse_webhooks, reject_undecodable
from rillmark.sources.topics import kafka_topic, merge_topics, parquet_topic, read_topic_snapshot, read_topic_stream

__all__ = ["decode_records", "parse_webhooks", "reject_undecodable", "kafka_topic", "merge_topics", "parquet_topic",
           "read_topic_snapshot", "read_topic_stream"]
