from rillmark.sinks.keyed import assign_partition, read_keyed, write_keyed
from rillmark.sinks.logs import append_batch, compact_log, read_log
from rillmark.sinks.membership import read_membership, write_membership
from rillmark.sinks.rows import json_body, to_json_rows
from rillmark.sinks.tables import ensure_table, event_store_rows, truncate_table

__all__ = ["assign_partition", "read_keyed", "write_keyed", "append_batch", "compact_log", "read_log",
           "read_membership", "write_membership", "json_body", "to_json_rows", "ensure_table",
           "event_store_rows", "truncate_table"]
