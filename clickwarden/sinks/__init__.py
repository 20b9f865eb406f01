from clickwarden.sinks.keyed import KeyedBlocklist, keyed_sink, newly_flagged_sink
from clickwarden.sinks.messages import console_sink, kafka_sink, kafka_sink_options, write_json_events
from clickwarden.sinks.tables import (
    CASSANDRA, Sink, blocklist_sink, cassandra_options, cassandra_sink, changes_sink, compact_blocklist, merge_changes, parquet_sink,
    read_appended, read_blocklist, read_changes, read_snapshot, remove_expired, snapshot_sink, table_sink, table_writer)

__all__ = ["KeyedBlocklist", "keyed_sink", "newly_flagged_sink", "console_sink", "kafka_sink", "kafka_sink_options", "write_json_events", "Sink", "blocklist_sink",
           "cassandra_options", "cassandra_sink", "changes_sink", "compact_blocklist", "merge_changes", "parquet_sink", "read_appended",
           "read_blocklist", "read_changes", "remove_expired",
           "read_snapshot", "snapshot_sink", "table_sink", "table_writer", "CASSANDRA"]
