from clickwarden.sources.files import events_from_json_lines, read_json_events, read_spool_events, stream_table
from clickwarden.sources.kafka import kafka_source_options, read_kafka_events

__all__ = ["events_from_json_lines", "read_json_events", "read_spool_events", "stream_table",
           "kafka_source_options", "read_kafka_events"]
