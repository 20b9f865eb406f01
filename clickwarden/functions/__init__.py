from clickwarden.functions.events import (
    EVENT_COLUMNS, EVENT_SCHEMA, events_from_table, filter_actions, ip_from_id, json_field, parse_events,
    rejected_events, rejected_rows, tag_events, to_json_lines, to_kafka_value, typed_events)
from clickwarden.functions.times import (
    event_window, instant_to_wall_clock, seconds_to_instant, wall_clock_to_instant)

__all__ = [
    "EVENT_COLUMNS", "EVENT_SCHEMA", "events_from_table", "filter_actions", "ip_from_id", "json_field", "parse_events",
    "rejected_events", "rejected_rows", "tag_events", "to_json_lines", "to_kafka_value", "typed_events",
    "event_window", "instant_to_wall_clock", "seconds_to_instant", "wall_clock_to_instant",
]
