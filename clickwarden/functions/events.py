"""The event model: reading raw lines into it, mapping tables onto it, writing it back out.

An event is one ad interaction: `ip`, `category_id`, `type` (click, view, ...) and `timestamp`.
Everything here works the same on batch and streaming frames.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from clickwarden.functions.times import as_instant, seconds_to_instant

# The fields of one JSON event. All are read as text, numbers included.
EVENT_SCHEMA = T.StructType([
    T.StructField("unix_time", T.StringType()),
    T.StructField("category_id", T.StringType()),
    T.StructField("ip", T.StringType()),
    T.StructField("type", T.StringType()),
])

EVENT_COLUMNS = ["ip", "category_id", "type", "timestamp"]


def tag_events(raw: DataFrame, value: str = "value", keep: Iterable[str] = ()) -> DataFrame:
    """Parse one JSON event per row (text or binary) and say why a row is unusable.

    Adds `reject_reason`: NULL for a good event, else `unreadable` (not one JSON object and nothing
    else, or none of the fields), `no_ip`, `no_time`, or `bad_time` (not whole epoch seconds of years 1
    to 9999). Never fails on bad input.

    The line is read as the one element of an array: a second object or other text behind the first
    makes it unreadable instead of being lost. The parse sits in a generator, because Catalyst would
    copy a plain `from_json` projection into every filter above it and parse each line several times.
    """
    text = F.col(value).cast("string")
    objects = F.from_json(F.concat(F.lit("["), text, F.lit("]")), T.ArrayType(EVENT_SCHEMA))
    parsed = raw.select(
        *keep, text.alias("value"),
        F.inline(F.transform(F.array(objects), lambda found: F.when(F.size(found) == 1, F.get(found, 0)))))
    return typed_events(parsed, keep=[*keep, "value"])


def typed_events(fields: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """From the four text fields to typed events with `reject_reason`."""
    nothing_read = F.coalesce("unix_time", "category_id", "ip", "type").isNull()
    timestamp = seconds_to_instant(F.col("unix_time"))
    reason = (
        F.when(nothing_read, "unreadable")
        .when(F.col("ip").isNull(), "no_ip")
        .when(F.col("unix_time").isNull(), "no_time")
        .when(timestamp.isNull(), "bad_time"))
    return fields.select(
        *keep, "ip", "category_id", "type", timestamp.alias("timestamp"), reason.alias("reject_reason"))


def parse_events(raw: DataFrame, value: str = "value", keep: Iterable[str] = ()) -> DataFrame:
    """The usable events among JSON rows; `keep` carries columns of the source along."""
    good = tag_events(raw, value, keep).filter(F.col("reject_reason").isNull())
    return good.select(*EVENT_COLUMNS, *keep)


def rejected_events(raw: DataFrame, value: str = "value", keep: Iterable[str] = ()) -> DataFrame:
    """The rows `parse_events` leaves out, as text, with the reason."""
    bad = tag_events(raw, value, keep).filter(F.col("reject_reason").isNotNull())
    return bad.select("value", "reject_reason", *keep)


def ip_from_id(number, subnet: str = "172.10") -> Column:
    """The address an account number stands for: `subnet`.{number div 255}.{number mod 255}; null for none."""
    number = F.col(number) if isinstance(number, str) else number
    return F.concat(F.lit(f"{subnet}."), F.call_function("div", number, F.lit(255)).cast("string"), F.lit("."),
                    (number % 255).cast("string"))


def json_field(text: str, name: str) -> Column:
    """The value of a top-level field of the JSON objects in column `text`, as text.

    Equal to `get_json_object`, which parses each row. An object that holds nothing but that field, with
    a plain whole number, is read by pattern first, at about a fifth of the cost.
    """
    number = F.regexp_extract(text, rf'^\{{"{name}": ?(0|-?[1-9][0-9]{{0,17}})\}}$', 1)
    return F.when(number != "", number).otherwise(F.get_json_object(text, f"$.{name}"))


def events_from_table(table: DataFrame, ip: Column | None = None, category_id: Column | None = None,
                      type: Column | None = None, timestamp: str = "ts") -> DataFrame:
    """Map a table onto the event model; defaults fit `events(ts, user_id, event_type, props)`.

    Rows without an ip or a time are left out, as among JSON events; `rejected_rows` has them. On a
    stream the time becomes an instant, as watermarks need; a batch keeps the table's type so that
    filters on it still reach the scan.
    """
    address = ip_from_id("user_id") if ip is None else ip
    when = as_instant(table, timestamp) if table.isStreaming else F.col(timestamp)
    return table.filter(address.isNotNull() & F.col(timestamp).isNotNull()).select(
        address.alias("ip"),
        (json_field("props", "k") if category_id is None else category_id).alias("category_id"),
        (F.col("event_type") if type is None else type).alias("type"),
        when.alias("timestamp"))


def rejected_rows(table: DataFrame, ip: Column | None = None, timestamp: str = "ts") -> DataFrame:
    """The table's rows that `events_from_table` leaves out, with the reason `no_ip` or `no_time`."""
    address = ip_from_id("user_id") if ip is None else ip
    reason = F.when(address.isNull(), "no_ip").when(F.col(timestamp).isNull(), "no_time")
    return table.withColumn("reject_reason", reason).filter(F.col("reject_reason").isNotNull())


def filter_actions(events: DataFrame, *actions: str) -> DataFrame:
    """Only the events of the given types."""
    return events.filter(F.col("type").isin(*actions))


def to_json_lines(events: DataFrame) -> DataFrame:
    """One JSON object per event, in the form `parse_events` reads, as column `value`."""
    fields = F.struct(
        F.unix_seconds(as_instant(events, "timestamp")).alias("unix_time"), "category_id", "ip", "type")
    return events.select(F.to_json(fields).alias("value"))


def to_kafka_value(df: DataFrame, key: str | None = "ip") -> DataFrame:
    """`key` and the whole row as JSON `value`: the columns a Kafka sink writes."""
    value = F.to_json(F.struct(*df.columns)).alias("value")
    return df.select(value) if key is None else df.select(F.col(key).cast("string").alias("key"), value)


__all__ = [
    "EVENT_SCHEMA", "EVENT_COLUMNS", "tag_events", "typed_events", "parse_events", "rejected_events",
    "ip_from_id", "json_field", "events_from_table", "rejected_rows", "filter_actions", "to_json_lines", "to_kafka_value",
]
