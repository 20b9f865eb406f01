"""Console and Kafka outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame

from clickwarden.defaults import PREVIEW_ROWS
from clickwarden.functions.events import to_json_lines
from clickwarden.sinks.tables import Sink


def console_sink(n: int = PREVIEW_ROWS) -> Sink:
    """Print the first `n` rows of every micro-batch."""
    return lambda writer: writer.format("console").option("numRows", n).option("truncate", "false")


def kafka_sink_options(servers: str, topic: str) -> dict[str, str]:
    return {"kafka.bootstrap.servers": servers, "topic": topic}


def kafka_sink(servers: str, topic: str) -> Sink:
    """Send rows made by `to_kafka_value` to a topic. Needs the spark-sql-kafka package."""
    return lambda writer: writer.format("kafka").options(**kafka_sink_options(servers, topic))


def write_json_events(events: DataFrame, path: str) -> None:
    """Batch events to text files of JSON lines, the form all sources read."""
    to_json_lines(events).write.text(path)
