"""Events from Kafka. Needs the spark-sql-kafka package on the class path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def kafka_source_options(servers: str, topic: str, starting_offsets: str = "earliest",
                         max_offsets_per_trigger: int | None = None,
                         min_partitions: int | None = None) -> dict[str, str]:
    """Reader options. `max_offsets_per_trigger` bounds a micro-batch, also the first one that catches
    up from `earliest`; `min_partitions` splits large topic partitions over more tasks."""
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": starting_offsets,
    }
    if max_offsets_per_trigger is not None:
        options["maxOffsetsPerTrigger"] = str(max_offsets_per_trigger)
    if min_partitions is not None:
        options["minPartitions"] = str(min_partitions)
    return options


def read_kafka_events(spark: SparkSession, servers: str, topic: str, starting_offsets: str = "earliest",
                      max_offsets_per_trigger: int | None = None, min_partitions: int | None = None) -> DataFrame:
    """Raw messages of a topic as a stream; feed it to `parse_events`, which reads column `value`."""
    options = kafka_source_options(servers, topic, starting_offsets, max_offsets_per_trigger, min_partitions)
    return spark.readStream.format("kafka").options(**options).load()
