"""One read of a source for everything: a stream that keeps typed events and rejects, for detectors to read.

Both kinds are parts of one table, written by Spark's file sink, whose log names the files of each finished batch. A batch that dies is in
neither kind for readers, and comes once when it is done again.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from clickwarden.functions.events import EVENT_COLUMNS, tag_events
from clickwarden.sinks.folders import Folder
from clickwarden.sources.files import MAX_FILE_AGE
from clickwarden.streaming.run import AVAILABLE_NOW

TYPED = "ip string, category_id string, type string, timestamp timestamp, value string, reject_reason string, kind string"
EVENT, REJECT = "event", "reject"


def start_typing(raw: DataFrame, path: str, checkpoint: str, trigger: str | None = None, value: str = "value",
                 keep: Iterable[str] = ()) -> StreamingQuery:
    """Start the stream that keeps raw messages as typed events and rejects at `path`; the source is read once for both.

    `keep` carries columns of the source along. `trigger` is as in `start_stream`.
    """
    good = F.col("reject_reason").isNull()
    typed = tag_events(raw, value, keep).select(
        *EVENT_COLUMNS, F.when(~good, F.col("value")).alias("value"), "reject_reason", *keep,
        F.when(good, EVENT).otherwise(REJECT).alias("kind"))
    writer = typed.writeStream.format("parquet").partitionBy("kind").option("path", path).option("checkpointLocation", checkpoint)
    if trigger == AVAILABLE_NOW:
        writer = writer.trigger(availableNow=True)
    elif trigger is not None:
        writer = writer.trigger(processingTime=trigger)
    return writer.outputMode("append").start()


def has_typed(spark: SparkSession, path: str) -> bool:
    """Whether a batch has been finished, so that readers know the table by its log."""
    return bool(Folder(spark, path).names("_spark_metadata"))


def read_typed_events(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """The typed events as a stream, with the `file` and `row` that tell them apart, also those of one second (`salt_by`)."""
    if not has_typed(spark, path):
        raise ValueError(f"nothing has been written to {path} yet")
    reader = spark.readStream.schema(TYPED).option("maxFileAge", MAX_FILE_AGE)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    rows = reader.parquet(path).where(F.col("kind") == EVENT)
    return rows.select(*EVENT_COLUMNS, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def read_typed_rejects(spark: SparkSession, path: str) -> DataFrame:
    """(value, reject_reason) of the messages that are no events, as a batch."""
    return spark.read.schema(TYPED).parquet(path).where(F.col("kind") == REJECT).select("value", "reject_reason")
