"""Events from files and from lines in memory."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from clickwarden.functions.events import parse_events

# Spark's own default skips files more than a week older than the newest one it has seen.
MAX_FILE_AGE = "36500d"


def events_from_json_lines(spark: SparkSession, lines: Iterable[str]) -> DataFrame:
    """Batch events from JSON lines held by the driver; for fixtures and trials."""
    return parse_events(spark.createDataFrame([(line,) for line in lines], "value string"))


def read_json_events(spark: SparkSession, path: str) -> DataFrame:
    """Batch events from JSON files, one object per line; unusable lines are left out.

    For the unusable lines use `rejected_events(spark.read.text(path))`, which reads each line the same way.
    """
    return parse_events(spark.read.text(path))


def read_spool_events(spark: SparkSession, directory: str, max_files_per_trigger: int | None = 500,
                      archive_directory: str | None = None, max_file_age: str = MAX_FILE_AGE) -> DataFrame:
    """Raw lines of the files dropped into a folder, as a stream `value, file`.

    Feed it to `parse_events`. Files must appear whole (write elsewhere, then move in); a move keeps
    a file's time, so old files are read too unless `max_file_age` says otherwise. The driver
    remembers the names of the files it has read for that long: with very many files, archive them.
    With `archive_directory`, files already read are moved there; such a stream may feed one query
    only, so not `run_app` with `rejects_path`.
    """
    reader = spark.readStream.format("text").option("maxFileAge", max_file_age)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if archive_directory is not None:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive_directory)
    return reader.load(directory).select("value", F.col("_metadata.file_path").alias("file"))


def stream_table(spark: SparkSession, path: str, max_files_per_trigger: int | None = None,
                 max_file_age: str = MAX_FILE_AGE) -> DataFrame:
    """A Parquet table, one file or a folder of them, as a stream; `max_file_age` as for the spool folder."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFileAge", max_file_age)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    # The stream reader takes folders and globs, not a file; this glob matches the path itself.
    parent, _, name = path.rstrip("/").rpartition("/")
    return reader.parquet(f"{parent}/{{{name}}}")
