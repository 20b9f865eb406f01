"""What the operators of this folder share: saved intermediate tables, and small expression helpers."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickwarden.session import scratch_dir
from clickwarden.sinks.folders import Folder

#: What separates words, as a regular expression that Java and Python read alike.
BREAK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


#: Where the folders of saved tables are noted, if anywhere.
_noted: ContextVar[list[str] | None] = ContextVar("noted", default=None)


def saved(frame: DataFrame) -> DataFrame:
    """The frame, written to the folder that all executors share and read again.

    A lost executor then costs the tasks it ran, not the steps before them.
    """
    spark = frame.sparkSession
    folder = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    frame.write.parquet(folder)
    if (folders := _noted.get()) is not None:
        folders.append(folder)
    return spark.read.schema(frame.schema).parquet(folder)


@contextmanager
def noted() -> Iterator[list[str]]:
    """The folders of the tables that are saved meanwhile."""
    folders: list[str] = []
    before = _noted.set(folders)
    try:
        yield folders
    finally:
        _noted.reset(before)
        if (outer := _noted.get()) is not None:
            outer += folders


def delete_folders(folders: list[str], kept: DataFrame) -> None:
    """Deletes the folders, but for those that `kept` reads."""
    read = kept.inputFiles() if folders else []
    for folder in folders:
        if not any(folder.rpartition("/")[2] in file for file in read):
            Folder(kept.sparkSession, folder).delete("")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with the value computed once a row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def keyed_texts(frame: DataFrame, id_col: str, text_col: str, *others: str) -> DataFrame:
    """The named columns only, so that no other column's name can clash: doc_id, text and the others."""
    return frame.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"),
                        *[F.col(f"`{name}`") for name in others])


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
