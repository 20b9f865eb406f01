"""Events of a folder of files, taken in once: typed, counted by pane, and judged window by window.

Each batch takes files that no batch before has taken. Which these are stands in a ledger, a table that the folder's listing is
anti-joined with, so nothing that grows with history is held by the driver. A batch reads its files once and writes the typed
events and the rejects, then counts the events it has just written by ip, pane and category, and a commit makes all of it
part of the store at once. What dies before its commit is not there, and what two at once take, the second gives back.

Detectors read the counts: a few rows for each ip and pane, whatever the number of events, and of new events only what they add.
`follow` judges windows as the watermark passes them, and judges anew those that events come late for.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from clickwarden.defaults import WINDOW
from clickwarden.functions.events import EVENT_COLUMNS, tag_events
from clickwarden.functions.times import duration_seconds
from clickwarden.operators.counts import ACTION_COUNTS, EVENT_COUNT, with_window
from clickwarden.operators.detectors import any_test, judge_activity
from clickwarden.operators.panes import (
    RUNS_FROM, WORD_BITS, category_bits, first_window_end, in_windows, window_runs, windows_of_a_pane)
from clickwarden.sinks.folders import CommitLog, Folder

TAGGED = "ip string, category_id string, type string, timestamp timestamp, value string, reject_reason string, file string, kind string"
COUNTS = [*EVENT_COUNT, *ACTION_COUNTS]
PARTIALS = ("ip string, window struct<start: timestamp, end: timestamp>, word bigint, other string, bits bigint, "
            + ", ".join(f"{name} bigint" for name in COUNTS))
LEDGER = "path string, batch bigint"
EVENT, REJECT = "event", "reject"
# The files of a batch, and the tables of counts and ledgers that a store has before they are folded together.
MAX_FILES, FOLD_FROM = 1000, 50


@dataclass
class Taken:
    """What a batch took in."""

    batch: int
    files: int
    events: int
    rejects: int


@dataclass
class Followed:
    """What following the store up to a batch did: windows of ips judged for the first time and anew, and the events that came late for them."""

    batch: int
    closed: int
    repaired: int
    late_events: int


class EventStore:
    """A store in the folder `path`. `pane` divides all windows that will be asked for; the first batch fixes it."""

    def __init__(self, spark: SparkSession, path: str, pane: str = WINDOW):
        self.spark, self.path, self.pane = spark, path.rstrip("/"), pane
        self.log = CommitLog(spark, self.path)

    def _content(self) -> dict:
        _, content = self.log.last()
        return content or {"pane": duration_seconds(self.pane), "batches": [], "ledger": [], "partials": [], "newest": None}

    def _read(self, folders: list[str], schema: str) -> DataFrame:
        reader = self.spark.read.schema(schema)
        return reader.parquet(*[f"{self.path}/{name}" for name in folders]) if folders else self.spark.createDataFrame([], schema)

    def new_files(self, directory: str, max_files: int = MAX_FILES) -> list[str]:
        """The oldest files below `directory` that no batch has taken, `max_files` at most."""
        if not Folder(self.spark, directory).exists(""):
            return []
        listed = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(directory).select("path", "modificationTime")
        new = listed.join(self.files(), "path", "left_anti").orderBy("modificationTime", "path").limit(max_files)
        return [row["path"] for row in new.collect()]

    def ingest(self, directory: str, max_files: int = MAX_FILES) -> Taken | None:
        """Takes in the next files of JSON lines; None if there are none. Files must appear whole; an empty one is no file."""
        while True:
            number, _ = self.log.last()
            content = self._content()
            paths = self.new_files(directory, max_files)
            if not paths:
                return None
            folder = f"batches/{number + 1:010d}-{uuid.uuid4().hex}"
            taken = self._take(folder, number + 1, paths, content["pane"])
            newest = [moment for moment in (content["newest"], taken[1]) if moment is not None]
            made = {**content, "batches": [*content["batches"], {"batch": number + 1, "folder": folder}],
                    "ledger": [*content["ledger"], f"{folder}/ledger"], "partials": [*content["partials"], f"{folder}/partials"],
                    "newest": max(newest, default=None)}
            if self.log.write(number + 1, made):
                if len(made["ledger"]) >= FOLD_FROM:
                    self.fold()
                return taken[0]
            Folder(self.spark, self.path).delete(folder)  # another was first, and may have taken these files

    def _take(self, folder: str, batch: int, paths: list[str], pane: int) -> tuple[Taken, int | None]:
        raw = self.spark.read.text([re.sub(r"([{}\[\]*?\\])", r"\\\1", path) for path in paths])
        tagged = tag_events(raw.select("value", F.col("_metadata.file_path").alias("file")), keep=["file"])
        good = F.col("reject_reason").isNull()
        seen = Observation()
        kept = tagged.select(*EVENT_COLUMNS, F.when(~good, F.col("value")).alias("value"), "reject_reason", "file",
                             F.when(good, EVENT).otherwise(REJECT).alias("kind"))
        counted = kept.observe(seen, F.count_if(good).alias("events"), F.count_if(~good).alias("rejects"),
                               F.max(F.unix_micros("timestamp")).alias("newest"))
        counted.write.partitionBy("kind").parquet(f"{self.path}/{folder}/tagged")
        numbers = seen.get
        self._partials(self._tagged([folder], EVENT), pane).write.parquet(f"{self.path}/{folder}/partials")
        self.spark.createDataFrame([(path, batch) for path in paths], LEDGER).coalesce(1).write.parquet(f"{self.path}/{folder}/ledger")
        return Taken(batch, len(paths), numbers["events"], numbers["rejects"]), numbers["newest"]

    def _partials(self, events: DataFrame, pane: int) -> DataFrame:
        coded = with_window(events, f"{pane} seconds").select("*", *category_bits())
        return coded.groupBy("ip", "window", "word", "other").agg(
            F.bit_or("bit").alias("bits"), *[F.expr(count).alias(name) for name, count in {**EVENT_COUNT, **ACTION_COUNTS}.items()])

    def _tagged(self, folders: list[str], kind: str) -> DataFrame:
        there = [f"{name}/tagged/kind={kind}" for name in folders if Folder(self.spark, self.path).exists(f"{name}/tagged/kind={kind}")]
        return self._read(there, TAGGED)

    def _folders(self) -> list[str]:
        return [batch["folder"] for batch in self._content()["batches"]]

    def files(self) -> DataFrame:
        """(path, batch): the ledger."""
        return self._read(self._content()["ledger"], LEDGER)

    def events(self) -> DataFrame:
        """All events, with the file each came from."""
        return self._tagged(self._folders(), EVENT).select(*EVENT_COLUMNS, "file")

    def rejects(self) -> DataFrame:
        """(value, reject_reason, file): all lines that are no events."""
        return self._tagged(self._folders(), REJECT).select("value", "reject_reason", "file")

    def partials(self) -> DataFrame:
        """Counts by ip, pane and category word; a group has a row for each batch that saw it, until they are folded."""
        return self._read(self._content()["partials"], PARTIALS)

    def fold(self) -> None:
        """Folds the batches' counts into one row for each group, and the ledgers into one table. Readers of earlier commits are not disturbed."""
        while True:
            number, content = self.log.last()
            if content is None or len(content["ledger"]) < 2:
                return
            folder = f"folded/{uuid.uuid4().hex}"
            _merged(self._read(content["partials"], PARTIALS), ["ip", "window", "word", "other"]).write.parquet(f"{self.path}/{folder}/partials")
            self._read(content["ledger"], LEDGER).write.parquet(f"{self.path}/{folder}/ledger")
            if self.log.write(number + 1, {**content, "partials": [f"{folder}/partials"], "ledger": [f"{folder}/ledger"]}):
                return
            Folder(self.spark, self.path).delete(folder)

    def activity(self, window_duration: str = WINDOW, slide_duration: str | None = None) -> DataFrame:
        """(ip, window, n_events, clicks, views, n_categories) of all events, from the counts alone."""
        window, slide = self._checked(window_duration), self._checked(slide_duration or window_duration)
        return _activity(in_windows(self.partials(), window, slide))

    def _checked(self, duration: str) -> str:
        pane = self._content()["pane"]
        if duration_seconds(duration) % pane:
            raise ValueError(f"{duration!r} is not a number of whole panes of {pane} seconds")
        return duration

    def detect_all(self, max_events: int, max_ratio: int, max_categories: int, window_duration: str = WINDOW,
                   slide_duration: str | None = None, missing_views: str = "one") -> DataFrame:
        """What `operators.detect_all` finds among all events, from the counts alone."""
        window, slide = self._checked(window_duration), self._checked(slide_duration or window_duration)
        if windows_of_a_pane(window, slide) < RUNS_FROM:
            activity = self.activity(window, slide)
        else:  # by running sums: only flagged windows are written out
            flagged = any_test(max_events, max_ratio, max_categories, missing_views)
            activity = window_runs(_by_category(self.partials()), window, slide, COUNTS, flagged, ["category"])
        return judge_activity(activity, max_events, max_ratio, max_categories, missing_views)

    def follow(self, path: str, max_events: int, max_ratio: int, max_categories: int, watermark_delay: str,
               window_duration: str = WINDOW, slide_duration: str | None = None, missing_views: str = "one") -> Followed | None:
        """Judges the windows that the watermark has passed since the last call, and anew those that late events fall into.

        The watermark runs `watermark_delay` behind the newest event, and closes a window as it reaches its end. New events of windows that
        have been judged are late: they are kept in `late_events`, their windows are counted again from the store, and the new finding
        replaces the old. The table at `path` is a log of changes, of one way to judge: `read_changes` by ip and window gives the
        detections as they stand, `merge_changes` folds it. None if there is no new batch; a call that dies is made up for by the next.
        """
        window, slide = self._checked(window_duration), self._checked(slide_duration or window_duration)
        done, content = CommitLog(self.spark, path), self._content()
        number, before = done.last()
        batches = [batch for batch in content["batches"] if batch["batch"] > (before or {"batch": 0})["batch"]]
        if not batches or content["newest"] is None:
            return None
        old, new = before and before["watermark"], content["newest"] - duration_seconds(watermark_delay) * 1_000_000
        partials, length = self.partials(), duration_seconds(window) * 1_000_000
        within = _before(F.col("window.start"), new) & (F.lit(True) if old is None else ~_before(F.col("window.start"), old - length))
        passed = _before(F.col("window.end"), new + 1) & (F.lit(True) if old is None else ~_before(F.col("window.end"), old + 1))
        judged = _activity(in_windows(partials.where(within), window, slide).where(passed))
        late = self._tagged([batch["folder"] for batch in batches], EVENT).select(*EVENT_COLUMNS, "file")
        late = late.where(F.lit(False) if old is None else _before(first_window_end("timestamp", window, slide), old + 1))
        if old is not None:
            own = in_windows(self._read([f"{batch['folder']}/partials" for batch in batches], PARTIALS), window, slide)
            again = own.where(_before(F.col("window.end"), old + 1)).select("ip", "window").distinct()
            judged = judged.unionByName(_activity(in_windows(partials, window, slide).join(again, ["ip", "window"], "left_semi")))
        found = judge_activity(judged, max_events, max_ratio, max_categories, missing_views, keep_passed=True)
        last, table = batches[-1]["batch"], f"{path}/run=store/batch_id={batches[-1]['batch']}"
        found.withColumn("written_at", F.current_timestamp()).write.mode("overwrite").parquet(table)
        late.write.mode("overwrite").parquet(f"{path}/_late/batch_id={last}")
        first_time = F.lit(True) if old is None else ~_before(F.col("window_end"), old + 1)
        closed, all_rows = self.spark.read.parquet(table).agg(F.count_if(first_time), F.count(F.lit(1))).first()
        if not done.write(number + 1, {"batch": last, "watermark": new}):
            raise RuntimeError(f"another call has followed the store into {path}")
        return Followed(last, closed, all_rows - closed, self.spark.read.parquet(f"{path}/_late/batch_id={last}").count())

    def late_events(self, path: str) -> DataFrame:
        """The events that came late for what is followed at `path`, with the file each came from."""
        folders = [f"{path}/_late/{name}" for name in Folder(self.spark, path).names("_late")]
        schema = "ip string, category_id string, type string, timestamp timestamp, file string"
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)


def _before(moment: Column, micros: int) -> Column:
    return moment < F.timestamp_micros(F.lit(micros))


def _merged(partials: DataFrame, keys: list[str]) -> DataFrame:
    return partials.groupBy(*keys).agg(F.bit_or("bits").alias("bits"), *[F.sum(name).alias(name) for name in COUNTS])


def _by_category(partials: DataFrame) -> DataFrame:
    """The rows by pane once for each category in their bits, as `category`; the first of these has the counts."""
    numbers = F.filter(F.sequence(F.lit(0), F.lit(WORD_BITS - 1)), lambda at: F.call_function("getbit", "bits", at) == 1)
    rows = partials.select("ip", "window", "word", "other", *COUNTS, F.posexplode(numbers).alias("nth", "number"))
    return rows.select("ip", "window", F.struct("word", "other", "number").alias("category"),
                       *[F.when(F.col("nth") == 0, F.col(name)).otherwise(0).alias(name) for name in COUNTS])


def _activity(by_window: DataFrame) -> DataFrame:
    return _merged(by_window, ["ip", "window", "word", "other"]).groupBy("ip", "window").agg(
        *[F.sum(name).alias(name) for name in COUNTS], F.sum(F.bit_count("bits")).alias("n_categories"))
