"""The ready-made application: raw messages in, blocked ips out."""

from __future__ import annotations

import argparse
import sys
import time
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from clickwarden import defaults
from clickwarden.functions.events import parse_events, rejected_events
from clickwarden.functions.times import duration_seconds
from clickwarden.operators.blocklist import combine_detections
from clickwarden.operators.counts import DEDUP_SALTS, SALT_BY
from clickwarden.operators.detectors import (
    detect_all, detect_category_spread, detect_click_view_ratio, detect_high_activity)
from clickwarden.operators.panes import RUNS_FROM, windows_of_a_pane
from clickwarden.session import build_session
from clickwarden.sinks import (
    CASSANDRA, Sink, blocklist_sink, cassandra_options, cassandra_sink, console_sink, newly_flagged_sink, parquet_sink, table_writer)
from clickwarden.sources import read_kafka_events, read_spool_events
from clickwarden.streaming.changes import STATE_STORE
from clickwarden.streaming.run import AVAILABLE_NOW, LateRows, run_stream, start_stream
from clickwarden.streaming.typed import has_typed, read_typed_events, start_typing

# What the command line assumes where an option is not given.
PRESETS = {
    "tumbling": {"window": defaults.WINDOW, "missing_views": "one"},
    "sliding": {"window": defaults.SLIDING_WINDOW, "slide": defaults.SLIDING_STEP, "missing_views": "drop",
                "combine_window": defaults.COMBINE_WINDOW, "trigger": defaults.BATCH_INTERVAL},
}

# How often the two queries of an application are looked after.
POLL_SECONDS = 1
# How long the end of a run waits for the last report of late rows.
LISTENER_MILLISECONDS = 10_000

# What tells any two events of the typed table apart.
TYPED_SALT_BY = ("file", "row")

DETECTORS = ("all", "high_activity", "click_view_ratio", "category_spread")


def run_app(raw: DataFrame, detect: Callable[[DataFrame], DataFrame], sink: Sink, checkpoint: str,
            mode: str = "append", trigger: str | None = None, timeout: float | None = None,
            rejects_path: str | None = None, rejects_sink: Sink | None = None, events_path: str | None = None,
            settings: dict[str, str] | None = None) -> StreamingQuery:
    """Parse raw messages, detect, write; with `rejects_path`, also keep the unusable messages there.

    The rejects are a second query with its own read of the source: a stateful query writes one
    result only. If either query fails, both stop and the failure is raised. `rejects_sink` is where the
    rejects go instead of a Parquet table.

    With `events_path` the source is read once: a first query keeps typed events and rejects in that table, and the
    detectors read it; the events then have the columns `file` and `row`, which tell any two apart (`salt_by`). `settings` are for
    the detectors' query alone.
    """
    if events_path is not None:
        if rejects_path is not None or rejects_sink is not None:
            raise ValueError("the table of events holds the rejects too; give one of the two")
        return _run_over_typed(raw, detect, sink, checkpoint, mode, trigger, timeout, events_path, settings)
    if rejects_path is not None and rejects_sink is None:
        rejects_sink = parquet_sink(rejects_path)
    if rejects_sink is None:
        return run_stream(detect(parse_events(raw)), sink, f"{checkpoint}/detections", mode, trigger, timeout, settings=settings)
    rejects = start_stream(rejected_events(raw), rejects_sink, f"{checkpoint}/rejects", trigger=trigger)
    query = None
    try:
        query = start_stream(detect(parse_events(raw)), sink, f"{checkpoint}/detections", mode, trigger, settings=settings)
        _wait(_end(timeout), query, rejects)
        return query
    finally:
        for one in (query, rejects):
            if one is not None:
                one.stop()


def _run_over_typed(raw: DataFrame, detect, sink: Sink, checkpoint: str, mode: str, trigger: str | None, timeout: float | None,
                    path: str, settings: dict[str, str] | None) -> StreamingQuery | None:
    """None where nothing has come before the time is over."""
    spark, end, query = raw.sparkSession, _end(timeout), None
    typing = start_typing(raw, path, f"{checkpoint}/events", trigger)
    try:
        # The detectors begin when there is a table; runs that end take all of it.
        while not (typing.awaitTermination(POLL_SECONDS) if trigger == AVAILABLE_NOW else has_typed(spark, path)):
            if trigger != AVAILABLE_NOW and typing.awaitTermination(POLL_SECONDS) or _over(end):
                break
        if not has_typed(spark, path):
            return None
        query = start_stream(detect(read_typed_events(spark, path)), sink, f"{checkpoint}/detections", mode, trigger, settings=settings)
        _wait(end, query, typing)
        return query
    finally:
        for one in (query, typing):
            if one is not None:
                one.stop()


def _end(timeout: float | None) -> float | None:
    return None if timeout is None else time.monotonic() + timeout


def _over(end: float | None) -> bool:
    return end is not None and time.monotonic() >= end


def _wait(end: float | None, *queries: StreamingQuery) -> None:
    while not _over(end):
        # Waiting raises the failure of the query waited for.
        if all([one.awaitTermination(POLL_SECONDS) for one in queries]):
            break


def build_detector(name: str, max_events: int = defaults.MAX_EVENTS, max_ratio: int = defaults.MAX_RATIO,
                   max_categories: int = defaults.MAX_CATEGORIES, window_duration: str = defaults.WINDOW,
                   slide_duration: str | None = None, missing_views: str = "one", scope: str = "per_window",
                   watermark_delay: str | None = None, mode: str = "append",
                   combine_window: str | None = None, salts: int = DEDUP_SALTS,
                   salt_by: Iterable[str] = SALT_BY) -> Callable[[DataFrame], DataFrame]:
    """A detector by name with its settings filled in; `combine_window` merges its findings per ip.

    `salts` and `salt_by` are as in `category_window_pairs`.
    """
    common = {"window_duration": window_duration, "slide_duration": slide_duration,
              "watermark_delay": watermark_delay}

    def detect(events: DataFrame) -> DataFrame:
        if name == "all":
            found = detect_all(events, max_events, max_ratio, max_categories, missing_views=missing_views, **common)
        elif name == "high_activity":
            found = detect_high_activity(events, max_events, mode=mode, **common)
        elif name == "click_view_ratio":
            found = detect_click_view_ratio(events, max_ratio, missing_views=missing_views,
                                            keep_passed=mode == "update", mode=mode, **common)
        else:
            found = detect_category_spread(events, max_categories, scope=scope, mode=mode, salts=salts, salt_by=salt_by, **common)
        return found if combine_window is None else combine_detections(found, window_duration=combine_window)

    if name not in DETECTORS:
        raise ValueError(f"detector must be one of {DETECTORS}, not {name!r}")
    return detect


def parse_arguments(arguments: Sequence[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="clickwarden", description="Block ips that act like bots.")
    source = parser.add_mutually_exclusive_group(required=True)
    source.add_argument("--kafka", metavar="SERVERS", help="read a Kafka topic of these servers")
    source.add_argument("--spool", metavar="FOLDER", help="read the files dropped into a folder")
    parser.add_argument("--topic", help="topic to read with --kafka")
    parser.add_argument("--starting-offsets", default="earliest")
    parser.add_argument("--max-offsets-per-trigger", type=int)
    parser.add_argument("--max-files-per-trigger", type=int, default=500)

    target = parser.add_mutually_exclusive_group(required=True)
    target.add_argument("--blocklist", metavar="PATH", help="write entries to a Parquet table")
    target.add_argument("--cassandra", metavar="KEYSPACE.TABLE", help="write ips to a Cassandra table")
    target.add_argument("--console", action="store_true", help="print the detections")
    kept = parser.add_mutually_exclusive_group()
    kept.add_argument("--rejects", metavar="PATH", help="keep unusable messages there; the source is read a second time for them")
    kept.add_argument("--events", metavar="PATH", help="keep typed events and unusable messages there; the detectors read "
                                                       "that table, so that the source is read once")
    parser.add_argument("--checkpoint", required=True, metavar="PATH")

    parser.add_argument("--preset", choices=tuple(PRESETS), default="tumbling",
                        help="tumbling: long windows, runs until stopped; sliding: short overlapping windows, "
                             "detections merged")
    parser.add_argument("--detector", choices=DETECTORS, default="all")
    parser.add_argument("--max-events", type=int, default=defaults.MAX_EVENTS)
    parser.add_argument("--max-ratio", type=int, default=defaults.MAX_RATIO)
    parser.add_argument("--max-categories", type=int, default=defaults.MAX_CATEGORIES)
    parser.add_argument("--missing-views", choices=("one", "drop"))
    parser.add_argument("--scope", choices=("per_window", "all_windows"), default="per_window")
    parser.add_argument("--window")
    parser.add_argument("--slide")
    parser.add_argument("--watermark", help="how late an event may come; needed in append mode")
    parser.add_argument("--combine-window", help="merge the detections of an ip over such windows")
    parser.add_argument("--ttl", type=int, default=defaults.TTL_SECONDS, help="seconds a block lasts")
    parser.add_argument("--salts", type=int, default=DEDUP_SALTS,
                        help="over how many reducers early category counts spread a busy ip")
    parser.add_argument("--mode", choices=("append", "update", "complete"), default="append")
    parser.add_argument("--trigger", help=f"interval such as '10 seconds', or {AVAILABLE_NOW}")
    parser.add_argument("--timeout", type=float, help="stop after so many seconds")
    preset = parser.parse_known_args(arguments)[0].preset
    parser.set_defaults(**PRESETS[preset])
    options = parser.parse_args(arguments)

    if options.kafka and not options.topic:
        parser.error("--kafka needs --topic")
    if options.mode == "append" and not options.watermark:
        parser.error("append mode needs --watermark")
    if options.mode != "append" and (options.detector == "all" or options.combine_window):
        parser.error("--detector all and --combine-window need append mode")
    if options.scope == "all_windows" and options.detector == "category_spread" and options.mode == "append":
        parser.error("--scope all_windows needs update or complete mode")
    if options.mode == "complete" and not options.console:
        parser.error("complete mode sends all results again with each batch; use it with --console")
    if options.cassandra and options.cassandra.count(".") != 1:
        parser.error("--cassandra needs KEYSPACE.TABLE")
    return options


def main(arguments: Sequence[str] | None = None) -> None:
    options = parse_arguments(arguments)
    spark = build_session()
    if options.kafka:
        raw = read_kafka_events(spark, options.kafka, options.topic, options.starting_offsets,
                                options.max_offsets_per_trigger)
    else:
        raw = read_spool_events(spark, options.spool, options.max_files_per_trigger)
    detect = build_detector(
        options.detector, options.max_events, options.max_ratio, options.max_categories, options.window,
        options.slide, options.missing_views, options.scope, options.watermark, options.mode,
        options.combine_window, options.salts, SALT_BY if options.events is None else TYPED_SALT_BY)
    if options.blocklist:
        delay = duration_seconds(options.watermark) if options.mode == "append" else 0
        sink = blocklist_sink(options.blocklist, options.detector, options.ttl, delay_seconds=delay,
                              early=options.mode == "update")
    elif options.cassandra and options.mode == "update":  # a group that is sent again must not renew its ip
        send = table_writer(CASSANDRA, cassandra_options(*options.cassandra.split("."), ttl_seconds=options.ttl))
        sink = newly_flagged_sink(send, f"{options.checkpoint}/sent", options.ttl, early=True)
    elif options.cassandra:
        sink = cassandra_sink(*options.cassandra.split("."), ttl_seconds=options.ttl)
    else:
        sink = console_sink()
    late = LateRows(lambda _, batch, rows: print(f"batch {batch}: {rows} rows came behind the watermark and were dropped",
                                                 file=sys.stderr))
    spark.streams.addListener(late)
    try:
        run_app(raw, detect, sink, options.checkpoint, options.mode, options.trigger, options.timeout, options.rejects,
                events_path=options.events,
                settings=STATE_STORE if windows_of_a_pane(options.window, options.slide) >= RUNS_FROM else None)
    finally:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(LISTENER_MILLISECONDS)
        spark.streams.removeListener(late)
