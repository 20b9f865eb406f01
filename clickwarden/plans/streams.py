"""Registered streaming queries: the `events` table read as a stream, run to its end, then read back.

Results go through tables in the scratch folder, never through the driver. The queries of `in_steps` get the
table in several parts by time, each read after a stop and restart from the checkpoint, so that state is carried
from batch to batch. Append mode leaves out the windows that the last watermark has not passed; their SQL does too.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from clickwarden.functions import events_from_table, parse_events, rejected_events
from clickwarden.functions.times import duration_seconds
from clickwarden.operators import (
    blocklist, combine_detections, detect_all, detect_all_early, detect_category_spread, detect_click_view_ratio, detect_high_activity, first_of_each_ip)
from clickwarden.plans import batch
from clickwarden.session import scratch_dir
from clickwarden.sinks import (
    KeyedBlocklist, Sink, blocklist_sink, changes_sink, compact_blocklist, parquet_sink, read_appended, read_blocklist, read_changes,
    keyed_sink, merge_changes, read_snapshot, remove_expired, snapshot_sink, write_json_events)
from clickwarden.sources import read_spool_events, stream_table
from clickwarden.streaming import AVAILABLE_NOW, STATE_STORE, EventStore, block_changes, blocked_by_changes, run_stream

WATERMARK = "1 hour"
HOLD = "60 days"
WINDOW_KEYS = ["ip", "window_start", "window_end"]
STEPS = 3


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_from_table(stream_table(spark, f"{sf_dir}/events.parquet"))


def finish(spark: SparkSession, result: DataFrame, mode: str, keys=WINDOW_KEYS) -> DataFrame:
    """Run `result` over all the data there is and return what it wrote."""
    folder = scratch_dir(spark)
    run_stream(result, sink_of(mode, folder), f"{folder}/checkpoint", mode, AVAILABLE_NOW)
    return written(spark, folder, result, mode, keys)


def sink_of(mode: str, folder: str) -> Sink:
    return {"append": parquet_sink, "update": changes_sink, "complete": snapshot_sink}[mode](f"{folder}/table")


def written(spark: SparkSession, folder: str, result: DataFrame, mode: str, keys=WINDOW_KEYS) -> DataFrame:
    table = f"{folder}/table"
    if mode == "append":
        return batch.plain(read_appended(spark, table, result.schema))
    return batch.plain(read_changes(spark, table, keys) if mode == "update" else read_snapshot(spark, table))


def in_steps(spark: SparkSession, sf_dir: str, detect: Callable[[DataFrame], DataFrame], sink: Sink, folder: str,
             mode: str = "append", settings: dict[str, str] | None = None,
             between: Callable[[], None] | None = None) -> DataFrame:
    """Spool the events as JSON lines, a part by time after the other, and run the query anew after each."""
    result = None
    for step, part in enumerate(parts_by_time(spark, sf_dir)):
        if step and between is not None:
            between()
        write_json_events(part, f"{folder}/spool/step={step}")
        result = detect(parse_events(read_spool_events(spark, f"{folder}/spool")))
        run_stream(result, sink, f"{folder}/checkpoint", mode, AVAILABLE_NOW, settings=settings)
    return result


def finish_in_steps(spark: SparkSession, sf_dir: str, detect, mode: str, keys=WINDOW_KEYS,
                    settings: dict[str, str] | None = None) -> DataFrame:
    folder = scratch_dir(spark)
    result = in_steps(spark, sf_dir, detect, sink_of(mode, folder), folder, mode, settings)
    return written(spark, folder, result, mode, keys)


def high_activity(mode):
    def query(spark, sf_dir):
        found = detect_high_activity(stream_events(spark, sf_dir), batch.MAX_EVENTS, batch.DAY,
                                     watermark_delay=WATERMARK)
        return finish(spark, found, mode)

    return query


def high_activity_sliding(spark, sf_dir):
    found = detect_high_activity(stream_events(spark, sf_dir), batch.MAX_EVENTS_SLIDING, batch.TWO_DAYS, batch.DAY,
                                 watermark_delay=WATERMARK, mode="append")
    return finish(spark, found, "append")


def high_activity_by_the_hour(spark, sf_dir):
    return finish_in_steps(spark, sf_dir, lambda events: detect_high_activity(
        events, batch.MAX_EVENTS, batch.DAY, batch.HOUR, watermark_delay=WATERMARK, mode="append"), "append", settings=STATE_STORE)


def all_detectors_by_the_hour(spark, sf_dir):
    return finish_in_steps(spark, sf_dir, lambda events: detect_all(
        events, batch.MAX_EVENTS, batch.MAX_RATIO, batch.MAX_CATEGORIES, batch.DAY, batch.HOUR, watermark_delay=WATERMARK),
        "append", settings=STATE_STORE)


def each_ip_once(spark, sf_dir):
    """Every ip of the events, told when it is first seen; held longer than the events last."""
    return finish_in_steps(spark, sf_dir, lambda events: first_of_each_ip(events, HOLD).select("ip"), "append")


def click_view_ratio(mode):
    def query(spark, sf_dir):
        return finish_in_steps(spark, sf_dir, lambda events: detect_click_view_ratio(
            events, batch.MAX_RATIO, batch.DAY, keep_passed=mode == "update"), mode)

    return query


def click_view_ratio_merged(spark, sf_dir):
    """In update mode, the log of changes being merged between the runs and after the last."""
    folder = scratch_dir(spark)

    def merge():
        merge_changes(spark, f"{folder}/table", WINDOW_KEYS)

    result = in_steps(spark, sf_dir, lambda events: detect_click_view_ratio(
        events, batch.MAX_RATIO, batch.DAY, keep_passed=True), sink_of("update", folder), folder, "update", between=merge)
    merge()
    return written(spark, folder, result, "update")


def click_view_ratio_sliding(spark, sf_dir):
    found = detect_click_view_ratio(stream_events(spark, sf_dir), batch.MAX_RATIO, batch.TWO_DAYS, batch.DAY,
                                    missing_views="drop", watermark_delay=WATERMARK, mode="append")
    return finish(spark, found, "append")


def category_spread(mode):
    def query(spark, sf_dir):
        return finish_in_steps(spark, sf_dir, lambda events: detect_category_spread(
            events, batch.MAX_CATEGORIES, batch.DAY, watermark_delay=WATERMARK, mode=mode), mode)

    return query


def category_spread_all_windows(spark, sf_dir):
    found = detect_category_spread(stream_events(spark, sf_dir), batch.MAX_PAIRS, batch.DAY, scope="all_windows",
                                   mode="complete")
    return finish(spark, found, "complete")


def all_detectors(stream: DataFrame) -> DataFrame:
    return detect_all(stream, batch.MAX_EVENTS, batch.MAX_RATIO, batch.MAX_CATEGORIES, batch.DAY,
                      watermark_delay=WATERMARK)


def detect_all_stream(spark, sf_dir):
    return finish(spark, all_detectors(stream_events(spark, sf_dir)), "append")


def detect_all_before_the_watermark(spark, sf_dir):
    """In update mode, over restarts; the categories' codes are their numbers."""
    names = batch.events(spark, sf_dir).select("category_id").distinct()
    dictionary = names.select("category_id", F.col("category_id").cast("bigint").alias("code"))
    return finish_in_steps(spark, sf_dir, lambda events: detect_all_early(
        events, dictionary, batch.MAX_EVENTS, batch.MAX_RATIO, batch.MAX_CATEGORIES, batch.DAY), "update")


def combined(spark, sf_dir):
    return finish(spark, combine_detections(all_detectors(stream_events(spark, sf_dir)), window_duration=batch.DAY), "append")


def combined_detections(events: DataFrame) -> DataFrame:
    return combine_detections(all_detectors(events), window_duration=batch.DAY)


def blocked_table(spark: SparkSession, sf_dir: str, ttl_seconds: int, delay_seconds: int = 0) -> str:
    """Raw JSON files to the expiring blocklist, the way the application runs."""
    folder = scratch_dir(spark)
    sink = blocklist_sink(f"{folder}/blocklist", "all", ttl_seconds, delay_seconds=delay_seconds)
    in_steps(spark, sf_dir, combined_detections, sink, folder)
    return f"{folder}/blocklist"


def stored_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_dir(spark)
    result = in_steps(spark, sf_dir, lambda events: block_changes(blocklist(combined_detections(events), batch.TTL_SECONDS)),
                      parquet_sink(f"{folder}/table"), folder, settings=STATE_STORE)
    return read_appended(spark, f"{folder}/table", result.schema)


def blocklist_changes(spark, sf_dir):
    return batch.plain(stored_changes(spark, sf_dir))


def blocked_by_change_log(spark, sf_dir):
    return batch.plain(blocked_by_changes(stored_changes(spark, sf_dir), f"{batch.AS_OF} UTC"))


def blocked(spark, sf_dir):
    return batch.plain(read_blocklist(spark, blocked_table(spark, sf_dir, batch.TTL_SECONDS), f"{batch.AS_OF} UTC"))


def blocked_in_keyed_table(spark, sf_dir):
    """Of all ips of the events, those that the keyed table has as blocked at the end."""
    folder = scratch_dir(spark)
    sink = keyed_sink(f"{folder}/keyed", batch.TTL_SECONDS, buckets=16)
    in_steps(spark, sf_dir, combined_detections, sink, folder)
    asked = batch.events(spark, sf_dir).select("ip")
    return batch.plain(KeyedBlocklist(spark, f"{folder}/keyed").is_blocked(asked, f"{batch.LAST_AS_OF} UTC"))


def blocked_for_a_short_time(spark, sf_dir):
    """As of just after the day's entries are written, with a time to live below the watermark's delay."""
    table = blocked_table(spark, sf_dir, batch.SHORT_TTL_SECONDS, duration_seconds(WATERMARK))
    return batch.plain(read_blocklist(spark, table, f"{batch.SHORT_AS_OF} UTC"))


def blocked_after_expiry(spark, sf_dir):
    """The entries that are left when the days before AS_OF are removed and the other days are compacted."""
    table = blocked_table(spark, sf_dir, batch.TTL_SECONDS)
    day = date.fromisoformat(batch.AS_OF[:10])
    remove_expired(spark, table, day)
    compact_blocklist(spark, table, day)
    return batch.plain(read_blocklist(spark, table).select("ip", "blocked_at", "expires_at", "reasons"))


def blocked_early(spark, sf_dir):
    """The three detectors as early blocking runs them: each in update mode, all into one table."""
    folder = scratch_dir(spark)
    detectors = {
        "high_activity": lambda events: detect_high_activity(events, batch.MAX_EVENTS, batch.DAY),
        "click_view_ratio": lambda events: detect_click_view_ratio(
            events, batch.MAX_RATIO, batch.DAY, keep_passed=True),
        "category_spread": lambda events: detect_category_spread(
            events, batch.MAX_CATEGORIES, batch.DAY, mode="update"),
    }
    for name, detect in detectors.items():
        run_stream(detect(stream_events(spark, sf_dir)),
                   blocklist_sink(f"{folder}/blocklist", name, batch.TTL_SECONDS, early=True),
                   f"{folder}/checkpoint-{name}", "update", AVAILABLE_NOW)
    found = read_blocklist(spark, f"{folder}/blocklist")
    return batch.plain(found.select("ip", "blocked_at", "expires_at", F.explode("reasons").alias("reason")))


def parts_by_time(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The events in STEPS parts, one time after the other."""
    events = batch.events(spark, sf_dir)
    low, high = events.agg(F.min("timestamp"), F.max("timestamp")).first()
    edges = [low + (high - low) * step / STEPS for step in range(STEPS)]
    numbered = sum(F.when(F.col("timestamp") >= F.lit(edge), 1).otherwise(0) for edge in edges[1:])
    return [events.filter(numbered == step) for step in range(STEPS)]


def filled_store(spark: SparkSession, sf_dir: str, order=range(STEPS), after=None) -> EventStore:
    """A store that has taken the parts in the given order, each as files of JSON lines."""
    folder = scratch_dir(spark)
    parts, store = parts_by_time(spark, sf_dir), EventStore(spark, f"{folder}/store", batch.HOUR)
    for step in order:
        write_json_events(parts[step], f"{folder}/spool/step={step}")
        while store.ingest(f"{folder}/spool", 500) is not None:
            pass
        if after is not None:
            after(store, folder)
    return store


def stored_events(spark, sf_dir):
    return batch.plain(filled_store(spark, sf_dir).events().drop("file"))


def stored_detections(spark, sf_dir):
    """From the counts of a store whose batches have been folded."""
    store = filled_store(spark, sf_dir)
    store.fold()
    return batch.plain(store.detect_all(batch.MAX_EVENTS, batch.MAX_RATIO, batch.MAX_CATEGORIES, batch.DAY))


def stored_detections_by_the_hour(spark, sf_dir):
    return batch.plain(filled_store(spark, sf_dir).detect_all(
        batch.MAX_EVENTS, batch.MAX_RATIO, batch.MAX_CATEGORIES, batch.DAY, batch.HOUR))


def followed_with_late_events(spark, sf_dir):
    """The middle of the time comes last: its windows are judged anew when all events are there."""
    tables = []

    def follow(store, folder):
        tables.append(f"{folder}/found")
        store.follow(tables[-1], batch.MAX_EVENTS, batch.MAX_RATIO, batch.MAX_CATEGORIES, WATERMARK, batch.DAY)

    filled_store(spark, sf_dir, (0, 2, 1), follow)
    return batch.plain(read_changes(spark, tables[-1], WINDOW_KEYS))


def spooled_events(spark, sf_dir):
    folder = scratch_dir(spark)
    write_json_events(batch.events(spark, sf_dir), f"{folder}/spool")
    return finish(spark, parse_events(read_spool_events(spark, f"{folder}/spool")), "append")


def rejects(spark, sf_dir):
    return finish(spark, rejected_events(batch.broken_lines(stream_table(spark, f"{sf_dir}/events.parquet"))),
                  "append")


QUERIES = {
    "stream_spooled_events": spooled_events,
    "stream_rejects": rejects,
    "store_events": stored_events,
    "store_detect_all": stored_detections,
    "store_detect_all_hourly": stored_detections_by_the_hour,
    "store_followed_late": followed_with_late_events,
    "stream_high_activity_complete": high_activity("complete"),
    "stream_high_activity_update": high_activity("update"),
    "stream_high_activity_append": high_activity("append"),
    "stream_high_activity_sliding": high_activity_sliding,
    "stream_high_activity_hourly": high_activity_by_the_hour,
    "stream_detect_all_hourly": all_detectors_by_the_hour,
    "stream_dedup_ips": each_ip_once,
    "stream_click_view_ratio": click_view_ratio("complete"),
    "stream_click_view_ratio_update": click_view_ratio("update"),
    "stream_click_view_ratio_merged": click_view_ratio_merged,
    "stream_click_view_ratio_sliding": click_view_ratio_sliding,
    "stream_category_spread_append": category_spread("append"),
    "stream_category_spread_update": category_spread("update"),
    "stream_category_spread_all_windows": category_spread_all_windows,
    "stream_detect_all": detect_all_stream,
    "stream_detect_all_early": detect_all_before_the_watermark,
    "stream_combined_blocklist": combined,
    "stream_blocklist_table": blocked,
    "stream_blocklist_keyed": blocked_in_keyed_table,
    "stream_blocklist_changes": blocklist_changes,
    "stream_blocklist_replayed": blocked_by_change_log,
    "stream_blocklist_short_ttl": blocked_for_a_short_time,
    "stream_blocklist_after_expiry": blocked_after_expiry,
    "stream_combined_blocklist_early": blocked_early,
}
