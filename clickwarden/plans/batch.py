"""Registered batch queries over the `events` table.

The table is sparse next to real ad traffic (a handful of events per user and day), so windows are
days and limits are low enough for each detector to find something.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from clickwarden.functions import (
    events_from_table, filter_actions, parse_events, rejected_events, rejected_rows, to_json_lines, to_kafka_value)
from clickwarden.functions.times import as_instant, as_wall_clock
from clickwarden.operators import (
    action_counts_per_window, active_blocklist, blocklist, category_dictionary, category_window_pairs, category_words, combine_detections,
    count_per_window, detect_all, detect_category_spread, detect_click_view_ratio, detect_high_activity,
    distinct_categories_per_window, exclude_ips, flagged_ips, preview, union_detections)
from clickwarden.session import scratch_dir
from clickwarden.sinks import write_json_events
from clickwarden.sources import read_json_events

DAY = "1 day"
TWO_DAYS = "2 days"
# A day every hour: 24 windows to a pane.
HOUR = "1 hour"
MAX_EVENTS = 5
MAX_EVENTS_SLIDING = 8
MAX_RATIO = 1
MAX_CATEGORIES = 5
MAX_CATEGORIES_SLIDING = 8
MAX_PAIRS = 70
TTL_SECONDS = 3 * 24 * 3600
# Shorter than the streams' watermark delay.
SHORT_TTL_SECONDS = 1800
# Just after the watermark has passed the end of a day.
SHORT_AS_OF = "2024-01-15 01:10:00"
AS_OF = "2024-01-15 12:00:00"
# Not before any entry.
LAST_AS_OF = "2024-01-31 12:00:00"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_from_table(spark.read.parquet(f"{sf_dir}/events.parquet"))


def plain(df: DataFrame) -> DataFrame:
    """The window as two columns, instants as UTC wall-clock time, lists as text; no `event_time`."""
    if "window" in df.columns:
        others = [name for name in df.columns if name not in ("ip", "window")]
        df = df.select("ip", F.col("window.start").alias("window_start"),
                       F.col("window.end").alias("window_end"), *others)
    columns = []
    for field in df.drop("event_time").schema:
        kind = field.dataType.typeName()
        if kind == "timestamp":
            columns.append(as_wall_clock(df, field.name).alias(field.name))
        elif kind == "array":
            columns.append(F.concat_ws(",", field.name).alias(field.name))
        else:
            columns.append(F.col(field.name))
    return df.select(columns)


def parse_json_events(spark, sf_dir):
    lines = to_json_lines(events(spark, sf_dir))
    return plain(parse_events(lines.select(F.col("value").cast("binary").alias("value"))))


def broken_lines(table: DataFrame) -> DataFrame:
    """JSON lines of which three event types are spoilt: cut short, without ip, with half a second."""
    modelled = events_from_table(table)
    seconds = F.unix_seconds(as_instant(modelled, "timestamp")).cast("string")
    kind = F.col("type")
    fields = F.struct(
        F.when(kind == "purchase", F.concat(seconds, F.lit(".5"))).otherwise(seconds).alias("unix_time"),
        "category_id", F.when(kind != "signup", F.col("ip")).alias("ip"), "type")
    line = F.to_json(fields)
    return modelled.select(F.when(kind == "error", F.rtrim(line, F.lit("}"))).otherwise(line).alias("value"))


def reject_bad_events(spark, sf_dir):
    return rejected_events(broken_lines(spark.read.parquet(f"{sf_dir}/events.parquet")))


def read_json_files(spark, sf_dir):
    path = scratch_dir(spark)
    write_json_events(events(spark, sf_dir), path)
    return plain(read_json_events(spark, path))


def filter_clicks_and_views(spark, sf_dir):
    return filter_actions(events(spark, sf_dir), "click", "view")


def counts(spark, sf_dir):
    return plain(count_per_window(events(spark, sf_dir), DAY))


def action_counts(spark, sf_dir):
    return plain(action_counts_per_window(events(spark, sf_dir), DAY))


def category_pairs(spark, sf_dir):
    return plain(category_window_pairs(events(spark, sf_dir), DAY))


def category_counts(spark, sf_dir):
    return plain(distinct_categories_per_window(events(spark, sf_dir), TWO_DAYS, DAY))


def counts_by_the_hour(spark, sf_dir):
    return plain(count_per_window(events(spark, sf_dir), DAY, HOUR))


def categories_by_the_hour(spark, sf_dir):
    """From bits merged over panes; a third of the categories get their codes from a dictionary, the others keep their names."""
    table = events(spark, sf_dir)
    folder = scratch_dir(spark)
    category_dictionary(table.filter(F.col("category_id").cast("int") % 3 == 0)).write.parquet(folder)
    words = category_words(table, DAY, HOUR, dictionary=spark.read.parquet(folder))
    return plain(words.groupBy("ip", "window").agg(F.sum(F.bit_count("bits")).alias("n_categories")))


def high_activity_by_the_hour(spark, sf_dir):
    return plain(detect_high_activity(events(spark, sf_dir), MAX_EVENTS, DAY, HOUR))


def click_view_ratio_by_the_hour(spark, sf_dir):
    return plain(detect_click_view_ratio(events(spark, sf_dir), MAX_RATIO, DAY, HOUR))


def category_spread_by_the_hour(spark, sf_dir):
    return plain(detect_category_spread(events(spark, sf_dir), MAX_CATEGORIES, DAY, HOUR))


def all_detectors_by_the_hour(spark, sf_dir):
    return plain(detect_all(events(spark, sf_dir), MAX_EVENTS, MAX_RATIO, MAX_CATEGORIES, DAY, HOUR))


def high_activity(spark, sf_dir):
    return plain(detect_high_activity(events(spark, sf_dir), MAX_EVENTS, DAY))


def high_activity_sliding(spark, sf_dir):
    return plain(detect_high_activity(events(spark, sf_dir), MAX_EVENTS_SLIDING, TWO_DAYS, DAY))


def click_view_ratio_one(spark, sf_dir):
    return plain(detect_click_view_ratio(events(spark, sf_dir), MAX_RATIO, DAY))


def click_view_ratio_drop(spark, sf_dir):
    return plain(detect_click_view_ratio(events(spark, sf_dir), MAX_RATIO, DAY, missing_views="drop"))


def click_view_ratio_sliding(spark, sf_dir):
    return plain(detect_click_view_ratio(events(spark, sf_dir), MAX_RATIO, TWO_DAYS, DAY, missing_views="drop"))


def category_spread(spark, sf_dir):
    return plain(detect_category_spread(events(spark, sf_dir), MAX_CATEGORIES, DAY))


def category_spread_sliding(spark, sf_dir):
    return plain(detect_category_spread(events(spark, sf_dir), MAX_CATEGORIES_SLIDING, TWO_DAYS, DAY))


def category_spread_all_windows(spark, sf_dir):
    return plain(detect_category_spread(events(spark, sf_dir), MAX_PAIRS, DAY, scope="all_windows"))


def all_detectors(spark, sf_dir):
    return plain(found_by_all(spark, sf_dir))


def found_by_all(spark, sf_dir):
    """One scan for the three detectors."""
    return detect_all(events(spark, sf_dir), MAX_EVENTS, MAX_RATIO, MAX_CATEGORIES, DAY)


def detections_union(spark, sf_dir):
    return plain(union_detections(found_by_all(spark, sf_dir)))


def combined_blocklist(spark, sf_dir):
    return plain(combine_detections(found_by_all(spark, sf_dir), window_duration=TWO_DAYS))


def entries(spark, sf_dir):
    return blocklist(combine_detections(found_by_all(spark, sf_dir), window_duration=DAY), TTL_SECONDS)


def blocklist_with_expiry(spark, sf_dir):
    return plain(entries(spark, sf_dir))


def blocked_now(spark, sf_dir):
    return plain(active_blocklist(entries(spark, sf_dir), AS_OF))


def exclude_known_ips(spark, sf_dir):
    known = detect_category_spread(events(spark, sf_dir), MAX_PAIRS, DAY, scope="all_windows")
    return plain(exclude_ips(detect_high_activity(events(spark, sf_dir), MAX_EVENTS, DAY), known))


def flagged(spark, sf_dir):
    return flagged_ips(detect_high_activity(events(spark, sf_dir), MAX_EVENTS, DAY))


def preview_categories(spark, sf_dir):
    widest = distinct_categories_per_window(events(spark, sf_dir), DAY).orderBy(
        F.desc("n_categories"), "ip", "window.start")
    return plain(preview(widest))


def gappy_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table with some users, times and properties missing."""
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    return table.select(
        F.when(F.col("user_id") % 7 != 3, F.col("user_id")).alias("user_id"),
        F.when(F.col("event_type") != "error", F.col("ts")).alias("ts"), "event_type",
        F.when(F.col("user_id") % 3 != 1, F.col("props")).alias("props"))


def missing_keys(spark, sf_dir):
    return plain(distinct_categories_per_window(events_from_table(gappy_table(spark, sf_dir)), DAY))


def rejected_table_rows(spark, sf_dir):
    return rejected_rows(gappy_table(spark, sf_dir)).groupBy("event_type", "reject_reason").agg(
        F.count(F.lit(1)).alias("n"))


def kafka_messages(spark, sf_dir):
    found = detect_click_view_ratio(events(spark, sf_dir), MAX_RATIO, DAY)
    return to_kafka_value(found.select("ip", "reason", "clicks", "views"))


QUERIES = {
    "parse_json_events": parse_json_events,
    "reject_bad_events": reject_bad_events,
    "read_json_files": read_json_files,
    "filter_clicks_and_views": filter_clicks_and_views,
    "count_per_window": counts,
    "action_counts_per_window": action_counts,
    "category_window_pairs": category_pairs,
    "distinct_categories_per_window": category_counts,
    "count_per_window_hourly": counts_by_the_hour,
    "distinct_categories_hourly": categories_by_the_hour,
    "high_activity_hourly": high_activity_by_the_hour,
    "click_view_ratio_hourly": click_view_ratio_by_the_hour,
    "category_spread_hourly": category_spread_by_the_hour,
    "detect_all_hourly": all_detectors_by_the_hour,
    "high_activity_tumbling": high_activity,
    "high_activity_sliding": high_activity_sliding,
    "click_view_ratio_one": click_view_ratio_one,
    "click_view_ratio_drop": click_view_ratio_drop,
    "click_view_ratio_sliding": click_view_ratio_sliding,
    "category_spread_per_window": category_spread,
    "category_spread_sliding": category_spread_sliding,
    "category_spread_all_windows": category_spread_all_windows,
    "detect_all": all_detectors,
    "detections_union": detections_union,
    "combined_blocklist": combined_blocklist,
    "blocklist_with_expiry": blocklist_with_expiry,
    "active_blocklist": blocked_now,
    "exclude_ips": exclude_known_ips,
    "flagged_ips": flagged,
    "preview": preview_categories,
    "kafka_messages": kafka_messages,
    "missing_keys": missing_keys,
    "rejected_table_rows": rejected_table_rows,
}
