"""From detections to a list of blocked ips whose entries expire."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from clickwarden.defaults import COMBINE_WINDOW, PREVIEW_ROWS, TTL_SECONDS
from clickwarden.functions.times import event_window, plus_seconds


def union_detections(*detections: DataFrame) -> DataFrame:
    """All detections of several detectors, none dropped, one row per reason."""
    if not detections:
        raise ValueError("at least one frame of detections is needed")
    return reduce(DataFrame.unionByName, [
        found.select("ip", "window_start", "window_end", "event_time",
                     F.explode("reasons").alias("reason") if "reasons" in found.columns else F.col("reason"))
        for found in detections])


def combine_detections(*detections: DataFrame, window_duration: str = COMBINE_WINDOW) -> DataFrame:
    """One row per ip and tumbling window over the detections: how many, and for which reasons.

    The reasons of a group are a set of as many names as there are detectors.
    """
    window = event_window("event_time", window_duration)
    combined = union_detections(*detections).groupBy("ip", window).agg(
        F.count(F.lit(1)).alias("n_detections"), F.array_sort(F.collect_set("reason")).alias("reasons"))
    return combined.select(
        "ip", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
        F.window_time("window").alias("event_time"), "n_detections", "reasons")


def first_of_each_ip(rows: DataFrame, hold: str, time_col: str = "timestamp") -> DataFrame:
    """One row for each ip, on a stream in append mode as soon as the ip is first seen.

    For alarms that should not be repeated, on events or on detections that carry no watermark yet. A stream keeps an ip until the watermark, which
    runs `hold` behind the latest row, has come `hold` past the ip's first row; after that the ip may come
    again, so state holds the ips of twice that time at most. Which of an ip's rows of one micro-batch is kept is not
    said. A batch gives the earliest row of each ip, as a stream does that holds longer than the batch lasts.
    """
    if rows.isStreaming:
        return rows.withWatermark(time_col, hold).dropDuplicatesWithinWatermark(["ip"])
    others = [name for name in rows.columns if name != "ip"]
    first = rows.groupBy("ip").agg(F.min_by(F.struct(*others), F.struct(time_col, *others)).alias("row"))
    return first.select("ip", "row.*").select(*rows.columns)


def blocklist(detections: DataFrame, ttl_seconds: int = TTL_SECONDS, delay_seconds: int = 0,
              early: bool = False) -> DataFrame:
    """Entries `ip, blocked_at, expires_at` and the reasons.

    An entry starts where its window ends and lasts `ttl_seconds` from when it can be known. In append
    mode that is only once events `delay_seconds` past the window's end have come: give the
    watermark's delay. `early` entries, of update mode, are known within the window and start with it. Both
    times come from the events, so writing an entry again changes nothing.
    """
    reasons = F.col("reasons") if "reasons" in detections.columns else F.array("reason").alias("reasons")
    if "flagged" in detections.columns:
        detections = detections.filter("flagged")
    return detections.select(
        "ip", F.col("window_start" if early else "window_end").alias("blocked_at"),
        plus_seconds(detections, "window_end", delay_seconds + ttl_seconds).alias("expires_at"), reasons)


def active_blocklist(entries: DataFrame, as_of) -> DataFrame:
    """The ips blocked at `as_of`, each once, with the time its last running entry expires."""
    moment = as_of if isinstance(as_of, Column) else F.lit(as_of).cast(entries.schema["expires_at"].dataType)
    running = entries.filter((F.col("blocked_at") <= moment) & (F.col("expires_at") > moment))
    return running.groupBy("ip").agg(
        F.min("blocked_at").alias("blocked_at"), F.max("expires_at").alias("expires_at"))


def exclude_ips(df: DataFrame, ips: DataFrame | Iterable[str]) -> DataFrame:
    """`df` without the given ips: a few names, or a frame with a column `ip`.

    A frame is anti-joined without a hint: Spark broadcasts it only while its size is below
    `spark.sql.autoBroadcastJoinThreshold`.
    """
    if isinstance(ips, DataFrame):
        return df.join(ips.select("ip"), "ip", "left_anti")
    names = [ips] if isinstance(ips, str) else list(ips)
    return df.filter(F.col("ip").isNull() | ~F.col("ip").isin(names)) if names else df


def preview(df: DataFrame, n: int = PREVIEW_ROWS) -> DataFrame:
    """At most `n` rows, for looking at."""
    return df.limit(n)
