"""The detectors: which ips act like bots, and when.

All return `ip, window_start, window_end, event_time`, what the ip was flagged for, and the numbers
behind it. `event_time` is the last instant of the window; on a stream it carries the watermark, so
that detections can be windowed again. All limits are strict: a group equal to its limit passes.

`mode` is the output mode a stream will run in: naming "append" lets sliding windows be put together from panes. With many
windows to a pane, batches write out the flagged windows only (`panes.window_runs`), and streams in append mode take keyed
state (`pane_state.windows_from_state`), which needs the RocksDB state store.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from clickwarden.defaults import CLICK, MAX_CATEGORIES, MAX_EVENTS, MAX_RATIO, VIEW, WINDOW
from clickwarden.functions.events import filter_actions
from clickwarden.operators.counts import (
    ACTION_COUNTS, DEDUP_SALTS, EVENT_COUNT, SALT_BY, action_counts_per_window, activity_early, activity_per_window,
    category_window_pairs, count_per_window, distinct_categories_per_window, window_activity)
from clickwarden.operators.panes import RUNS_FROM, windows_of_a_pane

HIGH_ACTIVITY = "high_activity"
CLICK_VIEW_RATIO = "click_view_ratio"
CATEGORY_SPREAD = "category_spread"


def detect_high_activity(events: DataFrame, max_events: int = MAX_EVENTS, window_duration: str = WINDOW,
                         slide_duration: str | None = None, watermark_delay: str | None = None,
                         mode: str | None = None) -> DataFrame:
    """Ips with more than `max_events` events, of any type, in a window."""
    too_many = F.col("n_events") > _limit("max_events", max_events)
    if _in_runs(events, window_duration, slide_duration, mode):
        flagged = window_activity(events, window_duration, slide_duration, too_many, EVENT_COUNT, False, watermark_delay,
                                  {"n_events": max_events})
    else:
        flagged = count_per_window(events, window_duration, slide_duration, watermark_delay, mode).filter(too_many)
    return _detections(flagged, F.lit(HIGH_ACTIVITY).alias("reason"), "n_events")


def detect_click_view_ratio(events: DataFrame, max_ratio: int = MAX_RATIO, window_duration: str = WINDOW,
                            slide_duration: str | None = None, missing_views: str = "one",
                            watermark_delay: str | None = None, keep_passed: bool = False,
                            mode: str | None = None) -> DataFrame:
    """Ips whose clicks divided by views, rounded down, exceed `max_ratio` in a window.

    With `missing_views="one"` an ip without views is judged as if it had one; with `"drop"`, which
    is what joining clicks to views gives, it is never flagged. Later views can take a flag back, which a stream
    in update mode tells only if the groups that pass are sent too: `keep_passed` keeps them,
    with a column `flagged` by which `read_changes` leaves them out.
    """
    flagged = _too_many_clicks(max_ratio, missing_views)
    if _in_runs(events, window_duration, slide_duration, mode):
        # A stream counts all types, as a filter would be pushed below the watermark.
        acting = events if events.isStreaming else filter_actions(events, CLICK, VIEW)
        counts = window_activity(acting, window_duration, slide_duration, F.lit(True) if keep_passed else flagged,
                                 ACTION_COUNTS, False, watermark_delay, None if keep_passed else {"clicks": max_ratio})
    else:
        counts = action_counts_per_window(events, window_duration, slide_duration, watermark_delay, mode)
    counts = counts.withColumn("flagged", flagged) if keep_passed else counts.filter(flagged)
    return _detections(counts, F.lit(CLICK_VIEW_RATIO).alias("reason"), "clicks", "views",
                       F.expr("clicks div greatest(views, 1)").alias("ratio"), *["flagged"] * keep_passed)


def detect_category_spread(events: DataFrame, max_categories: int = MAX_CATEGORIES, window_duration: str = WINDOW,
                           slide_duration: str | None = None, scope: str = "per_window",
                           watermark_delay: str | None = None, mode: str = "append", salts: int = DEDUP_SALTS,
                           salt_by: Iterable[str] = SALT_BY) -> DataFrame:
    """Ips that touch more than `max_categories` categories.

    `scope="per_window"` counts the distinct categories within one window. `scope="all_windows"`
    counts distinct (category, window) pairs over the whole input, so that one category seen in six
    windows counts six; its window columns span the first to the last window of the ip, and on a
    stream it needs update or complete mode. `mode`, `salts` and `salt_by` are as in
    `distinct_categories_per_window`.
    """
    limit = _limit("max_categories", max_categories)
    reason = F.lit(CATEGORY_SPREAD).alias("reason")
    if scope == "per_window" and _in_runs(events, window_duration, slide_duration, mode):
        counts = window_activity(events, window_duration, slide_duration, F.col("n_categories") > limit, {}, True, watermark_delay,
                                 {"n_categories": max_categories})
        return _detections(counts, reason, "n_categories")
    if scope == "per_window":
        counts = distinct_categories_per_window(events, window_duration, slide_duration, watermark_delay, mode,
                                                salts, salt_by)
        return _detections(counts.filter(F.col("n_categories") > limit), reason, "n_categories")
    if scope != "all_windows":
        raise ValueError(f"scope must be 'per_window' or 'all_windows', not {scope!r}")
    pairs = category_window_pairs(events, window_duration, slide_duration, watermark_delay, salts, salt_by)
    spans = pairs.groupBy("ip").agg(
        F.min("window.start").alias("window_start"), F.max("window.end").alias("window_end"),
        F.max(F.window_time("window")).alias("event_time"), F.count(F.lit(1)).alias("n_pairs"))
    return spans.filter(F.col("n_pairs") > limit).select(
        "ip", "window_start", "window_end", "event_time", reason, "n_pairs")


def detect_all(events: DataFrame, max_events: int = MAX_EVENTS, max_ratio: int = MAX_RATIO,
               max_categories: int = MAX_CATEGORIES, window_duration: str = WINDOW,
               slide_duration: str | None = None, missing_views: str = "one",
               watermark_delay: str | None = None) -> DataFrame:
    """The three detectors over the same windows in one scan, with the list of `reasons`.

    One read and two shuffles, where running the detectors one by one takes three reads and four
    shuffles. On a stream it runs in append mode.
    """
    flagged = any_test(max_events, max_ratio, max_categories, missing_views)
    if _in_runs(events, window_duration, slide_duration, "append"):
        activity = window_activity(events, window_duration, slide_duration, flagged, {**EVENT_COUNT, **ACTION_COUNTS}, True,
                                   watermark_delay, {"n_events": max_events, "clicks": max_ratio, "n_categories": max_categories})
    else:
        activity = activity_per_window(events, window_duration, slide_duration, watermark_delay)
    return judge_activity(activity, max_events, max_ratio, max_categories, missing_views)


def detect_all_early(events: DataFrame, dictionary: DataFrame, max_events: int = MAX_EVENTS, max_ratio: int = MAX_RATIO,
                     max_categories: int = MAX_CATEGORIES, window_duration: str = WINDOW, slide_duration: str | None = None,
                     missing_views: str = "one", watermark_delay: str | None = None) -> DataFrame:
    """`detect_all` in update or complete mode, without waiting for the watermark, still with one read.

    Categories are counted by the `dictionary`, see `activity_early`. Groups that pass come too, with `flagged` false, since later
    views can take a flag back: `read_changes` and `blocklist` leave them out.
    """
    activity = activity_early(events, dictionary, window_duration, slide_duration, watermark_delay)
    return judge_activity(activity, max_events, max_ratio, max_categories, missing_views, keep_passed=True)


def judge_activity(activity: DataFrame, max_events: int = MAX_EVENTS, max_ratio: int = MAX_RATIO,
                   max_categories: int = MAX_CATEGORIES, missing_views: str = "one", keep_passed: bool = False) -> DataFrame:
    """The detections of `detect_all` among rows (ip, window, n_events, clicks, views, n_categories); `keep_passed` keeps
    those without a reason too, with a column `flagged`."""
    tests = _tests(max_events, max_ratio, max_categories, missing_views)
    reasons = F.array_compact(F.array(*[F.when(test, name) for name, test in tests.items()]))
    flagged = any_test(max_events, max_ratio, max_categories, missing_views)
    kept = activity.withColumn("flagged", flagged) if keep_passed else activity.filter(flagged)
    return _detections(kept, reasons.alias("reasons"), "n_events", "clicks", "views", "n_categories", *["flagged"] * keep_passed)


def _tests(max_events: int, max_ratio: int, max_categories: int, missing_views: str) -> dict[str, Column]:
    return {
        HIGH_ACTIVITY: F.col("n_events") > _limit("max_events", max_events),
        CLICK_VIEW_RATIO: _too_many_clicks(max_ratio, missing_views),
        CATEGORY_SPREAD: F.col("n_categories") > _limit("max_categories", max_categories),
    }


def any_test(*limits) -> Column:
    high, ratio, spread = _tests(*limits).values()
    return high | ratio | spread


def flagged_ips(detections: DataFrame) -> DataFrame:
    """Only the ip of each detection; an ip flagged in several windows comes several times."""
    return detections.select("ip")


def _too_many_clicks(max_ratio: int, missing_views: str) -> Column:
    if missing_views not in ("one", "drop"):
        raise ValueError(f"missing_views must be 'one' or 'drop', not {missing_views!r}")
    too_many = F.expr("clicks div greatest(views, 1)") > _limit("max_ratio", max_ratio)
    return too_many & (F.col("views") > 0) if missing_views == "drop" else too_many


def _in_runs(events: DataFrame, window_duration: str, slide_duration: str | None, mode: str | None) -> bool:
    return (not events.isStreaming or mode == "append") and windows_of_a_pane(window_duration, slide_duration) >= RUNS_FROM


def _detections(flagged: DataFrame, *columns) -> DataFrame:
    end = F.col("window.end")
    last = F.window_time("window") if flagged.isStreaming else end - F.make_dt_interval(secs=F.lit(0.000001))
    return flagged.select(
        "ip", F.col("window.start").alias("window_start"), end.alias("window_end"), last.alias("event_time"), *columns)


def _limit(name: str, value: int):
    if isinstance(value, bool) or not isinstance(value, int) or value < 0:
        raise ValueError(f"{name} must be a whole number of at least 0, not {value!r}")
    return F.lit(value)
