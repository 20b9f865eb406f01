"""Activity per ip and event-time window: the aggregations under the detectors.

Each takes a batch or streaming frame of events. `slide_duration` makes the windows slide;
`watermark_delay` bounds a stream's state and lets it run in append mode. Sliding windows are put together from panes
(see `panes`) on batches, and on streams that run in append mode; Spark refuses the second aggregation this takes
in update and complete mode, where each event is repeated for its windows instead.

A bot may be a third of all rows. Every shuffle here therefore follows a map-side partial
aggregation, or (early category results on streams) a salted de-duplication, so that a hot ip
costs each reducer one row per map task, not its raw events.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from clickwarden.defaults import CLICK, VIEW, WINDOW
from clickwarden.functions.events import filter_actions
from clickwarden.functions.times import event_window
from clickwarden.operators.pane_state import windows_from_state
from clickwarden.operators.panes import WORD_BITS, category_bits, in_windows, pane_seconds, window_runs

# Codes that a row of state has a bit for: 64 KB at most.
MOST_CODES = 1 << 19

OUTPUT_MODES = ("append", "update", "complete")

# Over how many reducers the copies of one (ip, category, window) are spread on a stream, and by what.
DEDUP_SALTS = 16
SALT_BY = ("timestamp", "type")


# Counts by name, as SQL.
EVENT_COUNT = {"n_events": "count(1)"}
ACTION_COUNTS = {"clicks": f"count_if(type = '{CLICK}')", "views": f"count_if(type = '{VIEW}')"}


def with_window(events: DataFrame, window_duration: str = WINDOW, slide_duration: str | None = None,
                watermark_delay: str | None = None) -> DataFrame:
    """Events with the `window` they fall into; a sliding window repeats the event."""
    if watermark_delay and events.isStreaming:
        events = events.withWatermark("timestamp", watermark_delay)
    return events.withColumn("window", event_window("timestamp", window_duration, slide_duration))


def by_panes(events: DataFrame, window_duration: str, slide_duration: str | None, mode: str | None = None) -> bool:
    """Whether the windows can be put together from panes; `mode` is the output mode of a stream, None if it may be any."""
    return pane_seconds(window_duration, slide_duration) is not None and (not events.isStreaming or mode == "append")


def with_pane(events: DataFrame, window_duration: str, slide_duration: str, watermark_delay: str | None = None) -> DataFrame:
    """Events with the pane of the sliding windows they fall into, as `window`."""
    return with_window(events, f"{pane_seconds(window_duration, slide_duration)} seconds", None, watermark_delay)


def _summed(events: DataFrame, counts: dict[str, str], window_duration: str, slide_duration: str | None,
            watermark_delay: str | None, mode: str | None) -> DataFrame:
    """(ip, window, counts), through panes where that can be."""
    tallies = [F.expr(count).alias(name) for name, count in counts.items()]
    if not by_panes(events, window_duration, slide_duration, mode):
        windowed = with_window(events, window_duration, slide_duration, watermark_delay)
        return windowed.groupBy("ip", "window").agg(*tallies)
    panes = with_pane(events, window_duration, slide_duration, watermark_delay).groupBy("ip", "window").agg(*tallies)
    return in_windows(panes, window_duration, slide_duration).groupBy("ip", "window").agg(
        *[F.sum(name).alias(name) for name in counts])


def count_per_window(events: DataFrame, window_duration: str = WINDOW, slide_duration: str | None = None,
                     watermark_delay: str | None = None, mode: str | None = None) -> DataFrame:
    """(ip, window, n_events): all events, whatever their type. `mode` is the output mode a stream will run in, if known."""
    return _summed(events, EVENT_COUNT, window_duration, slide_duration, watermark_delay, mode)


def action_counts_per_window(events: DataFrame, window_duration: str = WINDOW, slide_duration: str | None = None,
                             watermark_delay: str | None = None, mode: str | None = None) -> DataFrame:
    """(ip, window, clicks, views) where there is a click or a view; other types do not count.

    One aggregation for both counts, not a join of two: a join shuffles twice, and on a stream it
    waits for the quieter side. A batch filters the types in the scan. A stream filters
    after counting, since a filter pushed below the watermark would let it advance on clicks and
    views only.
    """
    if not events.isStreaming:
        events = filter_actions(events, CLICK, VIEW)
    counts = _summed(events, ACTION_COUNTS, window_duration, slide_duration, watermark_delay, mode)
    return counts.filter("clicks > 0 or views > 0") if events.isStreaming else counts


def category_window_pairs(events: DataFrame, window_duration: str = WINDOW, slide_duration: str | None = None,
                          watermark_delay: str | None = None, salts: int = DEDUP_SALTS,
                          salt_by: Iterable[str] = SALT_BY) -> DataFrame:
    """The distinct (ip, category_id, window); an event without a category counts as one category.

    `salts` and `salt_by` matter to streams only. A cluster of many cores wants as many salts as it has cores
    for a hot ip. `salt_by` names columns that tell events apart and that a replay repeats: the default cannot
    tell those of one second and type apart, a Kafka offset or a file's name and line
    (`parse_events(keep=...)`) can.
    """
    windowed = with_window(events, window_duration, slide_duration, watermark_delay)
    if not events.isStreaming:
        return windowed.select("ip", "category_id", "window").distinct()
    # A streaming distinct has no map-side step: the copies of a hot pair would meet in one task.
    # The first round spreads them by the rest of the event, the second sees few rows per pair.
    salt = F.pmod(F.xxhash64(*salt_by), F.lit(salts))
    salted = windowed.select("ip", "category_id", "window", salt.alias("salt")).distinct()
    return salted.select("ip", "category_id", "window").distinct()


def category_pair_counts(events: DataFrame, window_duration: str = WINDOW, slide_duration: str | None = None,
                         watermark_delay: str | None = None) -> DataFrame:
    """(ip, window, category_id, n_events, clicks, views): the finest grouping any detector needs."""
    windowed = with_window(events, window_duration, slide_duration, watermark_delay)
    return windowed.groupBy("ip", "window", "category_id").agg(
        *[F.expr(count).alias(name) for name, count in {**EVENT_COUNT, **ACTION_COUNTS}.items()])


def category_words(events: DataFrame, window_duration: str, slide_duration: str, watermark_delay: str | None = None,
                   counts: dict[str, str] | None = None, dictionary: DataFrame | None = None) -> DataFrame:
    """(ip, window, word, other, bits, counts): the categories of each sliding window as bits, from panes merged by OR.

    The different categories of a group are the `bit_count` of its bits; see `category_bits` for words and `dictionary`,
    a frame (category_id, code). A row of state is a word of 64 categories, so an ip and window has one for each 64
    of the dictionary at most. On streams, append mode only.
    """
    counts = counts or {}
    panes = _pane_words(events, window_duration, slide_duration, watermark_delay, counts, dictionary)
    return in_windows(panes, window_duration, slide_duration).groupBy("ip", "window", "word", "other").agg(
        F.bit_or("bits").alias("bits"), *[F.sum(name).alias(name) for name in counts])


def _pane_words(events: DataFrame, window_duration: str, slide_duration: str, watermark_delay: str | None,
                counts: dict[str, str], dictionary: DataFrame | None = None) -> DataFrame:
    """(ip, window, word, other, bits, counts), `window` being the pane."""
    paned = with_pane(events, window_duration, slide_duration, watermark_delay)
    if dictionary is not None:
        paned = paned.join(dictionary.select("category_id", "code"), "category_id", "left")
    return _by_words(paned, counts, dictionary is not None)


def _by_words(windowed: DataFrame, counts: dict[str, str], dictionary: bool = False) -> DataFrame:
    return windowed.select("*", *category_bits(dictionary)).groupBy("ip", "window", "word", "other").agg(
        F.bit_or("bit").alias("bits"), *[F.expr(count).alias(name) for name, count in counts.items()])


def activity_early(events: DataFrame, dictionary: DataFrame, window_duration: str = WINDOW, slide_duration: str | None = None,
                   watermark_delay: str | None = None) -> DataFrame:
    """(ip, window, n_events, clicks, views, n_categories) from one aggregation, so that a stream can run in update or complete mode.

    `dictionary` is a table (category_id, code) whose codes are 0 and up, without many gaps: a row of state has a bit for each. Categories that are
    not in it, null among them, count as one.
    """
    last = dictionary.agg(F.max("code")).first()[0]
    if last is not None and not 0 <= last < MOST_CODES:
        raise ValueError(f"codes must be from 0 to {MOST_CODES - 1}, not {last}")
    words = range(0 if last is None else last // WORD_BITS + 1)
    coded = with_window(events, window_duration, slide_duration, watermark_delay).join(
        dictionary.select("category_id", "code"), "category_id", "left").select("*", *category_bits(dictionary=True))
    zero = F.lit(0).cast("bigint")
    counted = coded.groupBy("ip", "window").agg(
        *[F.expr(count).alias(name) for name, count in {**EVENT_COUNT, **ACTION_COUNTS}.items()],
        F.max(F.col("word").isNull().cast("bigint")).alias("others"),
        *[F.bit_or(F.when(F.col("word") == word, F.col("bit")).otherwise(zero)).alias(f"bits_{word}") for word in words])
    different = sum((F.bit_count(f"bits_{word}") for word in words), F.col("others"))
    return counted.select("ip", "window", *EVENT_COUNT, *ACTION_COUNTS, different.cast("bigint").alias("n_categories"))


def window_activity(events: DataFrame, window_duration: str, slide_duration: str, keep: Column,
                    sums: dict[str, str], categories: bool, watermark_delay: str | None = None,
                    above: dict[str, int] | None = None) -> DataFrame:
    """(ip, window, sums, n_categories if asked for) of the sliding windows for which `keep` holds, by running sums: over a batch,
    or over the panes that a stream in append mode keeps for each ip. `above` is as in `windows_from_state`, which takes it."""
    above = {name: 0 for name in (*sums, "n_categories")} if above is None else above
    if events.isStreaming and categories:
        panes = _pane_words(events, window_duration, slide_duration, watermark_delay, sums)
        return windows_from_state(panes, window_duration, slide_duration, list(sums), keep, above, words=True)
    by = ["category_id"] if categories else []
    panes = with_pane(events, window_duration, slide_duration, watermark_delay).groupBy("ip", "window", *by).agg(
        *[F.expr(count).alias(name) for name, count in (sums or EVENT_COUNT).items()])
    if events.isStreaming:
        return windows_from_state(panes, window_duration, slide_duration, list(sums), keep, above)
    return window_runs(panes, window_duration, slide_duration, list(sums), keep, by)


def distinct_categories_per_window(events: DataFrame, window_duration: str = WINDOW,
                                   slide_duration: str | None = None, watermark_delay: str | None = None,
                                   mode: str = "append", salts: int = DEDUP_SALTS,
                                   salt_by: Iterable[str] = SALT_BY) -> DataFrame:
    """(ip, window, n_categories), exact; `salts` and `salt_by` as in `category_window_pairs`.

    `mode` is the output mode a stream will run in; a batch ignores it. In append mode two
    aggregations are chained, so no state row ever holds a set. Spark refuses such a chain in update
    and complete mode, where counting over a streaming distinct takes its place.
    """
    if mode not in OUTPUT_MODES:
        raise ValueError(f"mode must be one of {OUTPUT_MODES}, not {mode!r}")
    if by_panes(events, window_duration, slide_duration, mode):
        return category_words(events, window_duration, slide_duration, watermark_delay).groupBy("ip", "window").agg(
            F.sum(F.bit_count("bits")).alias("n_categories"))
    if events.isStreaming and mode == "append":
        windowed = with_window(events, window_duration, slide_duration, watermark_delay)
        return _by_words(windowed, {}).groupBy("ip", "window").agg(F.sum(F.bit_count("bits")).alias("n_categories"))
    pairs = category_window_pairs(events, window_duration, slide_duration, watermark_delay, salts, salt_by)
    return pairs.groupBy("ip", "window").agg(F.count(F.lit(1)).alias("n_categories"))


def activity_per_window(events: DataFrame, window_duration: str = WINDOW, slide_duration: str | None = None,
                        watermark_delay: str | None = None) -> DataFrame:
    """(ip, window, n_events, clicks, views, n_categories) from one scan; on streams, append mode only.

    A stream keeps a row of state for each 64 categories of an ip and window (`category_bits`), not for each category.
    """
    counts = {**EVENT_COUNT, **ACTION_COUNTS}
    if by_panes(events, window_duration, slide_duration, "append"):
        words = category_words(events, window_duration, slide_duration, watermark_delay, counts)
    elif events.isStreaming:
        words = _by_words(with_window(events, window_duration, slide_duration, watermark_delay), counts)
    else:
        pairs = category_pair_counts(events, window_duration, slide_duration, watermark_delay)
        return pairs.groupBy("ip", "window").agg(
            *[F.sum(name).alias(name) for name in counts], F.count(F.lit(1)).alias("n_categories"))
    return words.groupBy("ip", "window").agg(
        *[F.sum(name).alias(name) for name in counts], F.sum(F.bit_count("bits")).alias("n_categories"))
