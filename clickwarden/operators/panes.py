"""Sliding windows put together from panes.

A pane is the longest stretch that divides both the window and its slide, so a window is a number of whole panes. Events are
counted once, in their pane; what is then repeated for each window a pane belongs to are the few rows of counts, not the
events. Batches with many windows to a pane need not even that: `window_runs` adds each pane where its windows begin and takes it
away behind the last, so that running sums give every window's count, and only windows that are asked for are written out.

Distinct categories merge over panes as bits: each category is a bit of a 64-bit word, and words are merged by OR.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from clickwarden.functions.times import as_instant, duration_seconds, event_window, instant_to_wall_clock, is_wall_clock

# From so many windows to a pane on, batches take running sums instead of repeating the pane.
RUNS_FROM = 8

WORD_BITS = 64


def pane_seconds(window_duration: str, slide_duration: str | None) -> int | None:
    """Seconds of a pane; None for tumbling windows, and where the durations are not whole seconds."""
    if slide_duration is None:
        return None
    try:
        window, slide = duration_seconds(window_duration), duration_seconds(slide_duration)
    except ValueError:
        return None
    return math.gcd(window, slide) if 0 < slide < window else None


def windows_of_a_pane(window_duration: str, slide_duration: str | None) -> int:
    if pane_seconds(window_duration, slide_duration) is None:
        return 1
    return math.ceil(duration_seconds(window_duration) / duration_seconds(slide_duration))


def in_windows(by_pane: DataFrame, window_duration: str, slide_duration: str) -> DataFrame:
    """The rows by pane, `window` being the pane, once for each sliding window the pane belongs to.

    Batches number the windows: Spark's own sliding `window` is one projection a window, which from a hundred or so on
    it can no longer compile. Streams need it, as it carries the watermark.
    """
    if by_pane.isStreaming:
        return by_pane.withColumn("window", event_window(F.window_time("window"), window_duration, slide_duration))
    placed, wall_clock = _placed(by_pane, window_duration, slide_duration)
    numbered = placed.withColumn("at", F.explode(F.sequence("first", "last")))
    return numbered.withColumn("window", _numbered_window(wall_clock, window_duration, slide_duration)).drop("first", "last", "at")


def first_window_end(timestamp: str, window_duration: str, slide_duration: str) -> Column:
    """The end of the first window that an event at an instant belongs to."""
    length, slide = duration_seconds(window_duration), duration_seconds(slide_duration)
    return F.timestamp_seconds((F.floor((F.floor(F.unix_micros(timestamp) / 1_000_000) - length) / slide) + 1) * slide + length)


def _placed(by_pane: DataFrame, window_duration: str, slide_duration: str) -> tuple[DataFrame, bool]:
    """With the numbers of the first and last window of each pane; whether the times are wall-clock values.

    Window k starts k slides after the epoch. The panes may be shorter than they need be.
    """
    length, slide = duration_seconds(window_duration), duration_seconds(slide_duration)
    starts = by_pane.withColumn("pane_start", F.col("window.start"))
    second = F.floor(F.unix_micros(as_instant(starts, "pane_start")) / 1_000_000)
    first = F.floor((second - length) / slide) + 1
    placed = starts.withColumns({"first": first.cast("bigint"), "last": F.floor(second / slide).cast("bigint")})
    return placed.drop("pane_start"), is_wall_clock(starts, "pane_start")


def _numbered_window(wall_clock: bool, window_duration: str, slide_duration: str) -> Column:
    slide = duration_seconds(slide_duration)
    start = F.timestamp_seconds(F.col("at") * slide)
    end = F.timestamp_seconds(F.col("at") * slide + duration_seconds(window_duration))
    if wall_clock:
        start, end = instant_to_wall_clock(start), instant_to_wall_clock(end)
    return F.struct(start.alias("start"), end.alias("end"))


def category_bits(dictionary: bool = False) -> list[Column]:
    """`word, other, bit`: where a category stands in the bits of its group.

    A category that is a whole number, or the column `code` of a dictionary that has been joined, is bit `code % 64` of word
    `code div 64`. Any other, and null, keeps a row of its own under its name, so counts are exact
    whatever the names are; only numbers, or a dictionary, make many categories share a row.
    """
    name, one = F.col("category_id"), F.lit(1).cast("bigint")
    number = F.col("code") if dictionary else F.when(name.rlike(r"^(0|[1-9][0-9]{0,17})$"), name.try_cast("bigint"))
    return [F.floor(number / WORD_BITS).cast("bigint").alias("word"), F.when(number.isNull(), name).alias("other"),
            F.coalesce(F.call_function("shiftleft", one, (number % WORD_BITS).cast("int")), one).alias("bit")]


def category_dictionary(events: DataFrame) -> DataFrame:
    """(category_id, code) of the categories of a batch, numbered by the tasks that find them. Write it to a table before it is
    used: codes differ from run to run."""
    names = events.select("category_id").where(F.col("category_id").isNotNull()).distinct()
    return names.withColumn("code", F.monotonically_increasing_id())


def window_runs(by_pane: DataFrame, window_duration: str, slide_duration: str, sums: Sequence[str], keep: Column,
                distinct_by: Sequence[str] = (), distinct_as: str = "n_categories") -> DataFrame:
    """(ip, window, sums) of the sliding windows for which `keep` holds; batches only.

    `by_pane` has rows (ip, window, ...) whose `window` is the pane. `sums` are added up; with `distinct_by`, rows are by those columns too,
    and `distinct_as` counts their different values in a window. Windows without rows are never there.

    Each row adds its counts at the first window of its pane and takes them away behind the last; a value of `distinct_by`
    does so at those windows that its pane before did not reach. An ip has two such steps a pane at most, however
    long the windows are, and its events are counted before any of it is shuffled.
    """
    placed, wall_clock = _placed(by_pane, window_duration, slide_duration)
    zero = F.lit(0).cast("bigint")
    counted = [*sums, distinct_as] if distinct_by else list(sums)

    def step(at: Column, sign: int, names: Sequence[str]) -> Column:
        return F.struct(at.alias("at"), *[
            ((F.lit(1) if name == distinct_as else F.col(name)) * sign).cast("bigint").alias(name) if name in names
            else zero.alias(name) for name in counted])

    steps = [step(F.col("first"), 1, sums), step(F.col("last") + 1, -1, sums)]
    if distinct_by:
        reached = F.lag("last").over(Window.partitionBy("ip", *distinct_by).orderBy("first", "last"))
        placed = placed.withColumn("fresh", F.greatest("first", reached + 1))
        steps += [step(F.col("fresh"), 1, [distinct_as]), step(F.col("last") + 1, -1, [distinct_as])]
    at_windows = placed.select("ip", F.inline(F.array(*steps))).groupBy("ip", "at").agg(
        *[F.sum(name).alias(name) for name in counted])
    order = Window.partitionBy("ip").orderBy("at")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = at_windows.select("ip", "at", F.lead("at").over(order).alias("until"),
                             *[F.sum(name).over(so_far).alias(name) for name in counted])
    any_row = F.greatest(zero, *[F.col(name) for name in counted]) > 0
    kept = runs.where(F.col("until").isNotNull() & any_row & keep)
    numbered = kept.select("ip", F.explode(F.sequence("at", F.col("until") - 1)).alias("at"), *counted)
    return numbered.select("ip", _numbered_window(wall_clock, window_duration, slide_duration).alias("window"), *counted)
