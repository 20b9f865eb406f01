"""Event time: windows, and moving between instants and UTC wall-clock values.

Tables may hold TIMESTAMP (an instant) or TIMESTAMP_NTZ (a wall-clock value). Batch operators take
either. Watermarks take only instants, so streams are converted, in UTC whatever zone the
session shows: casting would read the value in the session zone and trip over its clock changes.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F, types as T

# The seconds a TIMESTAMP can show: years 0001 to 9999.
FIRST_SECOND = -62135596800
LAST_SECOND = 253402300799


def event_window(timestamp, window_duration: str, slide_duration: str | None = None) -> Column:
    """Tumbling window, or sliding when `slide_duration` is given, aligned to the epoch."""
    return F.window(timestamp, window_duration, slide_duration)


def seconds_to_instant(seconds: Column) -> Column:
    """Epoch seconds, as text or number, to TIMESTAMP; NULL where that is not possible."""
    whole = seconds.try_cast("bigint")
    return F.when(whole.between(FIRST_SECOND, LAST_SECOND), F.timestamp_seconds(whole))


def wall_clock_to_instant(wall_clock: Column) -> Column:
    """TIMESTAMP_NTZ read as UTC."""
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    seconds = (wall_clock - epoch).cast(T.DayTimeIntervalType(3, 3)).cast("decimal(20,6)")
    return F.timestamp_micros((seconds * 1000000).cast("bigint"))


def instant_to_wall_clock(instant: Column) -> Column:
    """TIMESTAMP shown in UTC as TIMESTAMP_NTZ."""
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant), epoch)


def as_instant(df: DataFrame, name: str) -> Column:
    column = F.col(name)
    return wall_clock_to_instant(column) if is_wall_clock(df, name) else column


def as_wall_clock(df: DataFrame, name: str) -> Column:
    column = F.col(name)
    return column if is_wall_clock(df, name) else instant_to_wall_clock(column)


def plus_seconds(df: DataFrame, name: str, seconds: int) -> Column:
    """The column moved by exactly so many seconds, also across a clock change of the session zone."""
    column = F.col(name)
    if is_wall_clock(df, name):
        return column + F.make_dt_interval(secs=F.lit(seconds))
    return F.timestamp_micros(F.unix_micros(column) + F.lit(seconds * 1000000).cast("bigint"))


# Seconds of the units that windows and delays are given in.
UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}


def duration_seconds(duration: str) -> int:
    """Seconds of a duration such as `10 minutes` or `1 hour 30 minutes`."""
    parts = re.findall(r"(\d+)\s+([a-z]+?)s?\b", duration.lower())
    if not parts or any(unit not in UNITS for _, unit in parts):
        raise ValueError(f"not a duration of seconds to weeks: {duration!r}")
    return sum(int(number) * UNITS[unit] for number, unit in parts)


def is_wall_clock(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.TimestampNTZType)
