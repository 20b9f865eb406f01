"""Events for the tests."""

from __future__ import annotations

import json
import os
from datetime import datetime, timedelta

from clickwarden.sources import read_spool_events

# The bot, its start, and below the categories and clicks of the fixture.
BOT = "172.20.0.51"
START = 1540559093
SCHEMA = "ip string, category_id string, type string, timestamp timestamp"
MIDNIGHT = datetime(2024, 1, 1)


def line(ip, category_id, kind, unix_time=START):
    return json.dumps({"unix_time": unix_time, "category_id": category_id, "ip": ip, "type": kind})


def bot_lines(extra_clicks, extra_time):
    """One bot over eight categories, clicking and viewing in turn, then clicking on and on."""
    kinds = ["click", "view"] * 4
    listed = ["   " + line(BOT, 1001 + i, kind, START + 2) for i, kind in enumerate(kinds)]
    return listed + [line(BOT, 1007, "click", extra_time)] * extra_clicks


def many_users():
    """1015 events: six users with one click each, a view by the first of them, and the bot."""
    users = [line(f"172.10.0.{51 + i}", 1000 + i, "click") for i in range(6)]
    return users + [line("172.10.0.51", 1000, "view")] + bot_lines(1000, START + 3)


def one_user():
    """1010 events: one user with a click and a view, and the bot."""
    return [line("172.10.0.51", 1000, "click"), line("172.10.0.51", 1000, "view")] + bot_lines(1000, START + 2)


def at(**offset):
    return MIDNIGHT + timedelta(**offset)


def frame(spark, rows):
    """Events from (ip, category_id, type, time) rows; the time is UTC wall-clock time."""
    ntz = SCHEMA.replace("timestamp timestamp", "timestamp timestamp_ntz")
    return spark.createDataFrame(rows, ntz)


def ips(df):
    return sorted(row.ip for row in df.select("ip").collect())


def stream_from_batches(spark, folder, *batches):
    """JSON lines as a stream with one micro-batch per given batch."""
    for number, lines in enumerate(batches):
        add_batch(folder, number, lines)
    return read_spool_events(spark, str(folder), max_files_per_trigger=1)


def add_batch(folder, number, lines):
    folder.mkdir(parents=True, exist_ok=True)
    path = folder / f"batch{number:03d}.json"
    path.write_text("\n".join(lines))
    os.utime(path, (1700000000 + number, 1700000000 + number))
