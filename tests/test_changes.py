"""The blocklist as keyed state: its changes, replayed, against the entries at any moment."""

import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from clickwarden import active_blocklist, parse_events
from clickwarden.sinks import parquet_sink, read_appended
from clickwarden.sources import read_spool_events
from clickwarden.streaming import AVAILABLE_NOW, STATE_STORE, block_changes, blocked_by_changes, run_stream
from tests.data import add_batch, line

START = 1704067200


def entries_of(events):
    """Each event an entry that lasts as many seconds as its category says."""
    lasts = F.col("category_id").cast("int")
    return events.select("ip", F.col("timestamp").alias("blocked_at"),
                         F.timestamp_seconds(F.unix_seconds("timestamp") + lasts).alias("expires_at"), "timestamp")


def run(spark, folder, batches, delay="10 seconds"):
    """One start of the query for each batch; the changes of all and the rows of state after each."""
    held, result = [], None
    for number, rows in enumerate(batches):
        add_batch(folder / "spool", number, [line(ip, lasts, "click", START + at) for ip, at, lasts in rows])
        events = parse_events(read_spool_events(spark, str(folder / "spool"), max_files_per_trigger=1))
        result = block_changes(entries_of(events.withWatermark("timestamp", delay)))
        query = run_stream(result, parquet_sink(str(folder / "table")), str(folder / "checkpoint"), trigger=AVAILABLE_NOW,
                           settings=STATE_STORE)
        held.append(sum(state["numRowsTotal"] for state in query.lastProgress["stateOperators"]))
    return read_appended(spark, str(folder / "table"), result.schema), held


def told(changes):
    return sorted((row["ip"], int(row["at"].timestamp()) - START if row["at"].tzinfo else
                   int(row["at"].replace(tzinfo=timezone.utc).timestamp()) - START, row["action"]) for row in changes.collect())


def utc(second):
    return datetime.fromtimestamp(START + second, timezone.utc).strftime("%Y-%m-%d %H:%M:%S UTC")


def test_blocks_extensions_and_timers(spark, tmp_path):
    changes, held = run(spark, tmp_path, [
        [("a", 0, 100), ("b", 5, 20), ("b", 25, 20), ("b", 30, 1)],  # b begins again where it ends, and then adds nothing
        [("a", 50, 100), ("c", 60, 10)],
        [("a", 300, 10), ("b", 70, 1000)],  # both after their blocks have ended
        [("z", 2000, 1)],
        [("z", 4000, 1)],
    ])
    assert told(changes) == [
        ("a", 0, "block"), ("a", 50, "extend"), ("a", 150, "unblock"), ("a", 300, "block"), ("a", 310, "unblock"),
        ("b", 5, "block"), ("b", 25, "extend"), ("b", 45, "unblock"), ("b", 70, "block"), ("b", 1070, "unblock"),
        ("c", 60, "block"), ("c", 70, "unblock"), ("z", 2000, "block"), ("z", 2001, "unblock"), ("z", 4000, "block")]
    assert held[-1] < held[0] + 3  # only z is left


@pytest.mark.parametrize("seed", [1, 2])
def test_replayed_at_any_moment(spark, tmp_path, seed):
    """Rows come out of order by up to two minutes, some of them too late for the watermark of this query."""
    rng = random.Random(seed)
    rows = [(rng.choice("abcde"), at, rng.choice([1, 30, 60, 200])) for at in range(0, 1200, 7)]
    rows.sort(key=lambda row: row[1] + rng.choice([0, 0, 60, 120]))
    parts = [rows[first:first + 40] for first in range(0, len(rows), 40)] + [[("z", 5000, 1)]]
    changes, _ = run(spark, tmp_path, parts, "5 minutes")
    assert changes.where("action = 'unblock'").count() > 5
    known = spark.createDataFrame([(ip, START + at, START + at + lasts) for ip, at, lasts in rows], "ip string, s long, e long").select(
        "ip", F.timestamp_seconds("s").alias("blocked_at"), F.timestamp_seconds("e").alias("expires_at"))
    for moment in range(0, 1500, 131):
        wanted = active_blocklist(known, utc(moment)).select("ip", "expires_at")
        found = blocked_by_changes(changes.union(changes), utc(moment))
        assert sorted(map(str, found.collect())) == sorted(map(str, wanted.collect()))


def test_unusable_entries_and_batches(spark, tmp_path):
    folder = tmp_path / "spool"
    add_batch(folder, 0, [line("a", 5, "click", START), line("b", "no number", "click", START)])
    events = parse_events(read_spool_events(spark, str(folder)))
    lasts = F.col("category_id").try_cast("int")
    entries = events.withWatermark("timestamp", "1 second").select(
        "ip", F.col("timestamp").alias("blocked_at"), F.timestamp_seconds(F.unix_seconds("timestamp") + lasts).alias("expires_at"), "timestamp")
    result = block_changes(entries)
    run_stream(result, parquet_sink(str(tmp_path / "t")), str(tmp_path / "c"), trigger=AVAILABLE_NOW, settings=STATE_STORE)
    assert [row[0] for row in told(read_appended(spark, str(tmp_path / "t"), result.schema))] == ["a"]
    with pytest.raises(ValueError, match="stream"):
        block_changes(spark.createDataFrame([], "ip string, blocked_at timestamp, expires_at timestamp"))


def test_settings_are_for_one_query(spark, tmp_path):
    key = next(iter(STATE_STORE))
    before = spark.conf.get(key)
    test_unusable_entries_and_batches(spark, tmp_path)
    assert spark.conf.get(key) == before != STATE_STORE[key]
