from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from clickwarden import (
    active_blocklist, blocklist, combine_detections, detect_all, detect_category_spread,
    detect_click_view_ratio, detect_high_activity, events_from_json_lines, exclude_ips, preview, union_detections)
from clickwarden.functions.times import instant_to_wall_clock
from tests.data import BOT, at, frame, ips, many_users

COLUMNS = "ip string, window_start timestamp_ntz, window_end timestamp_ntz, event_time timestamp_ntz, reason string"


def found(spark, *rows):
    """Detections (ip, end of its minute-long window in seconds, reason)."""
    return spark.createDataFrame(
        [(ip, at(seconds=end - 60), at(seconds=end), at(seconds=end) - timedelta(microseconds=1), reason)
         for ip, end, reason in rows], COLUMNS)


def detections(spark):
    events = events_from_json_lines(spark, many_users())
    return [detect_high_activity(events), detect_click_view_ratio(events), detect_category_spread(events)]


def test_union_keeps_every_detection(spark):
    parts = detections(spark)
    assert ips(union_detections(*parts)) == [BOT] * 3
    assert union_detections(parts[0], parts[0]).count() == 2


def test_combining_gives_one_row_per_ip_and_window(spark):
    row, = combine_detections(*detections(spark)).collect()
    assert (row.ip, row.n_detections) == (BOT, 3)
    assert row.reasons == ["category_spread", "click_view_ratio", "high_activity"]


def test_the_one_pass_detector_combines_to_the_same(spark):
    events = events_from_json_lines(spark, many_users())
    assert combine_detections(detect_all(events)).collect() == combine_detections(*detections(spark)).collect()


def test_a_detection_belongs_to_the_window_its_end_closes(spark):
    rows = found(spark, ("a", 60, "x"), ("a", 90, "x"), ("a", 120, "y"), ("b", 120, "y"))
    combined = combine_detections(rows).orderBy("ip", "window_start").collect()
    assert [(r.ip, r.window_end, r.n_detections, r.reasons) for r in combined] == [
        ("a", at(seconds=60), 1, ["x"]), ("a", at(seconds=120), 2, ["x", "y"]), ("b", at(seconds=120), 1, ["y"])]


def test_at_least_one_frame():
    with pytest.raises(ValueError):
        combine_detections()


def test_entries_expire_from_their_window_end(spark):
    rows = found(spark, ("a", 60, "x"))
    row, = blocklist(rows).collect()
    assert (row.blocked_at, row.expires_at, row.reasons) == (at(seconds=60), at(seconds=120), ["x"])
    row, = blocklist(combine_detections(rows), ttl_seconds=7 * 86400).collect()
    assert row.expires_at == at(days=7, seconds=60)


def test_same_expiry_for_instants(spark):
    rows = found(spark, ("a", 60, "x"))
    instants = rows.select("ip", F.col("window_end").cast("timestamp"), "reason")
    row, = blocklist(instants).select(instant_to_wall_clock(F.col("expires_at")).alias("t")).collect()
    assert row.t == at(seconds=120)


@pytest.mark.parametrize("second, blocked", [
    (59, []), (60, ["a"]), (119, ["a"]), (120, ["a", "b"]), (179, ["a", "b"]), (180, ["b"]), (239, ["b"]), (240, [])])
def test_who_is_blocked_when(spark, second, blocked):
    entries = blocklist(found(spark, ("a", 60, "x"), ("a", 120, "x"), ("b", 120, "x"), ("b", 180, "y")))
    assert ips(active_blocklist(entries, at(seconds=second))) == blocked
    assert ips(active_blocklist(entries, F.lit(at(seconds=second)))) == blocked


def test_a_renewed_block_lasts_to_the_last_expiry(spark):
    entries = blocklist(found(spark, ("a", 60, "x"), ("a", 90, "x")))
    row, = active_blocklist(entries, "2024-01-01 00:01:45").collect()
    assert (row.blocked_at, row.expires_at) == (at(seconds=60), at(seconds=150))


def test_writing_an_entry_twice_changes_nothing(spark):
    entries = blocklist(found(spark, ("a", 60, "x")))
    once = active_blocklist(entries, at(seconds=70)).collect()
    assert active_blocklist(entries.union(entries), at(seconds=70)).collect() == once


def test_exclude_ips(spark):
    rows = found(spark, ("a", 60, "x"), ("a", 120, "x"), ("b", 60, "x"), (None, 60, "x"))
    known = spark.createDataFrame([("a", 1), ("a", 2), (None, 3)], "ip string, more int")
    everything = sorted(map(str, rows.collect()))
    kept = sorted(map(str, rows.filter("ip = 'b' or ip is null").collect()))
    assert sorted(map(str, exclude_ips(rows, known).select(rows.columns).collect())) == kept
    assert sorted(map(str, exclude_ips(rows, ["a", "z"]).collect())) == kept
    assert sorted(map(str, exclude_ips(rows, "a").collect())) == kept
    assert sorted(map(str, exclude_ips(rows, []).collect())) == everything


def test_nothing_but_the_bot_remains(spark):
    for detected in detections(spark):
        assert exclude_ips(detected, BOT).isEmpty()
        assert detected.count() == 1


def test_preview(spark):
    assert preview(spark.range(5000)).count() == 1000
    assert preview(frame(spark, [("a", "1", "click", at())]), 3).count() == 1
