import os
import uuid
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.errors import AnalysisException, StreamingQueryException
from pyspark.sql import functions as F

from clickwarden import (
    blocklist, combine_detections, count_per_window, detect_all, detect_category_spread, detect_click_view_ratio,
    detect_high_activity, distinct_categories_per_window, events_from_json_lines, exclude_ips, parse_events,
    rejected_events, to_kafka_value)
from clickwarden.sinks import (
    blocklist_sink, cassandra_options, changes_sink, console_sink, kafka_sink, kafka_sink_options, parquet_sink,
    compact_blocklist, read_appended, read_blocklist, read_changes, read_snapshot, remove_expired, snapshot_sink,
    table_sink)
from clickwarden.sources import kafka_source_options, read_kafka_events, read_spool_events, stream_table
from clickwarden.streaming import AVAILABLE_NOW, late_rows, run_stream, start_stream
from clickwarden.streaming.app import build_detector, main, parse_arguments, run_app
from tests.conftest import SMALL_STATE
from tests.data import BOT, START, add_batch, ips, line, many_users, stream_from_batches

KEYS = ["ip", "window_start", "window_end"]
# A window's start: 2018-10-26 13:00 UTC.
WINDOW = 1540558800
# Late enough to close every window the tests use, with a watermark of a minute.
CLOSING = line("172.10.9.9", 1, "view", WINDOW + 7200)


def busy(ip, minute, n, categories=1, kind="click"):
    return [line(ip, i % categories, kind, WINDOW + 60 * minute + i % 60) for i in range(n)]


BATCHES = [
    busy("a", 1, 4, 3) + busy("b", 2, 2),
    busy("a", 3, 4, 4) + busy("b", 12, 5, 5) + busy("c", 4, 3, kind="view"),
    busy("a", 15, 9, 9) + busy("b", 13, 2, 7) + busy("c", 14, 7) + busy("d", 14, 2, kind="error"),
    [CLOSING],
]
LIMITS = {"max_events": 5, "max_ratio": 4, "max_categories": 3}


@pytest.fixture
def folder(tmp_path):
    return tmp_path


def run(result, folder, mode="append", keys=None):
    """Run to the end of the source; the result as read back."""
    spark = result.sparkSession
    table = f"{folder}/table-{uuid.uuid4().hex}"
    checkpoint = f"{folder}/checkpoint-{uuid.uuid4().hex}"
    sink = {"append": parquet_sink, "update": changes_sink, "complete": snapshot_sink}[mode](table)
    query = run_stream(result, sink, checkpoint, mode, AVAILABLE_NOW)
    assert query.exception() is None
    if mode == "append":
        return read_appended(spark, table, result.schema)
    return read_changes(spark, table, keys) if mode == "update" else read_snapshot(spark, table)


def same(found, expected):
    columns = expected.columns
    assert sorted(map(str, found.select(columns).collect())) == sorted(map(str, expected.collect()))
    assert found.count() > 0


def everything(spark, batches=BATCHES):
    return events_from_json_lines(spark, [text for lines in batches for text in lines])


def stream(spark, folder, batches=BATCHES):
    return parse_events(stream_from_batches(spark, folder / f"in-{uuid.uuid4().hex}", *batches))


QUERIES = {
    "high": lambda e, mode, **more: detect_high_activity(e, 5, **more),
    "high_sliding": lambda e, mode, **more: detect_high_activity(
        e, 5, window_duration="4 minutes", slide_duration="2 minutes", **more),
    "ratio_one": lambda e, mode, **more: detect_click_view_ratio(
        e, 4, keep_passed=mode == "update" and e.isStreaming, **more),
    "ratio_drop": lambda e, mode, **more: detect_click_view_ratio(
        e, 1, missing_views="drop", keep_passed=mode == "update" and e.isStreaming, **more),
    "spread": lambda e, mode, **more: detect_category_spread(e, 3, mode=mode, **more),
    "spread_sliding": lambda e, mode, **more: detect_category_spread(
        e, 3, window_duration="4 minutes", slide_duration="2 minutes", mode=mode, **more),
}
VIEWS = [busy("a", 1, 1, kind="view"), *BATCHES[:2], BATCHES[2] + busy("c", 14, 2, kind="view"), BATCHES[3]]


@pytest.mark.parametrize("mode", ["append", "update", "complete"])
@pytest.mark.parametrize("name", QUERIES)
def test_stream_equals_batch(spark, folder, name, mode):
    detect = QUERIES[name]
    found = run(detect(stream(spark, folder, VIEWS), mode, watermark_delay="1 minute"), folder, mode, KEYS)
    same(found, detect(everything(spark, VIEWS), mode))


def test_detect_all_stream_equals_batch(spark, folder):
    found = run(detect_all(stream(spark, folder), **LIMITS, watermark_delay="1 minute"), folder)
    same(found, detect_all(everything(spark), **LIMITS))


def test_all_windows_spread_stream_equals_batch(spark, folder):
    options = {"max_categories": 6, "scope": "all_windows"}
    for mode in ("complete", "update"):
        found = run(detect_category_spread(stream(spark, folder), mode=mode, **options), folder, mode, ["ip"])
        same(found, detect_category_spread(everything(spark), **options))


def test_combined_stream_equals_batch(spark, folder):
    def combine(events, **more):
        return combine_detections(
            detect_high_activity(events, 5, **more), detect_click_view_ratio(events, 4, **more),
            detect_category_spread(events, 3, **more), window_duration="20 minutes")

    same(run(combine(stream(spark, folder), watermark_delay="1 minute"), folder), combine(everything(spark)))


def test_one_pass_stream_combined_equals_batch(spark, folder):
    found = combine_detections(detect_all(stream(spark, folder), **LIMITS, watermark_delay="1 minute"),
                               window_duration="20 minutes")
    same(run(found, folder), combine_detections(detect_all(everything(spark), **LIMITS),
                                                window_duration="20 minutes"))


def test_a_stream_without_ips_on_the_allow_list(spark, folder):
    known = spark.createDataFrame([("a",)], "ip string")
    found = exclude_ips(detect_high_activity(stream(spark, folder), 5, watermark_delay="1 minute"), known)
    assert set(ips(run(found, folder))) == {"b", "c"}


def test_late_events_are_dropped_after_the_watermark(spark, folder):
    # The filter for late events uses the watermark of the batch before, hence two closing batches.
    batches = [busy("a", 1, 6), [CLOSING], [CLOSING], busy("late", 1, 6)]
    for mode in ("append", "update"):
        found = detect_high_activity(stream(spark, folder, batches), 5, watermark_delay="1 minute")
        assert ips(run(found, folder, mode, KEYS)) == ["a"]
    found = detect_category_spread(stream(spark, folder, batches), 0, watermark_delay="1 minute")
    assert "late" not in ips(run(found, folder))


def test_events_within_the_watermark_are_counted(spark, folder):
    batches = [busy("a", 1, 3), busy("b", 10, 1), busy("a", 2, 3), [CLOSING]]
    found = detect_high_activity(stream(spark, folder, batches), 5, watermark_delay="30 minutes")
    assert ips(run(found, folder)) == ["a"]


def test_watermark_advances_on_events_of_any_type(spark, folder):
    """A window of clicks must close even when only other events follow."""
    batches = [busy("a", 1, 6), [line("z", 1, "error", WINDOW + 7200)]]
    found = detect_click_view_ratio(stream(spark, folder, batches), 4, watermark_delay="1 minute")
    assert ips(run(found, folder)) == ["a"]


def test_append_mode_without_watermark_is_refused(spark, folder):
    with pytest.raises(AnalysisException):
        run(detect_high_activity(stream(spark, folder)), folder)


def test_bad_lines_do_not_stop_a_stream(spark, folder):
    batches = [["garbage", "", *busy("a", 1, 6)], ['{"ip": "b"}', '{"unix_time": "x", "ip": "b"}'], [CLOSING]]
    raw = stream_from_batches(spark, folder / "in", *batches)
    assert ips(run(detect_high_activity(parse_events(raw), 5, watermark_delay="1 minute"), folder)) == ["a"]
    rows = run(rejected_events(raw, keep=["file"]), folder).collect()
    assert sorted((row.value, row.reject_reason, row.file.rsplit("/", 1)[1]) for row in rows) == [
        ("", "unreadable", "batch000.json"), ("garbage", "unreadable", "batch000.json"),
        ('{"ip": "b"}', "no_time", "batch001.json"), ('{"unix_time": "x", "ip": "b"}', "bad_time", "batch001.json")]


def test_update_mode_blocks_before_the_window_ends(spark, folder):
    batches = [busy("a", 1, 4), busy("a", 2, 4)]
    found = detect_high_activity(stream(spark, folder, batches), 5, watermark_delay="1 minute")
    assert ips(run(found, folder, "update", KEYS)) == ["a"]
    found = detect_high_activity(stream(spark, folder, batches), 5, watermark_delay="1 minute")
    assert ips(run(found, folder)) == []


def test_early_category_count_survives_a_hot_pair(spark, folder):
    batches = [busy("hot", 1, 3000, 2) + busy("a", 1, 10, 4), busy("hot", 2, 3000, 3)]
    counts = distinct_categories_per_window(stream(spark, folder, batches), watermark_delay="1 minute", mode="update")
    table = counts.select("ip", F.col("window.start").alias("window_start"), "n_categories")
    rows = run(table, folder, "update", ["ip", "window_start"]).collect()
    assert {row.ip: row.n_categories for row in rows} == {"hot": 3, "a": 4}


def test_restart_goes_on_where_it_stopped(spark, folder):
    inputs, table, checkpoint = folder / "in", str(folder / "table"), str(folder / "checkpoint")

    def go():
        events = parse_events(read_spool_events(spark, str(inputs), 1))
        found = detect_high_activity(events, 5, watermark_delay="1 minute")
        run_stream(found, parquet_sink(table), checkpoint, trigger=AVAILABLE_NOW)

    add_batch(inputs, 0, busy("a", 1, 4))
    go()
    add_batch(inputs, 1, busy("a", 2, 4))
    add_batch(inputs, 2, [CLOSING])
    go()
    go()
    rows = spark.read.parquet(table).collect()
    assert [(row.ip, row.n_events) for row in rows] == [("a", 8)]


def moment(seconds):
    return datetime.fromtimestamp(WINDOW + seconds, timezone.utc)


def block(raw, path, checkpoint, writer="all", ttl_seconds=600, mode="append"):
    found = detect_high_activity(parse_events(raw), 5, watermark_delay="1 minute")
    run_stream(found, blocklist_sink(path, writer, ttl_seconds), checkpoint, mode, AVAILABLE_NOW)


def test_blocklist_table(spark, folder):
    raw = stream_from_batches(spark, folder / "in", *BATCHES)
    path = str(folder / "blocklist")
    block(raw, path, str(folder / "checkpoint"))
    expected = blocklist(detect_high_activity(everything(spark), 5), 600)
    same(read_blocklist(spark, path), expected)
    assert ips(read_blocklist(spark, path, moment(599))) == []
    assert ips(read_blocklist(spark, path, moment(600))) == ["a"]
    assert ips(read_blocklist(spark, path, moment(1200))) == ["a", "b", "c"]
    assert ips(read_blocklist(spark, path, "2018-10-26 13:20:00 UTC")) == ["a", "b", "c"]
    assert ips(read_blocklist(spark, path, moment(1800))) == []


def test_reading_a_blocklist_skips_days_that_have_passed(spark, folder):
    raw = stream_from_batches(spark, folder / "in", *BATCHES)
    path = str(folder / "blocklist")
    block(raw, path, str(folder / "checkpoint"))
    later = read_blocklist(spark, path, moment(5 * 86400))
    assert not later.inputFiles() and later.count() == 0


def test_a_replayed_batch_is_not_written_twice(spark, folder):
    """A batch whose commit was lost runs again after a restart."""
    path, checkpoint = str(folder / "blocklist"), folder / "checkpoint"
    raw = stream_from_batches(spark, folder / "in", *BATCHES)
    block(raw, path, str(checkpoint))
    before = sorted(map(str, read_blocklist(spark, path).collect()))
    commits = sorted((file for file in (checkpoint / "commits").iterdir() if file.name.isdigit()),
                     key=lambda file: int(file.name))
    commits[-1].unlink()
    (checkpoint / "commits" / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    block(raw, path, str(checkpoint))
    assert sorted(map(str, read_blocklist(spark, path).collect())) == before
    assert len(before) == 4


def test_writers_and_restarts_from_scratch_do_not_overwrite_each_other(spark, folder):
    path = str(folder / "blocklist")
    for number, (writer, ip) in enumerate([("one", "a"), ("two", "b"), ("one", "c")]):
        raw = stream_from_batches(spark, folder / f"in{number}", busy(ip, 1, 6), [CLOSING])
        block(raw, path, str(folder / f"checkpoint{number}"), writer)
    assert ips(read_blocklist(spark, path)) == ["a", "b", "c"]


def test_blocklist_in_other_modes(spark, folder):
    path = str(folder / "blocklist")
    block(stream_from_batches(spark, folder / "in", *BATCHES), path, str(folder / "update"), mode="update")
    assert ips(read_blocklist(spark, path, moment(1200))) == ["a", "b", "c"]
    with pytest.raises(ValueError, match="complete"):
        block(stream_from_batches(spark, folder / "in2", *BATCHES), path, str(folder / "complete"), mode="complete")


def test_early_entries_are_active_within_the_window(spark, folder):
    found = detect_high_activity(stream(spark, folder, [busy("a", 1, 4), busy("a", 2, 4)]), 5, watermark_delay="1 minute")
    sink = blocklist_sink(str(folder / "blocklist"), "all", 60, early=True)
    run_stream(found, sink, str(folder / "c"), "update", AVAILABLE_NOW)
    assert ips(read_blocklist(spark, str(folder / "blocklist"), moment(180))) == ["a"]
    assert ips(read_blocklist(spark, str(folder / "blocklist"), moment(661))) == []


def test_a_short_block_is_active_when_it_is_written(spark, folder):
    """Windows, watermark and time to live as the README gives them."""
    newest = WINDOW + 1200 + 5
    add_batch(folder / "in", 0, [line(text_ip, 1, "click", WINDOW + 60) for text_ip in ["b"] * 1001 + ["u"] * 4])
    add_batch(folder / "in", 1, [line("u", 1, "view", newest)])
    main(["--spool", str(folder / "in"), "--blocklist", str(folder / "blocklist"), "--checkpoint", str(folder / "c"),
          "--watermark", "10 minutes", "--trigger", AVAILABLE_NOW])
    assert ips(read_blocklist(spark, str(folder / "blocklist"), datetime.fromtimestamp(newest, timezone.utc))) == ["b"]


def test_expired_days_go_and_a_day_is_compacted(spark, folder):
    path = str(folder / "blocklist")
    days = [[line(f"ip{day}", 1, "click", WINDOW + day * 86400 + second) for second in range(6)] for day in range(5)]
    raw = stream_from_batches(spark, folder / "in", *days, *[[line("z", 1, "view", WINDOW + 6 * 86400)]])
    for writer in ("one", "two"):
        block(raw, path, str(folder / writer), writer)
    first = datetime.fromtimestamp(WINDOW, timezone.utc).date()
    assert len(remove_expired(spark, path, first + timedelta(days=2))) == 2
    left = sorted(ips(read_blocklist(spark, path)))
    assert left == ["ip2", "ip2", "ip3", "ip3", "ip4", "ip4"]
    later = read_blocklist(spark, path, moment(4 * 86400 + 700))
    assert ips(later) == ["ip4"] and len(later.inputFiles()) == 2
    before = sorted(map(str, read_blocklist(spark, path).drop("run", "batch_id").collect()))
    compact_blocklist(spark, path, first + timedelta(days=3))
    compact_blocklist(spark, path, first + timedelta(days=30))
    assert sorted(map(str, read_blocklist(spark, path).drop("run", "batch_id").collect())) == before
    assert ips(read_blocklist(spark, path, moment(3 * 86400 + 700))) == ["ip3"]


def test_old_files_are_read(spark, folder):
    inputs = folder / "in"
    now = 1700000000
    for number, age in enumerate([0, 30 * 86400, 86400]):
        add_batch(inputs, number, busy(f"ip{number}", 1, 10))
        os.utime(inputs / f"batch{number:03d}.json", (now - age, now - age))
        run_stream(parse_events(read_spool_events(spark, str(inputs), 1)), parquet_sink(str(folder / "t")),
                   str(folder / "c"), trigger=AVAILABLE_NOW)
    assert spark.read.parquet(str(folder / "t")).count() == 30


def test_a_second_checkpoint_on_the_same_folder_loses_and_mixes_nothing(spark, folder):
    for number, ip in enumerate("ab"):
        def events():
            return parse_events(stream_from_batches(spark, folder / f"in{number}", busy(ip, 1, 5), busy(ip, 2, 2)))

        run_stream(events(), parquet_sink(str(folder / "append")), str(folder / f"c{number}"), trigger=AVAILABLE_NOW)
        counts = count_per_window(events()).select("ip", "n_events")
        run_stream(counts, snapshot_sink(str(folder / "all")), str(folder / f"d{number}"), "complete", AVAILABLE_NOW)
        run_stream(counts, changes_sink(str(folder / "changes")), str(folder / f"e{number}"), "update", AVAILABLE_NOW)
    assert ips(read_appended(spark, str(folder / "append"), events().schema)) == ["a"] * 7 + ["b"] * 7
    assert [tuple(row) for row in read_snapshot(spark, str(folder / "all")).collect()] == [("b", 7)]
    assert [tuple(row) for row in read_changes(spark, str(folder / "changes"), ["ip"]).collect()] == [("b", 7)]
    assert read_appended(spark, str(folder / "nothing"), events().schema).count() == 0


@pytest.mark.parametrize("mode", ["update", "complete"])
def test_a_flag_can_be_withdrawn(spark, folder, mode):
    batches = [busy("a", 1, 10), busy("a", 2, 10, kind="view")]
    assert QUERIES["ratio_one"](everything(spark, batches), mode).count() == 0
    found = run(QUERIES["ratio_one"](stream(spark, folder, batches[:1]), mode), folder, mode, KEYS)
    assert ips(found) == ["a"]
    found = run(QUERIES["ratio_one"](stream(spark, folder, batches), mode), folder, mode, KEYS)
    assert ips(found) == []


def test_a_burst_within_a_second_spreads_over_all_salts(spark):
    burst = everything(spark, [[line("hot", 1, "click", WINDOW)] * 400]).withColumn("offset", F.monotonically_increasing_id())
    salts = burst.select(F.pmod(F.xxhash64("offset"), F.lit(64)).alias("salt")).distinct().count()
    assert salts > 60


@pytest.mark.parametrize("salts", [1, 64])
def test_salts_change_nothing(spark, folder, salts):
    events = parse_events(stream_from_batches(spark, folder / "in", *BATCHES), keep=["file"])
    counts = distinct_categories_per_window(events, watermark_delay="1 minute", mode="update", salts=salts,
                                            salt_by=("timestamp", "file"))
    table = counts.select("ip", F.col("window.start").alias("window_start"), "n_categories")
    wanted = distinct_categories_per_window(everything(spark)).select(
        "ip", F.col("window.start").alias("window_start"), "n_categories")
    same(run(table, folder, "update", ["ip", "window_start"]), wanted)


def test_a_failing_rejects_query_ends_the_application(spark, folder):
    def fail(batch, batch_id):
        raise RuntimeError("no room")

    raw = stream_from_batches(spark, folder / "in", ["junk"])
    with pytest.raises(StreamingQueryException, match="no room"):
        run_app(raw, build_detector("high_activity", watermark_delay="1 minute"), parquet_sink(str(folder / "t")),
                str(folder / "c"), timeout=60, rejects_sink=lambda writer: writer.foreachBatch(fail))
    assert not spark.streams.active


def test_late_rows_are_counted(spark, folder):
    batches = [busy("a", 1, 6), [CLOSING], [CLOSING], busy("late", 1, 6)]
    found = detect_high_activity(stream(spark, folder, batches), 5, watermark_delay="1 minute")
    query = run_stream(found, parquet_sink(str(folder / "t")), str(folder / "c"), trigger=AVAILABLE_NOW)
    assert late_rows(query) > 0


def test_a_blocklist_nobody_is_on(spark, folder):
    path = str(folder / "blocklist")
    assert read_blocklist(spark, path).count() == 0
    block(stream_from_batches(spark, folder / "in", busy("a", 1, 2), [CLOSING]), path, str(folder / "checkpoint"))
    assert read_blocklist(spark, path, moment(600)).count() == 0


def test_many_entries_go_to_many_files(spark, folder):
    path = str(folder / "blocklist")
    lines = [text for number in range(40) for text in busy(f"ip{number}", 1, 6)]
    raw = stream_from_batches(spark, folder / "in", lines, [CLOSING])
    found = detect_high_activity(parse_events(raw), 5, watermark_delay="1 minute")
    run_stream(found, blocklist_sink(path, "all", rows_per_file=10), str(folder / "c"), trigger=AVAILABLE_NOW)
    assert len(list((folder / "blocklist").rglob("*.parquet"))) == 4
    assert len(set(ips(read_blocklist(spark, path)))) == 40


def test_only_two_snapshots_are_kept(spark, folder):
    counts = count_per_window(stream(spark, folder)).select("ip", "n_events")
    run_stream(counts, snapshot_sink(str(folder / "t")), str(folder / "c"), "complete", AVAILABLE_NOW)
    assert sorted(entry.name for entry in (folder / "t").rglob("slot=*")) == ["slot=0", "slot=1"]
    same(read_snapshot(spark, str(folder / "t")), count_per_window(everything(spark)).select("ip", "n_events"))


def test_blocklist_sink_arguments(spark):
    with pytest.raises(ValueError):
        blocklist_sink("x", "a/b")


def test_table_sink_writes_each_ip_of_a_batch_once(spark, folder):
    path = str(folder / "ips")
    batches = [busy("a", 1, 6) + busy("a", 11, 6) + busy("b", 1, 6), [CLOSING]]
    found = detect_high_activity(stream(spark, folder, batches), 5, watermark_delay="30 minutes")
    run_stream(found, table_sink("parquet", {"path": path}), str(folder / "checkpoint"), trigger=AVAILABLE_NOW)
    assert ips(spark.read.parquet(path)) == ["a", "b"]
    assert spark.read.parquet(path).columns == ["ip"]


def test_cassandra_options():
    assert cassandra_options("k", "t") == {"keyspace": "k", "table": "t", "spark.cassandra.output.ttl": "60"}


def test_rocksdb_state(spark, folder):
    setting = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(setting, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        found = run(detect_all(stream(spark, folder), **LIMITS, watermark_delay="1 minute"), folder)
        same(found, detect_all(everything(spark), **LIMITS))
    finally:
        spark.conf.set(setting, SMALL_STATE)


def test_console(spark, folder, capfd):
    counts = count_per_window(stream(spark, folder, [busy("shown", 1, 2)]))
    query = run_stream(counts, console_sink(5), str(folder / "checkpoint"), "complete", AVAILABLE_NOW)
    assert query.exception() is None
    assert sum(progress["numInputRows"] for progress in query.recentProgress) == 2


def test_timeout_stops_the_query(spark, folder):
    found = detect_high_activity(stream(spark, folder), watermark_delay="1 minute")
    query = run_stream(found, parquet_sink(str(folder / "t")), str(folder / "c"), trigger="1 second", timeout=3,
                       name="bounded")
    assert not query.isActive and query.exception() is None and query.name == "bounded"


def test_start_stream_returns_a_running_query(spark, folder):
    query = start_stream(rejected_events(stream_from_batches(spark, folder / "in", ["x"])),
                         parquet_sink(str(folder / "t")), str(folder / "c"))
    assert query.isActive
    query.processAllAvailable()
    query.stop()
    assert spark.read.parquet(str(folder / "t")).count() == 1


def test_failures_reach_the_caller(spark, folder):
    def fail(batch, batch_id):
        raise RuntimeError("target gone")

    found = detect_high_activity(stream(spark, folder), watermark_delay="1 minute")
    with pytest.raises(StreamingQueryException):
        run_stream(found, lambda writer: writer.foreachBatch(fail), str(folder / "c"), trigger=AVAILABLE_NOW)


@pytest.mark.parametrize("more", [{"checkpoint": ""}, {"checkpoint": "x", "mode": "other"}])
def test_run_stream_arguments(spark, folder, more):
    with pytest.raises(ValueError):
        run_stream(stream(spark, folder), parquet_sink("x"), **more)


def test_spool_files_can_be_archived(spark, folder):
    inputs = folder / "in"
    add_batch(inputs, 0, busy("a", 1, 2))
    add_batch(inputs, 1, busy("b", 1, 3))
    raw = read_spool_events(spark, str(inputs), 1, archive_directory=str(folder / "done"))
    assert ips(run(parse_events(raw), folder)) == ["a", "a", "b", "b", "b"]
    assert list((folder / "done").rglob("batch000.json")) and not (inputs / "batch000.json").exists()


def test_table_as_stream(spark, folder):
    everything(spark).write.parquet(str(folder / "events.parquet"))
    found = run(stream_table(spark, str(folder / "events.parquet"), 1), folder)
    same(found, everything(spark))


def test_kafka_options_and_missing_package(spark, folder):
    assert kafka_source_options("h:9092", "t", max_offsets_per_trigger=5, min_partitions=3) == {
        "kafka.bootstrap.servers": "h:9092", "subscribe": "t", "startingOffsets": "earliest",
        "maxOffsetsPerTrigger": "5", "minPartitions": "3"}
    assert kafka_sink_options("h:9092", "t") == {"kafka.bootstrap.servers": "h:9092", "topic": "t"}
    with pytest.raises(AnalysisException, match="kafka"):
        read_kafka_events(spark, "h:9092", "t")
    messages = to_kafka_value(stream(spark, folder).select("ip"))
    with pytest.raises(AnalysisException, match="kafka"):
        run_stream(messages, kafka_sink("h:9092", "t"), str(folder / "c"), trigger=AVAILABLE_NOW)


def test_application(spark, folder):
    raw = stream_from_batches(spark, folder / "in", many_users()[:500] + ["junk"], many_users()[500:],
                              [line("172.10.0.1", 1, "view", START + 7200)])
    detect = build_detector("all", watermark_delay="1 minute", combine_window="60 seconds")
    run_app(raw, detect, blocklist_sink(str(folder / "blocklist"), "all"), str(folder / "checkpoint"),
            trigger=AVAILABLE_NOW, rejects_path=str(folder / "rejects"))
    row, = read_blocklist(spark, str(folder / "blocklist")).collect()
    assert (row.ip, row.reasons) == (BOT, ["category_spread", "click_view_ratio", "high_activity"])
    assert [row.value for row in spark.read.parquet(str(folder / "rejects")).collect()] == ["junk"]


@pytest.mark.parametrize("detector", [
    "high_activity", "click_view_ratio", "category_spread"])
def test_command_line(spark, folder, detector):
    add_batch(folder / "in", 0, many_users())
    add_batch(folder / "in", 1, [line("172.10.0.1", 1, "view", START + 7200)])
    main(["--spool", str(folder / "in"), "--blocklist", str(folder / "blocklist"), "--detector", detector,
          "--checkpoint", str(folder / "checkpoint"), "--watermark", "1 minute", "--trigger", AVAILABLE_NOW])
    row, = read_blocklist(spark, str(folder / "blocklist")).collect()
    assert (row.ip, row.reasons, row.writer) == (BOT, [detector], detector)


@pytest.mark.parametrize("arguments", [
    "--kafka h:1 --console --watermark x",
    "--spool x --console",
    "--spool x --console --mode complete",
    "--spool x --console --mode update --detector high_activity --combine-window x",
    "--spool x --console --detector category_spread --scope all_windows --watermark x",
    "--spool x --cassandra table --watermark x",
    "--spool x --cassandra k.t --mode complete --detector high_activity",
    "--spool x --blocklist p --mode complete --detector high_activity",
    "--spool x --kafka h:1 --topic t --console --watermark x"])
def test_arguments_that_cannot_work_are_refused(arguments, capsys):
    with pytest.raises(SystemExit):
        parse_arguments([*arguments.split(), "--checkpoint", "c"])


def test_presets():
    needed = "--spool x --console --watermark w --checkpoint c".split()
    options = parse_arguments(needed)
    assert (options.window, options.slide, options.missing_views, options.timeout) == ("10 minutes", None, "one", None)
    options = parse_arguments([*needed, "--preset", "sliding"])
    assert (options.window, options.slide, options.missing_views) == ("60 seconds", "30 seconds", "drop")
    assert (options.combine_window, options.trigger, options.timeout) == ("60 seconds", "10 seconds", None)
    options = parse_arguments([*needed, "--preset", "sliding", "--window", "2 minutes", "--timeout", "5"])
    assert (options.window, options.slide, options.timeout) == ("2 minutes", "30 seconds", 5)


def test_unknown_detector():
    with pytest.raises(ValueError):
        build_detector("other")
