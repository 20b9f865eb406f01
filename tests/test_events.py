from datetime import datetime

import pytest
from pyspark.sql import functions as F

from clickwarden import (
    events_from_json_lines, events_from_table, filter_actions, ip_from_id, json_field, parse_events, read_json_events,
    rejected_events, rejected_rows, tag_events, to_json_lines, to_kafka_value, write_json_events)
from clickwarden.functions.times import instant_to_wall_clock, plus_seconds, wall_clock_to_instant
from tests.data import START, at, frame, line, many_users

REASONS = {
    "": "unreadable",
    "   ": "unreadable",
    "null": "unreadable",
    "5": "unreadable",
    "[]": "unreadable",
    "{}": "unreadable",
    "no json at all": "unreadable",
    '{"unix_time": 1540559093, "ip": "172.10.0.1"': "unreadable",
    '{"other": 1}': "unreadable",
    '{"unix_time": 1540559093, "ip": "172.10.0.1"}{"unix_time": 1540559093, "ip": "172.10.0.2"}': "unreadable",
    '{"unix_time": 1540559093, "ip": "172.10.0.1"}, {"unix_time": 1540559093, "ip": "172.10.0.2"}': "unreadable",
    '{"unix_time": 1540559093, "ip": "172.10.0.1"} and more': "unreadable",
    '[{"unix_time": 1540559093, "ip": "172.10.0.1"}, {"unix_time": 1540559093, "ip": "172.10.0.2"}]': "unreadable",
    '{"unix_time": 1540559093, "type": "click"}': "no_ip",
    '{"unix_time": 1540559093, "ip": null, "type": "click"}': "no_ip",
    '{"ip": "172.10.0.1", "type": "click"}': "no_time",
    '{"unix_time": "x", "ip": "172.10.0.1"}': "bad_time",
    '{"unix_time": 1540559093.7, "ip": "172.10.0.1"}': "bad_time",
    '{"unix_time": 253402300800, "ip": "172.10.0.1"}': "bad_time",
    '{"unix_time": 9223372036854775807, "ip": "172.10.0.1"}': "bad_time",
    '{"unix_time": 92233720368547758070, "ip": "172.10.0.1"}': "bad_time",
    '{"unix_time": -62135596801, "ip": "172.10.0.1"}': "bad_time",
}
# The fields and values of these lines are fixed values of the event format.
GOOD = [
    '{"unix_time": 1540559093, "category_id": 1000, "ip": "172.10.0.51", "type": "click"}',
    '     {"unix_time": 1540559093, "category_id": 1000, "ip": "172.10.0.51", "type": "click"}',
    '{"type": "click", "ip": "172.10.0.51", "category_id": "1000", "unix_time": "1540559093", "more": [1, {"a": 2}]}',
]


@pytest.fixture
def raw(spark):
    return spark.createDataFrame([(text,) for text in [*GOOD, *REASONS, None]], "value string")


@pytest.fixture
def zone(spark, request):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", before)


def test_good_lines(spark, raw):
    rows = parse_events(raw).withColumn("seconds", F.unix_seconds("timestamp")).drop("timestamp").collect()
    assert [tuple(row) for row in rows] == [("172.10.0.51", "1000", "click", START)] * len(GOOD)


def test_bad_lines_are_kept_with_their_reason(raw):
    found = {row.value: row.reject_reason for row in rejected_events(raw).collect()}
    assert found == {**REASONS, None: "unreadable"}


def test_files_and_lines_agree(spark, raw, tmp_path):
    """Each line is an event or a reject, whichever way it is read."""
    raw.where("value is not null").write.text(str(tmp_path / "lines"))
    read = read_json_events(spark, str(tmp_path / "lines"))
    assert sorted(map(str, read.collect())) == sorted(map(str, parse_events(raw).collect()))
    rejected = rejected_events(spark.read.text(str(tmp_path / "lines")))
    assert read.count() + rejected.count() == len(GOOD) + len(REASONS)


def test_rows_without_an_ip_or_a_time_are_rejected(spark):
    table = spark.createDataFrame(
        [(None, 1, at(), "click"), (7, 2, None, "view"), (None, 3, None, "view"), (8, 4, at(), "click")],
        "user_id long, k int, ts timestamp_ntz, event_type string").withColumn(
        "props", F.concat(F.lit('{"k": '), "k", F.lit("}")))
    assert [(row.ip, row.category_id) for row in events_from_table(table).collect()] == [("172.10.0.8", "4")]
    assert sorted((row.k, row.reject_reason) for row in rejected_rows(table).collect()) == [
        (1, "no_ip"), (2, "no_time"), (3, "no_ip")]
    named = table.withColumn("ip", F.when(F.col("k") == 4, "a"))
    assert [row.ip for row in events_from_table(named, ip=F.col("ip")).collect()] == ["a"]


def test_nothing_is_lost_or_doubled(raw):
    assert parse_events(raw).count() + rejected_events(raw).count() == raw.count()


def test_binary_values_as_a_message_queue_delivers_them(spark):
    raw = spark.createDataFrame([(b"k", bytearray(GOOD[0].encode()), 7)], "key binary, value binary, offset long")
    row = parse_events(raw, keep=["offset"]).collect()[0]
    assert (row.ip, row.category_id, row.type, row.offset) == ("172.10.0.51", "1000", "click", 7)


def test_each_line_is_parsed_once(spark, tmp_path):
    (tmp_path / "lines").write_text("\n".join(GOOD))
    plan = parse_events(spark.read.text(str(tmp_path / "lines")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json(") == 1


def test_missing_category_and_type_still_count_as_activity(spark):
    row = events_from_json_lines(spark, ['{"unix_time": 0, "ip": "a"}']).collect()[0]
    assert (row.ip, row.category_id, row.type) == ("a", None, None)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kathmandu"], indirect=True)
def test_time_does_not_depend_on_the_session_zone(spark, zone):
    events = events_from_json_lines(spark, [GOOD[0]])
    row = events.select(instant_to_wall_clock(F.col("timestamp")).alias("utc")).collect()[0]
    assert row.utc == datetime(2018, 10, 26, 13, 4, 53)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Europe/Berlin"], indirect=True)
def test_wall_clock_and_instant_are_inverse_also_at_clock_changes(spark, zone):
    times = [datetime(2024, 3, 10, 2, 30, 0, 123456), datetime(2024, 11, 3, 1, 30), datetime(2024, 3, 31, 2, 30),
             datetime(1901, 1, 1, 0, 0, 0, 1), datetime(9999, 12, 31, 23, 59, 59, 999999)]
    df = spark.createDataFrame([(t,) for t in times], "t timestamp_ntz")
    there = df.select("t", wall_clock_to_instant(F.col("t")).alias("instant"))
    rows = there.select("t", F.unix_micros("instant").alias("us"),
                        instant_to_wall_clock(F.col("instant")).alias("back")).collect()
    for row in rows:
        gone = row.t - datetime(1970, 1, 1)
        assert row.us == (gone.days * 86400 + gone.seconds) * 1000000 + gone.microseconds
        assert row.back == row.t


@pytest.mark.parametrize("zone", ["America/New_York"], indirect=True)
def test_plus_seconds_is_exact_across_a_clock_change(spark, zone):
    df = spark.createDataFrame([(datetime(2024, 3, 9, 12),)], "t timestamp_ntz")
    df = df.select("t", wall_clock_to_instant(F.col("t")).alias("i"))
    two_days = 2 * 86400
    row = df.select(plus_seconds(df, "t", two_days).alias("t"),
                    instant_to_wall_clock(plus_seconds(df, "i", two_days)).alias("i")).collect()[0]
    assert row.t == row.i == datetime(2024, 3, 11, 12)


def test_json_files_round_trip(spark, tmp_path):
    events = frame(spark, [("a", "1", "click", at(seconds=1)), ("b", None, "view", at(seconds=2)),
                           ('c"\n', "2", None, at(seconds=3))])
    write_json_events(events, str(tmp_path / "out"))
    expected = sorted(map(str, parse_events(to_json_lines(events)).collect()))
    assert sorted(map(str, read_json_events(spark, str(tmp_path / "out")).collect())) == expected
    assert sorted(map(str, parse_events(spark.read.text(str(tmp_path / "out"))).collect())) == expected
    assert len(expected) == 3


def test_one_object_per_file(spark, tmp_path):
    for i, text in enumerate(["", *GOOD, "broken"]):
        (tmp_path / f"data{i}.json").write_text(text)
    assert read_json_events(spark, str(tmp_path)).count() == len(GOOD)


def test_wire_form(spark):
    events = frame(spark, [("a", "7", "click", at(seconds=5))])
    assert to_json_lines(events).collect()[0].value == (
        '{"unix_time":1704067205,"category_id":"7","ip":"a","type":"click"}')
    message = to_kafka_value(events.select("ip", "category_id")).collect()[0]
    assert (message.key, message.value) == ("a", '{"ip":"a","category_id":"7"}')
    assert to_kafka_value(events.select("ip"), key=None).columns == ["value"]


@pytest.mark.parametrize("number", [0, 254, 255, 1000, 2**53 + 1])
def test_ip_from_id(spark, number):
    df = spark.createDataFrame([(number,)], "n long")
    assert df.select(ip_from_id("n").alias("ip")).collect()[0].ip == f"172.10.{number // 255}.{number % 255}"
    assert df.select(ip_from_id(F.col("n"), "172.20").alias("ip")).collect()[0].ip.startswith("172.20.")


def test_json_field_is_get_json_object(spark):
    texts = ['{"k": 69}', '{"k":0}', '{"k": -5}', '{"k": -0}', '{"k": 007}', '{"k": 1.5}', '{"k": 1e3}', '{"k": "7"}',
             '{"k": "a\\"b"}', '{"k": null}', '{"k": {"k": 3}}', '{"j": {"k": 4}, "k": 5}', '{"k": 1, "k": 2}',
             '{"k": 69}\n', ' {"k": 69}', '{"k": 69} x', '{"k": 69', '{"K": 69}', '{}', '', 'k', '[{"k": 1}]',
             '{"k": 123456789012345678}', '{"k": 12345678901234567890123}', '{"k": 6 }', '{"k":  6}', '{"k": ٣}', None]
    df = spark.createDataFrame([(text,) for text in texts], "text string")
    rows = df.select("text", json_field("text", "k").alias("found"),
                     F.get_json_object("text", "$.k").alias("expected")).collect()
    assert [row.found for row in rows] == [row.expected for row in rows]
    assert sum(row.found is not None for row in rows) > 10


def test_other_tables_map_onto_the_model(spark):
    table = spark.createDataFrame([("x", 3, "seen", at())], "host string, cat int, what string, at timestamp_ntz")
    events = events_from_table(table, F.col("host"), F.col("cat").cast("string"),
                               F.when(F.col("what") == "seen", "view"), "at")
    assert [tuple(row) for row in events.collect()] == [("x", "3", "view", at())]


def test_filter_actions(spark):
    events = frame(spark, [("a", "1", kind, at()) for kind in ("click", "view", "error", None)])
    assert sorted(row.type for row in filter_actions(events, "click", "view").collect()) == ["click", "view"]


def test_fixture_size(spark):
    assert events_from_json_lines(spark, many_users()).count() == 1015
    assert tag_events(spark.createDataFrame([(line("a", 1, "click"),)], "value string")).columns[0] == "value"
