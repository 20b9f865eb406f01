"""One row an ip in buckets: rows, what is read, replays, two writers; and compactions beside writers and after a death."""

import random
import threading
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from clickwarden.sinks import KeyedBlocklist, blocklist_sink, compact_blocklist, keyed_sink, merge_changes, newly_flagged_sink, read_blocklist, read_changes, tables
from clickwarden.sinks.folders import CommitLog, Folder
from clickwarden.streaming import AVAILABLE_NOW, run_stream
from clickwarden.sources import read_spool_events
from tests.data import add_batch, ips, line, stream_from_batches
from clickwarden import detect_high_activity, parse_events

START = datetime(2024, 1, 1)
SCHEMA = "ip string, blocked_at timestamp, expires_at timestamp, reasons array<string>"


def entries(spark, rows):
    return spark.createDataFrame(
        [(ip, None if first is None else START + timedelta(seconds=first), START + timedelta(seconds=last), ["x"])
         for ip, first, last in rows], SCHEMA)


def seconds(rows):
    return {row["ip"]: ((row["blocked_at"] - START).total_seconds(), (row["expires_at"] - START).total_seconds()) for row in rows.collect()}


def at(second):
    return START + timedelta(seconds=second)


def plain_rows(rows):
    """The last stretch without a gap of each ip."""
    found = {}
    for ip, first, last in sorted((row for row in rows if row[0] is not None and row[1] is not None), key=lambda row: row[1:]):
        begun, until = found.get(ip, (first, last))
        found[ip] = (first if first > until else begun, max(last, until))
    return found


def test_batches_of_entries(spark, tmp_path):
    rng = random.Random(1)
    table, rows = KeyedBlocklist(spark, str(tmp_path / "t"), buckets=4), []
    assert table.read().collect() == [] and table.is_blocked(["a"], START).collect() == []
    for number in range(5):
        part = [(rng.choice("abcdefgh"), first := 100 * number + rng.randrange(100), first + rng.choice([5, 50, 200])) for _ in range(15)]
        part += [(None, 1, 2), ("q", None, 5)]
        rows += part
        table.upsert(entries(spark, part), "w", number)
        table.upsert(entries(spark, part), "w", number)
        assert seconds(table.read()) == plain_rows(rows)
    wanted = {ip: row for ip, row in plain_rows(rows).items() if row[1] > 500}
    assert wanted and seconds(table.is_blocked(list("abcdefghxyz"), at(500))) == wanted
    assert seconds(table.is_blocked(spark.createDataFrame([(ip,) for ip in "aabbc"] + [(None,)], "ip string"), at(500))) == {
        ip: row for ip, row in wanted.items() if ip in "abc"}


def test_only_the_buckets_asked_for_are_read(spark, tmp_path):
    table = KeyedBlocklist(spark, str(tmp_path / "t"), buckets=8)
    names = [f"10.0.0.{number}" for number in range(200)]
    table.upsert(entries(spark, [(name, 0, 100) for name in names]))
    found = table.is_blocked("10.0.0.7", at(50))
    folders = {file.rpartition("/")[0] for file in found.inputFiles()}
    assert len(folders) == 1 and ips(found) == ["10.0.0.7"]
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        text = table.is_blocked("10.0.0.7", at(50))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = text[text.index("PushedFilters"):]
    assert ("EqualTo(ip,10.0.0.7)" in pushed or "In(ip, [10.0.0.7])" in pushed) and "GreaterThan(expires_at" in pushed
    assert len({file.rpartition("/")[0] for file in table.read().inputFiles()}) == 8
    # A later write leaves the buckets that it does not touch.
    before = set(table.read().inputFiles())
    table.upsert(entries(spark, [("10.0.0.7", 0, 200)]))
    after = set(table.read().inputFiles())
    assert len({file.rpartition("/")[0] for file in before - after}) == 1 and len(before & after) == len(before) - len(before - after)
    assert seconds(table.is_blocked(["10.0.0.7"], at(150))) == {"10.0.0.7": (0, 200)}


def test_bloom_filters_are_written(spark, tmp_path):
    import pyarrow.parquet as pq

    table = KeyedBlocklist(spark, str(tmp_path / "t"), buckets=1)
    table.upsert(entries(spark, [(f"ip{number}", 0, 100) for number in range(50)]))
    (file,) = table.read().inputFiles()
    data = pq.read_table(file.removeprefix("file://")).column("ip").to_pylist()
    assert data == sorted(data)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(file), conf)
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
    offsets = [column.getBloomFilterOffset() for column in reader.getFooter().getBlocks()[0].getColumns()]
    reader.close()
    assert offsets[0] > 0 and offsets[1:] == [-1, -1]


def test_two_writers_lose_nothing(spark, tmp_path):
    path, failed = str(tmp_path / "t"), []

    def write(writer):
        try:
            for number in range(4):
                KeyedBlocklist(spark, path, 2).upsert(entries(spark, [(f"{writer}{number}", 0, 100), ("both", number, 100 + number)]), writer, number)
        except Exception as problem:
            failed.append(problem)

    threads = [threading.Thread(target=write, args=(name,)) for name in "abc"]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    assert not failed
    found = seconds(KeyedBlocklist(spark, path).read())
    assert found == {**{f"{writer}{number}": (0, 100) for writer in "abc" for number in range(4)}, "both": (0, 103)}


def test_a_write_that_meets_another_starts_again(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    other, first = KeyedBlocklist(spark, path, 2), [True]
    write = CommitLog.write

    def late(self, number, content):
        if first[0]:
            first[0] = False
            other.upsert(entries(spark, [("other", 0, 100)]))
        return write(self, number, content)

    monkeypatch.setattr(CommitLog, "write", late)
    KeyedBlocklist(spark, path, 2).upsert(entries(spark, [("one", 0, 100)]))
    assert ips(KeyedBlocklist(spark, path).read()) == ["one", "other"]


def test_expired_rows_and_old_folders_go(spark, tmp_path):
    table = KeyedBlocklist(spark, str(tmp_path / "t"), buckets=1)
    for number in range(4):
        table.upsert(entries(spark, [(f"ip{number}", 10 * number, 10 * number + 5)]), forget_before=at(10 * number - 15))
    assert sorted(seconds(table.read())) == ["ip2", "ip3"]
    assert len(table.vacuum(keep=2)) == 2 and len(table.vacuum(keep=2)) == 0
    assert sorted(seconds(table.read())) == ["ip2", "ip3"]
    table.upsert(entries(spark, []), "w", 7)  # nothing to write, but noted
    assert table.log.last()[1]["taken"] == {"w": 7}
    with pytest.raises(ValueError):
        KeyedBlocklist(spark, "x", 0)


def test_stream_into_the_keyed_table_over_a_restart(spark, tmp_path):
    second = int((START - datetime(1970, 1, 1)).total_seconds())
    lines = [[line(ip, 1, "click", second + 60 * number + extra) for extra in range(3)] for number, ip in enumerate("abab")]
    raw = stream_from_batches(spark, tmp_path / "in", *lines, [line("z", 1, "view", second + 9000)])
    found = detect_high_activity(parse_events(raw), 2, "1 minute", watermark_delay="1 second")
    for _ in range(2):
        run_stream(found, keyed_sink(str(tmp_path / "t"), ttl_seconds=90), str(tmp_path / "c"), trigger=AVAILABLE_NOW)
    # a: blocked from 60 to 150 and from 180 to 270; b: from 120 to 210 and from 240 to 330.
    assert seconds(KeyedBlocklist(spark, str(tmp_path / "t")).read()) == {"a": (180, 270), "b": (240, 330)}


def test_only_newly_flagged_ips_are_sent(spark, tmp_path):
    """In update mode a busy ip comes again with each batch; it is sent again only when its block has ended."""
    second = int((START - datetime(1970, 1, 1)).total_seconds())
    sent, result = [], None
    for number, (ip, minute) in enumerate([("a", 0), ("a", 0), ("b", 1), ("a", 1), ("a", 9), ("a", 9)]):
        add_batch(tmp_path / "in", number, [line(ip, 1, "click", second + 60 * minute + extra) for extra in range(3)])
        raw = read_spool_events(spark, str(tmp_path / "in"))
        result = detect_high_activity(parse_events(raw), 2, "1 minute")
        sink = newly_flagged_sink(lambda new: sent.append(ips(new)), str(tmp_path / "t"), ttl_seconds=120, early=True, buckets=2)
        run_stream(result, sink, str(tmp_path / "c"), "update", AVAILABLE_NOW)
    assert [names for names in sent if names] == [["a"], ["b"], ["a"]]


def test_commits_are_numbered_and_refused_when_late(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "log"))
    assert log.last() == (0, None)
    assert log.write(1, {"a": 1}) and not log.write(1, {"a": 2})
    assert log.change(lambda content: {"a": content["a"] + 1}) == {"a": 2} and log.last() == (2, {"a": 2})
    assert log.change(lambda content: None) == {"a": 2} and log.numbers() == [1, 2]
    assert log.forget(1) == [{"a": 1}] and log.last() == (2, {"a": 2})
    assert Folder(spark, str(tmp_path / "log")).names("_drafts") == []


DAY = date(2024, 1, 1)


def batch_of(spark, path, run, number, names):
    rows = entries(spark, [(name, 0, 3600) for name in names]).withColumns({
        "expires_on": F.lit(DAY), "writer": F.lit("w"), "run": F.lit(run), "batch_id": F.lit(number).cast("bigint")})
    rows.write.mode("append").partitionBy("expires_on", "writer", "run", "batch_id").parquet(path)


def test_a_batch_that_comes_during_a_compaction_stays(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    batch_of(spark, path, "r", 0, ["1.1.1.1"])
    batch_of(spark, path, "r", 1, ["3.3.3.3"])
    finish = tables._finish_compactions
    calls = []

    def between(folder):
        calls.append(0)
        if len(calls) == 2:  # written and marked, nothing deleted yet
            batch_of(spark, path, "r", 2, ["2.2.2.2"])
            assert ips(read_blocklist(spark, path)) == ["1.1.1.1", "2.2.2.2", "3.3.3.3"]
        finish(folder)

    monkeypatch.setattr(tables, "_finish_compactions", between)
    compact_blocklist(spark, path, DAY)
    assert ips(read_blocklist(spark, path)) == ["1.1.1.1", "2.2.2.2", "3.3.3.3"]
    runs = {(row["run"][:9], row["batch_id"]) for row in read_blocklist(spark, path).collect()}
    assert runs == {("compacted", 0), ("r", 2)}


@pytest.mark.parametrize("step", ["before the marker", "after the marker", "moved", "half deleted"])
def test_a_compaction_that_dies_is_finished_by_the_next(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "t")
    for number in range(3):
        batch_of(spark, path, "r", number, [f"ip{number}"])
    folder_write, delete, seen = Folder.write_json, Folder.delete, []

    class Died(Exception):
        pass

    def write_json(self, name, content):
        if step == "before the marker":
            raise Died
        done = folder_write(self, name, content)
        if step == "after the marker":
            raise Died
        return done

    def die_in_delete(self, name):
        if "batch_id=" in name:
            seen.append(name)
            if len(seen) > (0 if step == "moved" else 1):
                raise Died
        delete(self, name)

    with monkeypatch.context() as patched:
        patched.setattr(Folder, "write_json", write_json)
        patched.setattr(Folder, "delete", die_in_delete)
        with pytest.raises(Died):
            compact_blocklist(spark, path, DAY)
    names = ["ip0", "ip1", "ip2"]
    assert ips(read_blocklist(spark, path)) == names
    assert ips(read_blocklist(spark, path, "2024-01-01 00:30:00")) == names
    batch_of(spark, path, "r", 3, ["ip3"])
    compact_blocklist(spark, path, date(2024, 2, 1) if step != "before the marker" else DAY)
    assert ips(read_blocklist(spark, path)) == [*names, "ip3"]
    compact_blocklist(spark, path, DAY)
    assert ips(read_blocklist(spark, path)) == [*names, "ip3"]
    assert {row["run"][:9] for row in read_blocklist(spark, path).collect()} == {"compacted"}
    folder = Folder(spark, path)
    assert folder.names("_compacted") == [] == folder.names("_compacting")


def test_compacting_what_the_sink_writes(spark, tmp_path):
    second = int((START - datetime(1970, 1, 1)).total_seconds())
    lines = [[line(f"ip{number}", 1, "click", second + 60 * number)] for number in range(4)]
    raw = stream_from_batches(spark, tmp_path / "in", *lines, [line("z", 1, "view", second + 9000)])
    found = detect_high_activity(parse_events(raw), 0, "1 minute", watermark_delay="1 second")
    run_stream(found, blocklist_sink(str(tmp_path / "t"), "w"), str(tmp_path / "c"), trigger=AVAILABLE_NOW)
    before = ips(read_blocklist(spark, str(tmp_path / "t")))
    compact_blocklist(spark, str(tmp_path / "t"), DAY)
    assert ips(read_blocklist(spark, str(tmp_path / "t"))) == before == ["ip0", "ip1", "ip2", "ip3"]


KEYS = ["ip", "window_start"]


def changes_of(spark, path, run, number, rows):
    frame = spark.createDataFrame([(ip, start, clicks, flagged) for ip, start, clicks, flagged in rows],
                                  "ip string, window_start int, clicks long, flagged boolean")
    frame.withColumn("written_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{path}/run={run}/batch_id={number}")


def last_changes(spark, path, run=None):
    return sorted(tuple(row) for row in read_changes(spark, path, KEYS, run).select("ip", "window_start", "clicks").collect())


@pytest.mark.parametrize("step", ["whole", "before the base", "after the base"])
def test_changes_before_during_and_after_a_merge(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "t")
    changes_of(spark, path, "x", 0, [("old", 1, 1, True)])
    for number, rows in enumerate([[("a", 1, 2, True), ("b", 1, 3, True)], [("a", 1, 5, True)], [("b", 1, 3, False), ("c", 2, 9, True)]]):
        changes_of(spark, path, "r", number, rows)
    wanted = [("a", 1, 5), ("c", 2, 9)]
    assert last_changes(spark, path) == wanted
    if step != "whole":
        def die(self, *arguments):
            raise RuntimeError("died")

        with monkeypatch.context() as patched:
            patched.setattr(Folder, "move" if step == "before the base" else "delete", die)
            with pytest.raises(RuntimeError):
                merge_changes(spark, path, KEYS)
        assert last_changes(spark, path, "r") == wanted and last_changes(spark, path, "x") == [("old", 1, 1)]
    changes_of(spark, path, "r", 3, [("d", 1, 1, True)])
    merge_changes(spark, path, KEYS)
    wanted.append(("d", 1, 1))
    assert last_changes(spark, path) == wanted and last_changes(spark, path, "x") == [("old", 1, 1)]
    folder = Folder(spark, path)
    assert folder.names("run=r") == [] and folder.names("_base/run=r") == ["upto=3"]
    changes_of(spark, path, "r", 3, [("d", 1, 1, True)])  # replayed
    changes_of(spark, path, "r", 4, [("b", 1, 7, True), ("c", 2, 9, False)])  # flags come and go
    changed = [("a", 1, 5), ("b", 1, 7), ("d", 1, 1)]
    assert last_changes(spark, path) == changed
    files = read_changes(spark, path, KEYS).inputFiles()
    assert files and all("/_base/" in file or "batch_id=4" in file for file in files)
    merge_changes(spark, path, KEYS)
    merge_changes(spark, path, KEYS)
    assert last_changes(spark, path) == changed and folder.names("_base/run=r") == ["upto=4"]


def test_a_batch_that_is_being_written_is_not_merged(spark, tmp_path):
    path = str(tmp_path / "t")
    changes_of(spark, path, "r", 0, [("a", 1, 2, True)])
    changes_of(spark, path, "r", 1, [("a", 1, 3, True)])
    Folder(spark, path).delete("run=r/batch_id=1/_SUCCESS")
    merge_changes(spark, path, KEYS)
    assert Folder(spark, path).names("run=r") == ["batch_id=1"] and last_changes(spark, path) == [("a", 1, 3)]
