"""Writing micro-batches to tables, so that a replayed batch leaves no second copy.

A sink is a function that takes a `DataStreamWriter` and returns it set up; `run_stream` starts it. Every
table keeps the runs apart that write to it: a run is a streaming query's id, kept in its
checkpoint. Within a run each batch has a folder of its own, which a replay replaces.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Callable, Iterable
from datetime import date
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import DataStreamWriter

from clickwarden.defaults import TTL_SECONDS
from clickwarden.functions.times import as_wall_clock, instant_to_wall_clock
from clickwarden.operators.blocklist import active_blocklist, blocklist
from clickwarden.sinks.folders import Folder

Sink = Callable[[DataStreamWriter], DataStreamWriter]

# The output modes a sink can be used with, as an attribute of the sink; without it, all.
MODES = "output_modes"


def _sink(write: Callable[[DataFrame, int], None], *modes: str) -> Sink:
    def sink(stream: DataStreamWriter) -> DataStreamWriter:
        return stream.foreachBatch(write)

    if modes:
        setattr(sink, MODES, modes)
    return sink


def _run(batch: DataFrame) -> str:
    run = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
    if run is None:
        raise RuntimeError("this sink writes only from within a streaming query")
    return run


def _read(spark: SparkSession, paths: list[str], schema: str | T.StructType, base: str | None = None) -> DataFrame:
    """The files below the paths; none where nothing has been written yet."""
    reader = spark.read.schema(schema)
    if base is not None:
        reader = reader.option("basePath", base)
    try:
        return reader.parquet(*paths) if paths else spark.createDataFrame([], schema)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def parquet_sink(path: str) -> Sink:
    """Append mode: the rows of each batch, laid out `run=/batch_id=`; read them with `read_appended`.

    Several queries, one after the other or at once, may write to one folder; none hides another's rows.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/run={_run(batch)}/batch_id={batch_id}")

    return _sink(write, "append")


def read_appended(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All rows that `parquet_sink` has written, of the columns in `schema`."""
    layout = T.StructType([*schema.fields, T.StructField("run", T.StringType()), T.StructField("batch_id", T.LongType())])
    return _read(spark, [path], layout).select(*schema.names)


def blocklist_sink(path: str, writer: str, ttl_seconds: int = TTL_SECONDS, rows_per_file: int = 1_000_000,
                   delay_seconds: int = 0, early: bool = False) -> Sink:
    """Write detections as blocklist entries, in append or update mode.

    `delay_seconds` is the watermark's delay in append mode, `early` is for update mode: see `blocklist`. The table is laid out
    `expires_on=/writer=/run=/batch_id=`: readers list only the days they need, `remove_expired` deletes days that have passed,
    and `compact_blocklist` joins the folders of a day. Each detector writes under its own `writer`.
    Complete mode would write every entry again with each batch and is refused.

    A batch is spread over as many tasks as its rows need, `rows_per_file` each: one file per state
    partition would leave thousands of tiny files, one file per batch a single task's work.
    """
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", writer):
        raise ValueError(f"writer must be a plain name, not {writer!r}")

    def write(batch: DataFrame, batch_id: int) -> None:
        entries = blocklist(batch, ttl_seconds, delay_seconds, early)
        layout = {"expires_on": F.to_date(as_wall_clock(entries, "expires_at")), "writer": F.lit(writer),
                  "run": F.lit(_run(batch)), "batch_id": F.lit(batch_id).cast("bigint")}
        rows = entries.withColumns(layout).persist()
        try:
            files = math.ceil(rows.count() / rows_per_file)
            if files:
                (rows.repartition(files).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
                    .partitionBy(*layout).parquet(path))
        finally:
            rows.unpersist()

    return _sink(write, "append", "update")


ENTRIES = ("ip string, blocked_at timestamp, expires_at timestamp, reasons array<string>, "
           "expires_on date, writer string, run string, batch_id bigint")


def read_blocklist(spark: SparkSession, path: str, as_of=None) -> DataFrame:
    """All entries written under `path`, or only the ips blocked at `as_of` (a datetime or text).

    With `as_of`, only the folders of entries that expire on its day or later are listed. Rows of a compaction that has not been
    finished are read from where they are.
    """
    if as_of is None:
        return _read_days(spark, path, _days(spark, path))
    moment = F.lit(as_of).cast("timestamp")
    first = spark.range(1).select(F.to_date(instant_to_wall_clock(moment))).first()[0]
    days = [day for day in _days(spark, path) if day >= first]
    return active_blocklist(_read_days(spark, path, days), moment)


def _read_days(spark: SparkSession, path: str, days: list[date]) -> DataFrame:
    folder = Folder(spark, path)
    markers = [folder.read_json(f"_compacted/{name}") for name in folder.names("_compacted")]
    if not markers:
        return _read(spark, [f"{path}/expires_on={day}" for day in days], ENTRIES, path)
    halfway = {day for day in days for marker in markers for name in marker["replaced"] if name.startswith(f"expires_on={day}/")}
    whole = [f"{path}/expires_on={day}" for day in days if day not in halfway]
    named = [f"{path}/{name}" for day in halfway for name in _batches(spark, path, day)]
    rows = _read(spark, whole + named, ENTRIES, path)
    for marker in markers:  # not moved yet
        base = f"{path}/_compacting/{marker['run']}"
        left = [f"{base}/{name}" for name in marker["made"] if folder.exists(f"_compacting/{marker['run']}/{name}")
                and date.fromisoformat(name[11:].partition("/")[0]) in halfway]
        rows = rows.unionByName(_read(spark, left, ENTRIES, base))
    return rows


def _days(spark: SparkSession, path: str) -> list[date]:
    """The days that have a folder; one listing, of a folder a day."""
    return sorted(date.fromisoformat(name.removeprefix("expires_on=")) for name in Folder(spark, path).names()
                  if re.fullmatch(r"expires_on=\d{4,}-\d\d-\d\d", name))


def _batches(spark: SparkSession, path: str, day: date) -> list[str]:
    """The folders `expires_on=/writer=/run=/batch_id=` of a day, without those that a compaction has taken in."""
    folder, found = Folder(spark, path), []
    for writer in folder.names(f"expires_on={day}"):
        for run in folder.names(f"expires_on={day}/{writer}"):
            if writer.startswith("writer=") and run.startswith("run="):
                found += [f"expires_on={day}/{writer}/{run}/{name}" for name in folder.names(f"expires_on={day}/{writer}/{run}")]
    replaced = {old for name in folder.names("_compacted") for old in folder.read_json(f"_compacted/{name}")["replaced"]}
    return [name for name in found if re.search(r"/batch_id=\d+$", name) and name not in replaced]


def remove_expired(spark: SparkSession, path: str, before: date) -> list[date]:
    """Delete the entries of whole days before `before` (in UTC); returns the days. Runs beside writers."""
    gone = [day for day in _days(spark, path) if day < before]
    for day in gone:
        Folder(spark, path).delete(f"expires_on={day}")
    return gone


def compact_blocklist(spark: SparkSession, path: str, day: date, rows_per_file: int = 1_000_000) -> None:
    """Join the many small folders of the entries that expire on `day` into one for each writer.

    Runs beside writers and readers. The batches that are there at first are read by name, written together to a folder that
    readers do not see, and named in a marker; only these are deleted, so a batch that comes meanwhile stays as it is. From
    the marker on `read_blocklist` takes the new folders in place of the old ones; a reader that has listed before and reads after
must list again. A compaction that dies before its marker leaves the
    table as it was; one that dies later is finished by the next, of any day. A batch that is replayed when it has been taken in
    has its entries twice, which `active_blocklist` evens out. One compaction of a table runs at a time.
    """
    folder = Folder(spark, path)
    _finish_compactions(folder)
    for left in folder.names("_compacting"):  # died before its marker
        folder.delete(f"_compacting/{left}")
    old = _batches(spark, path, day)
    rows = _read(spark, [f"{path}/{name}" for name in old], ENTRIES, path)
    files = math.ceil(rows.count() / rows_per_file)
    if not files:
        return
    run = f"compacted-{uuid.uuid4().hex}"
    (rows.withColumn("run", F.lit(run)).withColumn("batch_id", F.lit(0).cast("bigint")).repartition(files)
        .write.partitionBy("expires_on", "writer", "run", "batch_id").parquet(f"{path}/_compacting/{run}"))
    writers = folder.names(f"_compacting/{run}/expires_on={day}")
    made = [f"expires_on={day}/{writer}/run={run}" for writer in writers if writer.startswith("writer=")]
    folder.write_json(f"_compacted/{run}.json", {"run": run, "made": made, "replaced": old})
    _finish_compactions(folder)


def _finish_compactions(folder: Folder) -> None:
    """Puts what markers name in place, then deletes what it replaces, then the marker."""
    for marker in folder.names("_compacted"):
        content = folder.read_json(f"_compacted/{marker}")
        for name in content["made"]:
            if folder.exists(f"_compacting/{content['run']}/{name}"):
                folder.move(f"_compacting/{content['run']}/{name}", name)
        for name in content["replaced"]:
            folder.delete(name)
            if not folder.names(parent := name.rpartition("/")[0]):
                folder.delete(parent)
        folder.delete(f"_compacting/{content['run']}")
        folder.delete(f"_compacted/{marker}")


def snapshot_sink(path: str) -> Sink:
    """For complete mode: keep the latest whole result, and the one before it while it is replaced.

    Each slot holds a row that marks its batch, also where the result is empty.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        nothing = spark.range(1).select(*[F.lit(None).cast(field.dataType).alias(field.name) for field in batch.schema],
                                        F.lit(True).alias("is_marker"))
        rows = batch.withColumn("is_marker", F.lit(False)).union(nothing).withColumns(
            {"batch_id": F.lit(batch_id).cast("bigint"), "written_at": F.current_timestamp()})
        rows.write.mode("overwrite").parquet(f"{path}/run={_run(batch)}/slot={batch_id % 2}")

    return _sink(write, "complete")


def read_snapshot(spark: SparkSession, path: str, run: str | None = None) -> DataFrame:
    """The latest result written by `snapshot_sink`: of the given run, or of the one that wrote last."""
    rows = spark.read.parquet(path)
    run = run or _last_run(rows.filter("is_marker"))
    rows = rows.filter(F.col("run") == run)
    last = rows.filter("is_marker").agg(F.max("batch_id")).first()[0]
    kept = rows.filter(F.lit(False) if last is None else (F.col("batch_id") == last) & ~F.col("is_marker"))
    return kept.drop("batch_id", "slot", "run", "is_marker", "written_at")


def _last_run(rows: DataFrame) -> str | None:
    return rows.agg(F.max_by("run", "written_at")).first()[0]


def changes_sink(path: str) -> Sink:
    """For update mode: keep what each micro-batch changed, in a folder of its own; `merge_changes` folds them together.

    Where a change can take a row out of the result, send the row with a column `flagged` that is false, as
    `detect_click_view_ratio(keep_passed=True)` does.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("written_at", F.current_timestamp()).write.mode("overwrite").parquet(
            f"{path}/run={_run(batch)}/batch_id={batch_id}")

    return _sink(write, "update")


def _changes(spark: SparkSession, path: str) -> DataFrame:
    """All changes that count: of each run the last base, and the batches that it has not taken in."""
    folder, tails, bases = Folder(spark, path), [], []
    for run in [name for name in folder.names() if name.startswith("run=")]:
        upto = _base(folder, run)
        tails += [f"{path}/{run}/batch_id={number}" for number in _numbers(folder.names(run), "batch_id=") if number > upto]
        bases += [(run, f"{path}/_base/{run}/upto={upto}")] if upto >= 0 else []
    rows = [spark.read.parquet(base).withColumn("run", F.lit(run.removeprefix("run="))) for run, base in bases]
    if tails or not rows:  # with neither, the reader says that there is no table
        tail = spark.read.option("basePath", path).parquet(*tails) if tails else spark.read.parquet(path)
        rows.append(tail.withColumns({"run": F.col("run").cast("string"), "batch_id": F.col("batch_id").cast("bigint")}))
    return reduce(DataFrame.unionByName, rows)


def _numbers(names: list[str], prefix: str) -> list[int]:
    return sorted(int(name.removeprefix(prefix)) for name in names if re.fullmatch(rf"{prefix}\d+", name))


def _base(folder: Folder, run: str) -> int:
    """The last batch that the base of a run has taken in, -1 without a base."""
    return max(_numbers(folder.names(f"_base/{run}"), "upto="), default=-1)


def read_changes(spark: SparkSession, path: str, keys: Iterable[str], run: str | None = None) -> DataFrame:
    """The last row written by `changes_sink` for each key, if it is still flagged, of the given run or of the one that wrote last."""
    rows = _changes(spark, path)
    rows = rows.filter(F.col("run") == (run or _last_run(rows))).drop("run", "written_at")
    keys = list(keys)
    others = [name for name in rows.columns if name not in keys and name != "batch_id"]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch_id").alias("row")).select(*keys, "row.*")
    return latest.filter("flagged").drop("flagged") if "flagged" in others else latest


def merge_changes(spark: SparkSession, path: str, keys: Iterable[str]) -> None:
    """Fold the finished batches of each run of a `changes_sink` into one row for each key, and delete them.

    Runs beside the query and its readers: a base appears as a whole under the number of the last batch it has taken in, and from then on readers
    leave out the batches up to there, whether they have been deleted yet or not. A merge that dies is made up for by the next. Rows whose
    flag has been taken back stay in the base, as the last word on their key. One merge of a table runs at a time.
    """
    keys, folder = list(keys), Folder(spark, path)
    for run in [name for name in folder.names() if name.startswith("run=")]:
        before = _base(folder, run)
        for name in folder.names(f"_base/{run}"):
            if name != f"upto={before}":
                folder.delete(f"_base/{run}/{name}")
        numbers = _numbers(folder.names(run), "batch_id=")
        done = [number for number in numbers if number > before and folder.exists(f"{run}/batch_id={number}/_SUCCESS")]
        if done:
            rows = _changes(spark, path).where((F.col("run") == run.removeprefix("run=")) & (F.col("batch_id") <= done[-1])).drop("run")
            others = [name for name in rows.columns if name not in keys]
            latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch_id").alias("row")).select(*keys, "row.*")
            draft = f"_base/{run}/_draft-{uuid.uuid4().hex}"
            latest.write.parquet(f"{path}/{draft}")
            folder.move(draft, f"_base/{run}/upto={done[-1]}")
        upto = _base(folder, run)
        for number in numbers:
            if number <= upto:
                folder.delete(f"{run}/batch_id={number}")
        if before not in (-1, upto):
            folder.delete(f"_base/{run}/upto={before}")


def table_sink(table_format: str, options: dict[str, str], columns: Iterable[str] = ("ip",)) -> Sink:
    """Append the distinct `columns` of each batch to any table a Spark connector writes.

    A replayed batch is written again: the table should be keyed by those columns. In update mode a row
    comes again whenever its group changes; `newly_flagged_sink` leaves out ips that are blocked already. Complete mode would send every row with each batch, so that
    none would ever expire, and is refused.
    """
    columns, send = list(columns), table_writer(table_format, options)

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.filter("flagged") if "flagged" in batch.columns else batch
        send(rows.select(*columns).distinct())

    return _sink(write, "append", "update")


def table_writer(table_format: str, options: dict[str, str]) -> Callable[[DataFrame], None]:
    """What appends a batch to a table that a Spark connector writes."""
    return lambda rows: rows.write.format(table_format).options(**options).mode("append").save()


CASSANDRA = "org.apache.spark.sql.cassandra"


def cassandra_sink(keyspace: str, table: str, ttl_seconds: int = TTL_SECONDS) -> Sink:
    """Blocked ips to a Cassandra table keyed by ip, each lasting `ttl_seconds` from its last write.

    Needs the spark-cassandra-connector package. Rows are bound by the connector, never put
    together as statement text.
    """
    return table_sink(CASSANDRA, cassandra_options(keyspace, table, ttl_seconds))


def cassandra_options(keyspace: str, table: str, ttl_seconds: int = TTL_SECONDS) -> dict[str, str]:
    return {"keyspace": keyspace, "table": table, "spark.cassandra.output.ttl": str(ttl_seconds)}
