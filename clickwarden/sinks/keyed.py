"""A blocklist with one row for each ip, that can be asked about single ips.

Ips are dealt by hash into buckets. A write reads the buckets its ips fall into, keeps for each ip its last block, and writes
these buckets anew, sorted by ip and with bloom filters; a commit then names each bucket's folder. So a question reads the
buckets of its ips only, and in them the row groups that may hold them. What a write has taken in is noted in the same commit: a
batch that is written again changes nothing, and of two writers at once the second starts again from what the first wrote.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from clickwarden.defaults import TTL_SECONDS
from clickwarden.operators.blocklist import blocklist
from clickwarden.sinks.folders import CommitLog, Folder
from clickwarden.sinks.tables import Sink, _run, _sink

ROWS = "ip string, blocked_at timestamp, expires_at timestamp"
BUCKETS = 64


class KeyedBlocklist:
    """Rows (ip, blocked_at, expires_at): when the last block of each ip ends, and since when it has lasted without a gap.

    Earlier blocks of the ip are not kept, so ask for moments that are not before the last write; a table of all entries is what
    `blocklist_sink` writes. `buckets` is fixed by the first write. Choose it so that a bucket is a few hundred MB at most: a write costs the buckets it touches.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        if buckets < 1:
            raise ValueError(f"buckets must be at least 1, not {buckets!r}")
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.log = CommitLog(spark, self.path)

    def upsert(self, entries: DataFrame, writer: str | None = None, batch_id: int = 0, forget_before=None) -> None:
        """Takes in entries `ip, blocked_at, expires_at`, of which an ip may have several; those without an ip or a time are left out.

        With `writer`, batches of one writer come in order of `batch_id`, and one that has been taken in before is left out.
        Rows of the buckets that are written which expire at `forget_before` or earlier go for good.
        """
        usable = entries.select(*_columns()).where("ip is not null and blocked_at is not null and expires_at is not null")
        new = usable.withColumn("bucket", self._bucket(self._count()))
        new.persist()
        try:
            touched = sorted(row["bucket"] for row in new.select("bucket").distinct().collect())  # as many as buckets at most
            self.log.change(lambda content: self._merged(content, new, touched, writer, batch_id, forget_before))
        finally:
            new.unpersist()

    def _merged(self, content: dict | None, new: DataFrame, touched: list[int], writer, batch_id, forget_before) -> dict | None:
        content = content or {"buckets": self.buckets, "folders": {}, "taken": {}}
        if writer is not None and content["taken"].get(writer, -1) >= batch_id:
            return None
        folders, made = dict(content["folders"]), f"data/{uuid.uuid4().hex}"
        if touched:
            rows = new.union(self._rows(content, touched).withColumn("bucket", self._bucket(content["buckets"])))
            merged = _merged_rows(rows)
            if forget_before is not None:
                merged = merged.where(F.col("expires_at") > F.lit(forget_before).cast("timestamp"))
            (merged.repartition(len(touched), "bucket").sortWithinPartitions("bucket", "ip").write.partitionBy("bucket")
                .option("parquet.bloom.filter.enabled#ip", "true").parquet(f"{self.path}/{made}"))
            there = {*Folder(self.spark, self.path).names(made)}
            for bucket in touched:
                folders.pop(str(bucket), None)
                if f"bucket={bucket}" in there:
                    folders[str(bucket)] = f"{made}/bucket={bucket}"
        taken = content["taken"] if writer is None else {**content["taken"], writer: batch_id}
        return {"buckets": content["buckets"], "folders": folders, "taken": taken}

    def read(self) -> DataFrame:
        """All rows, expired ones too."""
        _, content = self.log.last()
        return self._rows(content, range(content["buckets"])) if content else self.spark.createDataFrame([], ROWS)

    def is_blocked(self, ips: DataFrame | Iterable[str], as_of) -> DataFrame:
        """(ip, blocked_at, expires_at) of those of the given ips that are blocked at `as_of`; a few names, or a frame with a column `ip`."""
        _, content = self.log.last()
        if content is None:
            return self.spark.createDataFrame([], ROWS)
        bucket = self._bucket(content["buckets"])
        moment = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")
        if not isinstance(ips, DataFrame):
            names = [ips] if isinstance(ips, str) else list(ips)
            asked = self.spark.createDataFrame([(name,) for name in names], "ip string")
            of_them = F.col("ip").isin(names) if names else F.lit(False)
        else:
            asked, of_them = ips.select("ip").distinct(), None
        touched = [row["bucket"] for row in asked.where("ip is not null").select(bucket.alias("bucket")).distinct().collect()]
        rows = self._rows(content, touched).where((F.col("blocked_at") <= moment) & (F.col("expires_at") > moment))
        return rows.join(asked, "ip", "left_semi") if of_them is None else rows.where(of_them)

    def read_for(self, ips: DataFrame) -> DataFrame:
        """The rows of the buckets that the frame's ips fall into."""
        _, content = self.log.last()
        if content is None:
            return self.spark.createDataFrame([], ROWS)
        touched = ips.where("ip is not null").select(self._bucket(content["buckets"]).alias("bucket")).distinct().collect()
        return self._rows(content, [row["bucket"] for row in touched])

    def vacuum(self, keep: int = 10) -> list[str]:
        """Deletes the folders that only commits before the last `keep` name, and those commits; returns the folders.

        A reader is safe while its commit is among those kept; folders of writes that are still going on are named by none.
        """
        gone = self.log.forget(keep)
        named = {folder for number in self.log.numbers() for folder in self.log.read(number)["folders"].values()}
        old = sorted({folder for content in gone for folder in content["folders"].values()} - named)
        folder = Folder(self.spark, self.path)
        for name in old:
            folder.delete(name)
        return old

    def _count(self) -> int:
        _, content = self.log.last()
        return content["buckets"] if content else self.buckets

    @staticmethod
    def _bucket(count: int) -> Column:
        return F.pmod(F.xxhash64("ip"), F.lit(count)).cast("int")

    def _rows(self, content: dict, buckets: Iterable[int]) -> DataFrame:
        folders = [f"{self.path}/{content['folders'][str(bucket)]}" for bucket in buckets if str(bucket) in content["folders"]]
        if not folders:
            return self.spark.createDataFrame([], ROWS)
        return self.spark.read.schema(ROWS).parquet(*folders).select(*_columns())


def _columns() -> list[str]:
    return ["ip", "blocked_at", "expires_at"]


def _merged_rows(rows: DataFrame) -> DataFrame:
    """One row for each ip: the end of its last entry, and the start of the stretch without a gap that leads to it."""
    order = Window.partitionBy("bucket", "ip").orderBy("blocked_at", "expires_at")
    before = F.max("expires_at").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = before.isNull() | (F.col("blocked_at") > before)
    return rows.withColumn("start", F.when(begins, F.col("blocked_at"))).groupBy("bucket", "ip").agg(
        F.max("start").alias("blocked_at"), F.max("expires_at").alias("expires_at"))


def keyed_sink(path: str, ttl_seconds: int = TTL_SECONDS, delay_seconds: int = 0, early: bool = False, buckets: int = BUCKETS) -> Sink:
    """Detections into a `KeyedBlocklist`, in append or update mode; the arguments are those of `blocklist`.

    An ip's end comes from its events: that update mode sends an ip again with every batch does not make it last longer.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        entries = blocklist(batch, ttl_seconds, delay_seconds, early)
        KeyedBlocklist(batch.sparkSession, path, buckets).upsert(entries, _run(batch), batch_id)

    return _sink(write, "append", "update")


def newly_flagged_sink(send: Callable[[DataFrame], None], sent_path: str, ttl_seconds: int = TTL_SECONDS, delay_seconds: int = 0,
                       early: bool = False, buckets: int = BUCKETS) -> Sink:
    """Gives `send` the ips (a column `ip`) of each batch that are not blocked already, in append or update mode.

    For tables that keep an ip for so long from its last write: a group that update mode sends again does not renew it. What has been sent, and
    until when it counts, stands in a `KeyedBlocklist` at `sent_path`. An ip is sent before it is noted, so a batch that dies in between sends
    it again, and none is lost.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        table = KeyedBlocklist(batch.sparkSession, sent_path, buckets)
        entries = blocklist(batch, ttl_seconds, delay_seconds, early)
        firsts = entries.groupBy("ip").agg(F.min("blocked_at").alias("blocked_at"))
        held = table.read_for(firsts).select(F.col("ip").alias("held_ip"), "expires_at")
        new = firsts.join(held, (F.col("ip") == F.col("held_ip")) & (F.col("expires_at") > F.col("blocked_at")), "left_anti")
        send(new.select("ip"))
        table.upsert(entries, _run(batch), batch_id)

    return _sink(write, "append", "update")
