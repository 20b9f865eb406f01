"""The blocklist as state that forgets by itself: what becomes blocked, stays blocked, and is blocked no longer.

A keyed state holds for each blocked ip when its block ends, and an event-time timer is set to it. It takes detections that
have been made into entries, never raw events, and costs a row of state for each ip that is blocked just now.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from clickwarden.operators.blocklist import active_blocklist

BLOCK, EXTEND, UNBLOCK = "block", "extend", "unblock"

# Timers and several kinds of state need it; a query keeps the provider of its first start.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass":
               "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class BlockedIp(StatefulProcessor):
    """Times are microseconds of the epoch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.block = handle.getValueState("block", "until bigint, latest bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        until, latest = self.block.get() or (None, None)  # when the block ends, and the start of the entry that says so
        before = until
        for start, end in sorted((row["blocked_at"], row["expires_at"]) for row in rows):
            if until is not None and start > until:  # its timer is still to come
                yield _change(key, UNBLOCK, until, until)
                until = None
            if until is None or end > until:
                yield _change(key, BLOCK if until is None else EXTEND, start, end)
                until, latest = end, start
            elif start < latest:  # it comes late, and may be the only one to say that the ip was blocked from then on
                yield _change(key, EXTEND, start, end)
        if until != before:
            if before is not None:
                self.handle.deleteTimer(_timer(before))
            self.block.update((until, latest))
            self.handle.registerTimer(_timer(until))

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        held = self.block.get()
        if held is not None and _timer(held[0]) <= expiredTimerInfo.getExpiryTimeInMs():
            self.block.clear()
            yield _change(key, UNBLOCK, held[0], held[0])

    def close(self) -> None:
        pass


def _timer(moment: int) -> int:
    """The first millisecond not before the moment."""
    return -(-moment // 1000)


def _change(key, action: str, moment: int, until: int) -> Row:
    return Row(ip=key[0], action=action, at=moment, expires_at=until)


def block_changes(entries: DataFrame) -> DataFrame:
    """(ip, action, at, expires_at): how the blocklist changes, from a stream of entries that carries a watermark; append mode.

    `entries` are those of `blocklist(detections)`. An ip's first entry gives `block`, a later one that lasts longer `extend`, and when the
    watermark has passed the end without another, `unblock` follows and the ip's state is gone. An entry that begins where the block
    ends extends it; one that begins later comes after an `unblock`; one that comes late and begins before is told as `extend` too. `at` is when the change takes effect, in event
    time: entries that come late give changes in the past, so use `blocked_by_changes` to replay, not the order of arrival.
    Entries without an ip or a time are left out. Run it with `start_stream(settings=STATE_STORE)`.
    """
    if not entries.isStreaming:
        raise ValueError("changes come from a stream of entries; for a table use active_blocklist")
    usable = entries.where("ip is not null and blocked_at is not null and expires_at is not null")
    micros = usable.select("ip", *[F.unix_micros(name).alias(name) for name in ("blocked_at", "expires_at")])
    changed = micros.groupBy("ip").transformWithState(
        BlockedIp(), "ip string, action string, at bigint, expires_at bigint", "Append", "EventTime")
    return changed.select("ip", "action", *[F.timestamp_micros(name).alias(name) for name in ("at", "expires_at")])


def blocked_by_changes(changes: DataFrame, as_of) -> DataFrame:
    """(ip, expires_at) of the ips blocked at `as_of`, from stored changes in any order, repeated ones too."""
    begun = changes.where(F.col("action") != UNBLOCK).select("ip", F.col("at").alias("blocked_at"), "expires_at")
    return active_blocklist(begun, as_of).select("ip", "expires_at")
