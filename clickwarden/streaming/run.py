"""Starting a streaming query and waiting for it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from clickwarden.operators.counts import OUTPUT_MODES
from clickwarden.sinks.tables import MODES, Sink

AVAILABLE_NOW = "available_now"


def start_stream(result: DataFrame, sink: Sink, checkpoint: str, mode: str = "append",
                 trigger: str | None = None, name: str | None = None,
                 settings: dict[str, str] | None = None) -> StreamingQuery:
    """Start `result` into `sink` and return the running query.

    `checkpoint` is a folder all executors share; a query started on it again goes on where it
    stopped. `trigger` is None (the next micro-batch as soon as the last is done), an interval such
    as "10 seconds", or `AVAILABLE_NOW` (read what is there, then end). `settings` are settings of the
    session for this query alone.
    """
    if not checkpoint:
        raise ValueError("a checkpoint folder is needed; without one a restart reads everything again")
    if mode not in OUTPUT_MODES:
        raise ValueError(f"mode must be one of {OUTPUT_MODES}, not {mode!r}")
    if mode not in getattr(sink, MODES, OUTPUT_MODES):
        raise ValueError(f"this sink cannot be used in {mode} mode")
    writer = result.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    if name is not None:
        writer = writer.queryName(name)
    if trigger == AVAILABLE_NOW:
        writer = writer.trigger(availableNow=True)
    elif trigger is not None:
        writer = writer.trigger(processingTime=trigger)
    conf = result.sparkSession.conf
    before = {key: conf.get(key, None) for key in settings or {}}
    for key, value in (settings or {}).items():
        conf.set(key, value)
    try:
        return sink(writer).start()  # which takes a copy of the session's settings
    finally:
        for key, value in before.items():
            conf.unset(key) if value is None else conf.set(key, value)


def run_stream(result: DataFrame, sink: Sink, checkpoint: str, mode: str = "append",
               trigger: str | None = None, timeout: float | None = None, name: str | None = None,
               settings: dict[str, str] | None = None) -> StreamingQuery:
    """`start_stream`, then wait until the query ends; with `timeout`, stop it after so many seconds."""
    query = start_stream(result, sink, checkpoint, mode, trigger, name, settings)
    try:
        query.awaitTermination() if timeout is None else query.awaitTermination(timeout)
    finally:
        query.stop()
    return query


class LateRows(StreamingQueryListener):
    """Counts, batch by batch while queries run, the rows that come behind their watermark and are dropped.

    Give it to `spark.streams.addListener`; `tell` is called with the query's id, the batch and the number of rows of each batch
    that has any. Unlike the progress Spark keeps, the counts are of all batches of the runs it has listened to.
    """

    def __init__(self, tell: Callable[[str, int, int], None] | None = None):
        self.tell = tell
        self.counts: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self.counts.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        late = sum(state.numRowsDroppedByWatermark for state in progress.stateOperators)
        if late:
            self.counts[str(progress.id)] = self.counts.get(str(progress.id), 0) + late
            if self.tell is not None:
                self.tell(str(progress.id), progress.batchId, late)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def late_rows(query: StreamingQuery) -> int:
    """Rows that came behind the watermark and were dropped, in the micro-batches Spark still reports; see `LateRows` for all."""
    return sum(state["numRowsDroppedByWatermark"] for progress in query.recentProgress
               for state in progress["stateOperators"])
