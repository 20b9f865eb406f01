from clickwarden.streaming.changes import STATE_STORE, block_changes, blocked_by_changes
from clickwarden.streaming.run import AVAILABLE_NOW, LateRows, late_rows, run_stream, start_stream
from clickwarden.streaming.store import EventStore
from clickwarden.streaming.typed import read_typed_events, read_typed_rejects, start_typing

__all__ = ["AVAILABLE_NOW", "STATE_STORE", "EventStore", "LateRows", "block_changes", "blocked_by_changes", "late_rows",
           "read_typed_events", "read_typed_rejects", "run_stream", "start_stream", "start_typing"]
