"""Where events come from and go to."""

from tidemark.sources.jsonl import decode, read_events, table_of
from tidemark.sources.store import Snapshot, Store, empty_snapshot, snapshot_of

__all__ = ["Snapshot", "Store", "decode", "empty_snapshot", "read_events", "snapshot_of", "table_of"]
