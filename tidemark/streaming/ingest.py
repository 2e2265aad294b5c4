"""Ingest of events: one batch, or a stream in micro-batches."""

from __future__ import annotations

import time
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.schema import SEQ
from tidemark.sources.jsonl import decode, in_order, lines_of, read_events
from tidemark.sources.store import Flushed, Store


@dataclass
class IngestSummary:
    """What an ingest did. Malformed lines aren't events and count nowhere; rejected are those of negative time. Both are
    in the store's side table (``Snapshot.rejects``), committed with the rows.

    A batch is a file of one kind: ``batch_rows`` rows of it, the last one of a commit as many as are left.
    """

    events_received: int = 0
    events_rejected: int = 0
    events_sent: int = 0
    batches_flushed: int = 0
    rows_emitted: int = 0
    max_batch_rows: int = 0
    wall_ms: float = 0.0
    cancelled: bool = False

    def add(self, received: int, rejected: int, flushed: list[Flushed]) -> None:
        self.events_received += received
        self.events_rejected += rejected
        self.events_sent += received - rejected
        for x in flushed:
            self.rows_emitted += x.rows
            self.batches_flushed += x.files
            self.max_batch_rows = max(self.max_batch_rows, x.largest)

    def as_dict(self) -> dict:
        return asdict(self)


def _observed(events: DataFrame) -> tuple[DataFrame, Observation]:
    seen = Observation()
    event = F.col("event").isNotNull()
    counted = events.observe(
        seen,
        F.count_if(event).alias("received"),
        F.count_if(event & (F.col("event.t_ns") < 0)).alias("rejected"),
    )
    return counted, seen


def _append(store: Store, events: DataFrame, summary: IngestSummary, batch: tuple[str, int] | None = None, batch_rows: int | None = None) -> None:
    """One job decodes, counts and writes; a micro-batch that is held already counts nowhere."""
    if batch is not None and store.holds(batch):
        return
    counted, seen = _observed(events)
    told: list[Flushed] = []
    store.append_events(counted.drop("blank"), batch, batch_rows=batch_rows, told=told)
    summary.add(seen.get["received"], seen.get["rejected"], told)


def ingest_file(spark: SparkSession, path: str, store: Store, *, batch_rows: int | None = None) -> IngestSummary:
    """Append the events of a JSON-lines file or folder; malformed and blank lines are skipped."""
    began, summary = time.perf_counter(), IngestSummary()
    _append(store, read_events(spark, path, rejects=True), summary, batch_rows=batch_rows)
    summary.wall_ms = (time.perf_counter() - began) * 1e3
    return summary


def ingest_rows(spark: SparkSession, events: list[dict] | DataFrame, store: Store) -> IngestSummary:
    """Append events held in memory (dicts of the raw event), in order, or a DataFrame with a text column ``value``."""
    began, summary = time.perf_counter(), IngestSummary()
    if not isinstance(events, DataFrame):
        from tidemark.sources.generator import line

        events = spark.createDataFrame([(line(e),) for e in events], "value string")
    numbered = events.select("value", F.monotonically_increasing_id().alias(SEQ))
    _append(store, decode(numbered, rejects=True), summary)
    summary.wall_ms = (time.perf_counter() - began) * 1e3
    return summary


def ingest_stream(
    spark: SparkSession,
    folder: str,
    store: Store,
    checkpoint: str,
    *,
    summary: IngestSummary | None = None,
    files_per_trigger: int = 100,
    delay_ms: int | None = None,
    batch_rows: int | None = None,
) -> StreamingQuery:
    """Follow a folder of JSON-lines files. With ``delay_ms`` micro-batches go on until the query is stopped; without it
    what is there is taken, and the query ends.

    Arrival is in order of micro-batches, in them of files by name, then of lines. Backpressure is the number of files
    a trigger takes. A query that ``cancel`` stops goes on where its checkpoint is, and a batch that is repeated is
    committed once.
    """
    told = summary if summary is not None else IngestSummary()

    def commit(batch: DataFrame, number: int) -> None:
        _append(store, decode(in_order(batch), rejects=True), told, (checkpoint, number), batch_rows)

    lines = lines_of(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder))
    writer = lines.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if delay_ms is None else writer.trigger(processingTime=f"{delay_ms} milliseconds")).start()


def cancel(query: StreamingQuery, summary: IngestSummary) -> None:
    """Stop a stream before its input has ended; ``summary`` says so. What was committed stays."""
    if query.isActive:
        summary.cancelled = True
        query.stop()
