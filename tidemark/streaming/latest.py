"""The latest row of each entity as the state of a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from tidemark.schema import SEQ

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Rows that a task holds at most on the way to the state, before it hands on the latest of them.
HELD = 200_000


def _last_of_each(rows: pa.Table, by: str) -> pa.Table:
    """Of the rows of an entity that of the largest (t_ns, arrival); null is an entity too."""
    entity = rows.combine_chunks().column(by).chunk(0).dictionary_encode("encode").indices.to_numpy()
    order = np.lexsort((rows[SEQ].to_numpy(), rows["t_ns"].to_numpy(), entity))
    last = np.flatnonzero(np.append(np.diff(entity[order]) != 0, True))
    return rows.take(pa.array(order[last]))


def fewer(by: str, held: int = HELD) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Drops rows that an equal or later one of their entity in the same task outdoes; at most ``held`` rows and a batch are held, so some
    may pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, n = [], 0
        for b in batches:
            if b.num_rows:
                kept, n = [*kept, b], n + b.num_rows
            if n > held:
                best = _last_of_each(pa.Table.from_batches(kept), by)
                kept, n = best.to_batches(), best.num_rows
                if n > held // 2:  # too many entities to go on with
                    yield from kept
                    kept, n = [], 0
        if n:
            yield from _last_of_each(pa.Table.from_batches(kept), by).to_batches()

    return run


class KeepLatest(StatefulProcessor):
    """Keeps a row per entity, that of the largest (t_ns, arrival), and gives it out whenever it changes."""

    def __init__(self, schema: StructType, expire_ms: int | None):
        self.schema, self.expire_ms = schema, expire_ms
        self.age = itemgetter(schema.names.index("t_ns"), schema.names.index(SEQ))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getValueState("best", self.schema, self.expire_ms)

    def _offer(self, rows: Iterator[Row]) -> Iterator[Row]:
        new = max(map(tuple, rows), key=self.age, default=None)
        old = self.best.get()
        if new is not None and (old is None or self.age(new) >= self.age(old)):
            self.best.update(new)
            if old is None or tuple(old) != new:
                yield Row(**dict(zip(self.schema.names, new)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        yield from self._offer(rows)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.best.update(tuple(initialState))

    def close(self) -> None:
        pass


@contextmanager
def rocksdb(spark: SparkSession):
    """State of the queries that are started within lies in RocksDB, which arbitrary state needs."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def latest_changes(rows: DataFrame, *, by: str = "entity_path", initial: DataFrame | None = None, expire_ms: int | None = None) -> DataFrame:
    """A stream of rows that became the latest of their entity, from a stream with t_ns and ingest_seq.

    Of the rows of an entity that with the largest t_ns is the latest, of equal ones that which arrived last (the largest
    ingest_seq), in whatever order and micro-batches they come; so late rows change nothing. Rows of null time or
    number are left out; an entity may be null. State is one row for each entity; with ``expire_ms`` it goes
    when the entity had no row for that long. ``initial`` (as ``rows``, not a stream, at most a row for each entity) is where a new
    stream begins, such as ``latest_at`` of a snapshot; a stream that goes on from its checkpoint has its own.

    A micro-batch's rows are dealt out by entity and cut down to the latest of each in Arrow batches first, so what the state costs
    goes by the entities of a micro-batch and not by its rows.
    """
    timed = F.col("t_ns").isNotNull() & F.col(SEQ).isNotNull()
    keyed = rows.where(timed).repartition(by).mapInArrow(fewer(by), rows.schema).groupBy(by)
    begun = None if initial is None else initial.select(*rows.columns).where(timed).groupBy(by)
    return keyed.transformWithState(KeepLatest(rows.schema, expire_ms), rows.schema, "append", "processingTime" if expire_ms else "none", begun)


def follow_latest(
    rows: DataFrame, path: str, checkpoint: str, *, by: str = "entity_path", initial: DataFrame | None = None, delay_ms: int | None = None
) -> StreamingQuery:
    """Write the changes of a stream to a folder of Parquet files. With ``delay_ms`` micro-batches go on until the query is
    stopped; without it what is there is taken, and the query ends. Files and state are committed together, so a query that
    was killed goes on from its checkpoint and neither loses nor repeats a change."""
    spark = rows.sparkSession
    with rocksdb(spark):
        writer = latest_changes(rows, by=by, initial=initial).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if delay_ms is None else writer.trigger(processingTime=f"{delay_ms} milliseconds")).start()


def current_latest(changes: DataFrame, *, by: str = "entity_path") -> DataFrame:
    """The latest row of each entity from the changes that were written."""
    others = [c for c in changes.columns if c != by]
    best = changes.groupBy(by).agg(F.max_by(F.struct(*others), F.struct("t_ns", SEQ)).alias("__row"))
    return best.select(*(F.col(by) if c == by else F.col(f"__row.`{c}`") for c in changes.columns))
