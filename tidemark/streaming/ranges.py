"""A range scan of a stream: buckets are given out when they close, late rows as corrections."""

from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import BooleanType, StructType

from tidemark.functions.time import BUCKET_NS, bucket_of, check_bounds, half_open
from tidemark.schema import BUCKET, SEQ, entity_path
from tidemark.streaming.latest import rocksdb

#: Whether a row came after its bucket was given out.
LATE = "is_late"


class ReleaseBuckets(StatefulProcessor):
    """Holds the rows of a part of a bucket until event time has passed its end, then gives them out in order of arrival."""

    def __init__(self, schema: StructType, bucket_ns: int):
        self.schema, self.names = schema, [*schema.names, LATE]
        self.arrival, self.bucket = itemgetter(schema.names.index(SEQ)), itemgetter(schema.names.index(BUCKET))
        self.width = bucket_ns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getListState("held", self.schema)

    def _out(self, rows: list[tuple], late: bool) -> Iterator[Row]:
        for r in sorted(rows, key=self.arrival):
            yield Row(**dict(zip(self.names, (*r, late))))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        rows = list(map(tuple, rows))
        end_ms = -(-(self.bucket(rows[0]) + self.width) // 1_000_000)
        if timerValues.getCurrentWatermarkInMs() >= end_ms:
            yield from self._out(rows, True)
        else:
            self.held.appendList(rows)
            self.handle.registerTimer(end_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        rows = list(map(tuple, self.held.get()))
        self.held.clear()
        yield from self._out(rows, False)

    def close(self) -> None:
        pass


def range_changes(
    rows: DataFrame,
    start_ns: int,
    end_ns: int,
    entity: str | None = None,
    *,
    bucket_ns: int = BUCKET_NS,
    lateness: str = "0 seconds",
    parts: int = 1,
) -> DataFrame:
    """The rows of a stream with start <= t_ns < end, with bucket_start_ns and ``is_late``.

    A bucket's rows are held until the largest time of all rows (also those outside the range) less ``lateness`` has passed
    its end; then they are given out, in order of arrival (ingest_seq). A row that comes later is a correction: it is given
    out at once and marked. So whatever the order of arrival, all that was given out is the batch scan's result once time has
    passed the range's end; ordered by (bucket_start_ns, ingest_seq) it is the scan's order. A bucket that isn't closed when a
    stream ends stays in its checkpoint's state. Rows of null time are left out.

    A bucket is dealt out by entity over ``parts`` keys of state, so that one with many rows isn't one task's.
    """
    check_bounds(start_ns, end_ns)
    timed = rows.where(F.col("t_ns").isNotNull()).withColumn("__time", F.timestamp_micros(F.floor(F.col("t_ns") / 1000).cast("long")))
    wanted = half_open(F.col("t_ns"), start_ns, end_ns)
    if entity is not None:
        wanted &= F.col("entity_path") == entity_path(entity)
    # a condition on the watermark's column isn't pushed below it, so rows outside the range move the watermark too
    found = timed.withWatermark("__time", lateness).where(F.when(F.col("__time").isNotNull(), wanted))
    part = F.pmod(F.xxhash64("entity_path"), F.lit(parts)).alias("__part")
    found = found.select(*rows.columns, bucket_of(F.col("t_ns"), bucket_ns).alias(BUCKET), part)  # without __time late rows aren't dropped
    out = StructType(list(found.schema.fields)).add(LATE, BooleanType())
    return found.groupBy(BUCKET, "__part").transformWithState(ReleaseBuckets(found.schema, bucket_ns), out, "append", "eventTime").drop("__part")


def follow_range(changes: DataFrame, path: str, checkpoint: str, *, delay_ms: int | None = None) -> StreamingQuery:
    """Write what ``range_changes`` gives out to a folder of Parquet files; see ``follow_latest``."""
    with rocksdb(changes.sparkSession):
        writer = changes.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if delay_ms is None else writer.trigger(processingTime=f"{delay_ms} milliseconds")).start()
