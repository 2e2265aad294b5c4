"""Dumps of snapshots as Arrow IPC files, a folder for each kind.

A Python data source writes a file for each task and reads a partition for each few record batches, which the footer of a
file tells. Files lie where pyarrow's file systems reach: HDFS, object stores, folders that all machines share.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from tidemark.functions.time import BUCKET_NS
from tidemark.schema import KINDS, SEQ, check_kind, schema
from tidemark.sources.store import Snapshot

FORMAT = "tidemark_ipc"
#: Record batches of a partition that is read, unless told otherwise by the option ``batches``.
BATCHES = 16


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    """The committed files of a folder, by name."""
    from pyarrow import fs

    system, root = _system(path)
    found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted(x.path for x in found if x.is_file and x.path.endswith(".arrow"))


@dataclass
class Batches(InputPartition):
    """Record batches of a file, from the first to before the end."""

    path: str
    first: int
    end: int


class IpcReader(DataSourceReader):
    def __init__(self, path: str, batches: int, columns: StructType):
        self.path, self.batches, self.names = path, batches, columns.names

    def partitions(self) -> list[Batches]:
        system, _ = _system(self.path)
        out = []
        for name in _files(self.path):
            with system.open_input_file(name) as f:
                n = pa.ipc.open_file(f).num_record_batches
            out += [Batches(name, i, min(n, i + self.batches)) for i in range(0, n, self.batches)]
        return out or [Batches("", 0, 0)]

    def read(self, partition: Batches) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        system, _ = _system(self.path)
        with system.open_input_file(partition.path) as f:
            reader = pa.ipc.open_file(f)
            for i in range(partition.first, partition.end):
                yield reader.get_batch(i).select(self.names)


@dataclass
class Written(WriterCommitMessage):
    pending: str | None
    rows: int


class IpcWriter(DataSourceArrowWriter):
    """Tasks write files that readers don't see; commit gives them their names, and abort deletes them. A task that outlives the
    abort may leave such a file behind, still unseen."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = _system(self.path)
        name, sink, writer, rows = f"{root}/.{self.job}-{uuid.uuid4().hex}.pending", None, None, 0
        try:
            for b in iterator:
                if not b.num_rows:
                    continue
                if writer is None:
                    system.create_dir(root, recursive=True)
                    sink = system.open_output_stream(name, compression=None)
                    writer = pa.ipc.new_file(sink, b.schema)
                writer.write_batch(b)
                rows += b.num_rows
        finally:
            if writer is not None:
                writer.close()
                sink.close()
        return Written(name if writer is not None else None, rows)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _system(self.path)
        old = _files(self.path) if self.overwrite else []
        done = [m for m in messages if m is not None and m.pending]
        for i, m in enumerate(done):
            system.move(m.pending, f"{root}/part-{i:06d}-{self.job}.arrow")
        for name in old:
            system.delete_file(name)
        self._sweep()

    def abort(self, messages: list[Written | None]) -> None:
        self._sweep()

    def _sweep(self) -> None:
        """Delete what tasks of this job left: of failed attempts, or of all if the job failed."""
        from pyarrow import fs

        system, root = _system(self.path)
        for x in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if x.base_name.startswith(f".{self.job}-"):
                system.delete_file(x.path)


class IpcSource(DataSource):
    """Arrow IPC files of a folder, the option ``path``; without a schema that of the first file is taken."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        from pyspark.sql.pandas.types import from_arrow_schema

        found = _files(self.options["path"])
        if not found:
            raise ValueError(f"{self.options['path']} has no file to take a schema from")
        with _system(self.options["path"])[0].open_input_file(found[0]) as f:
            return from_arrow_schema(pa.ipc.open_file(f).schema)

    def reader(self, schema: StructType) -> IpcReader:
        return IpcReader(self.options["path"], int(self.options.get("batches", BATCHES)), schema)

    def writer(self, schema: StructType, overwrite: bool) -> IpcWriter:
        return IpcWriter(self.options["path"], overwrite)


def write_ipc(rows: DataFrame, path: str, *, overwrite: bool = False) -> None:
    """Write a DataFrame as a folder of IPC files, which appear when all tasks have ended; no rows write no file."""
    rows.sparkSession.dataSource.register(IpcSource)
    rows.write.format(FORMAT).option("path", path).mode("overwrite" if overwrite else "append").save()


def read_ipc(spark: SparkSession, path: str, columns: StructType | None = None, *, batches: int = BATCHES) -> DataFrame:
    """The rows of a folder of IPC files, a partition for ``batches`` record batches."""
    spark.dataSource.register(IpcSource)
    reader = spark.read.format(FORMAT).option("path", path).option("batches", str(batches))
    return (reader.schema(columns) if columns is not None else reader).load()


def dump(snapshot: Snapshot, path: str) -> list[str]:
    """Write each kind that has rows to a folder of its name under ``path``; the kinds are returned."""
    kinds = [k for k in KINDS if k in snapshot.tables]
    for kind in kinds:
        write_ipc(snapshot.table(kind).select(*schema(kind).names, SEQ), f"{path}/{kind}", overwrite=True)
    return kinds


def load(spark: SparkSession, path: str, kinds: list[str] | None = None, bucket_ns: int = BUCKET_NS) -> Snapshot:
    """The snapshot of a dump, or of some of its kinds; kinds without files have no rows."""
    tables = {}
    for kind in kinds or KINDS:
        if _files(f"{path}/{check_kind(kind)}"):
            tables[kind] = read_ipc(spark, f"{path}/{kind}", schema(kind).add(SEQ, "long"))
    return Snapshot(spark, bucket_ns, tables)
