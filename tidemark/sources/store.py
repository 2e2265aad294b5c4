"""A versioned store of events.

A commit writes new files for all kinds in one job, then publishes a version: a small JSON file, put in place by a rename
that fails if the version exists. So a store may lie on file systems whose rename is one step and refuses a taken
name: HDFS and local ones, but not object stores that rename by copying. Files are never changed, so a snapshot,
which is the list of a version's commits, keeps reading the same rows whatever is appended later. Late rows are always
accepted.

A version lists the commits since the last base, a file that lists all before it and is written every CHAIN commits.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.errors import SchemaMismatch, VersionConflict
from tidemark.functions.time import BUCKET_NS, bucket_of
from tidemark.operators.spans import ROWS_PER_SPAN, SPAN, with_spans
from tidemark.plans.manifest import manifest_of, merge_manifests
from tidemark.schema import BUCKET, KINDS, SEQ, check_kind, check_table, columns, schema

#: What the lines that were rejected are filed under, beside the kinds; their columns, and those that are text.
REJECTED, REJECT_COLUMNS = "Rejected", f"{SEQ} long, file string, reason string, line string"
#: Commits that a version lists beside its base.
CHAIN = 64
#: About how many rows are dealt out together where files have a cap; whole files at least.
ROWS_TOGETHER = 100_000
_MANIFEST = "kind string, bucket_start_ns long, rows long, t_min_ns long, t_max_ns long"


class Files:
    """The few file operations of a commit, by Hadoop's file systems, so that a store may lie where Spark reads."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.root = root.rstrip("/")
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        p = self._path(folder)
        return [x.getPath().getName() for x in self.fs.listStatus(p)] if self.fs.exists(p) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """Write a file under another name and rename it; raise if the name is taken."""
        draft, target = self._path(f"{name}.{uuid.uuid4().hex}.draft"), self._path(name)
        stream = self.fs.create(draft)
        stream.write(bytearray(text.encode()))
        stream.close()
        if self.fs.exists(target) or not self.fs.rename(draft, target):
            self.fs.delete(draft, False)
            raise VersionConflict(f"{name} was published by another writer")

    def delete(self, folder: str) -> None:
        self.fs.delete(self._path(folder), True)


@dataclass(frozen=True)
class Flushed:
    """What a commit wrote of a kind: its files, their rows, and the rows of the largest file."""

    kind: str
    files: int
    rows: int
    largest: int


@dataclass(frozen=True)
class Snapshot:
    """An immutable view: a table of each kind that has rows, and the manifest of its partitions."""

    spark: SparkSession
    bucket_ns: int = BUCKET_NS
    tables: dict[str, DataFrame] = field(default_factory=dict)
    parts: DataFrame | None = None
    rejected: DataFrame | None = None

    def rejects(self) -> DataFrame:
        """ingest_seq, file, reason, line of the lines that ingest rejected; the sequence is that of the rows, so it tells the
        place among these."""
        return self.rejected if self.rejected is not None else self.spark.createDataFrame([], REJECT_COLUMNS)

    def table(self, kind: str) -> DataFrame:
        """Rows of a kind with ingest_seq and bucket_start_ns; without rows, an empty table."""
        found = self.tables.get(check_kind(kind))
        if found is None:
            found = self.spark.createDataFrame([], schema(kind)).withColumn(SEQ, F.lit(0).cast("long"))
        return found.withColumn(BUCKET, bucket_of(F.col("t_ns"), self.bucket_ns))

    def manifest(self) -> DataFrame:
        if self.parts is not None:
            return merge_manifests(self.parts)
        parts = [manifest_of(t, k, self.bucket_ns) for k, t in self.tables.items()]
        out = self.spark.createDataFrame([], _MANIFEST)
        for p in parts:
            out = out.union(p)
        return out

    def num_partitions(self) -> int:
        return self.manifest().count()

    def total_rows(self) -> int:
        return self.manifest().agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]

    def count_by_kind(self) -> dict[str, int]:
        return dict(map(tuple, self.manifest().groupBy("kind").agg(F.sum("rows")).collect()))

    def by_kind(self) -> dict[str, DataFrame]:
        """The tables of kinds with rows, bucket by bucket, then in order of arrival."""
        return {k: self.table(k).orderBy(BUCKET, SEQ) for k in KINDS if k in self.tables}

    def register_views(self, prefix: str = "") -> None:
        """A temporary view for each kind, for SQL."""
        for k in KINDS:
            self.table(k).createOrReplaceTempView(prefix + k.lower())


def empty_snapshot(spark: SparkSession, bucket_ns: int = BUCKET_NS) -> Snapshot:
    return Snapshot(spark, bucket_ns)


def snapshot_of(spark: SparkSession, tables: dict[str, DataFrame], bucket_ns: int = BUCKET_NS) -> Snapshot:
    """A snapshot over DataFrames that have the kinds' columns; rows without ingest_seq are numbered as they come."""
    held = {}
    for kind, df in tables.items():
        check_table(df, kind)
        held[kind] = df if SEQ in df.columns else df.withColumn(SEQ, F.monotonically_increasing_id())
    return Snapshot(spark, bucket_ns, held)


def _rows_of(events: DataFrame) -> DataFrame:
    """The rows of decoded events, each with its kind and that kind's columns, and what was rejected; a pass over the events
    whatever the number of kinds."""
    from tidemark.sources.jsonl import field_of

    event = F.col("event")
    kind = F.when(event["t_ns"] >= 0, F.when(event["payload"]["kind"].isin(*KINDS), event["payload"]["kind"]))
    rejects = "reason" in events.columns
    if rejects:
        kind = F.coalesce(kind, F.when(F.col("reason").isNotNull(), REJECTED))
    filed = events.withColumn("kind", kind).where("kind is not null")
    kept = F.col("kind") != REJECTED
    out = [F.when(kept, event[c]).alias(c) for c in ("t_ns", "entity_path")]
    for k in KINDS:
        out += [F.when(F.col("kind") == k, field_of(c)).alias(c) for c in columns(k)[2:]]
    if rejects:
        file = F.col("file") if "file" in events.columns else F.lit(None).cast("string")
        out += [F.when(~kept, c).alias(n) for n, c in (("file", file), ("reason", F.col("reason")), ("line", F.col("line")))]
    return filed.select("kind", SEQ, *out)


class Store:
    """Append-only tables under a folder. One writer publishes a version at a time; readers never wait."""

    def __init__(self, spark: SparkSession, root: str, bucket_ns: int = BUCKET_NS):
        self.spark, self.files = spark, Files(spark, root)
        self.root = self.files.root
        found = self._latest()
        self.bucket_ns = found["bucket_ns"] if found["version"] else bucket_ns

    def _latest(self) -> dict:
        numbers = [int(n[:-5]) for n in self.files.names("versions") if n.endswith(".json")]
        if not numbers:
            return {"version": 0, "base": None, "commits": [], "next_seq": 0, "done": {}}
        return json.loads(self.files.read(f"versions/{max(numbers):012d}.json"))

    def _commits(self, version: dict) -> list[dict]:
        """All commits of a version."""
        before = json.loads(self.files.read(f"bases/{version['base']}.json")) if version["base"] else []
        return before + version["commits"]

    def version(self) -> int:
        return self._latest()["version"]

    def append(self, kind: str, rows: DataFrame, *, batch_rows: int | None = None) -> int:
        """Append rows of one kind in files of ``batch_rows``, but for a last one of what is left; no rows make no version.
        Returns the version."""
        check_table(rows, kind)
        if SEQ not in rows.columns:
            rows = rows.withColumn(SEQ, F.monotonically_increasing_id())
        return self._commit({kind: rows}, batch_rows=batch_rows)

    def append_events(
        self, events: DataFrame, batch: tuple[str, int] | None = None, *, batch_rows: int | None = None, told: list[Flushed] | None = None
    ) -> int:
        """Append decoded events (event, ingest_seq) of all kinds in one commit, a kind's in files of ``batch_rows`` and one of what is left.
        If they have ``reason`` and ``line``, what was rejected goes to a side table in the same commit.

        ``batch`` is a stream and the number of its micro-batch, which grows; one that was committed before is left out, so
        a repeated micro-batch changes nothing. ``told`` gets what was written.
        """
        now = self._latest()
        if batch is not None and self._holds(now, batch):
            return now["version"]
        return self._publish(_rows_of(events), batch, batch_rows, told)

    @staticmethod
    def _holds(version: dict, batch: tuple[str, int]) -> bool:
        return batch[1] <= version["done"].get(batch[0], -1)

    def holds(self, batch: tuple[str, int]) -> bool:
        """Whether a stream's micro-batch has been committed."""
        return self._holds(self._latest(), batch)

    def _commit(self, tables: dict[str, DataFrame], *, batch_rows: int | None = None) -> int:
        wide = None
        for kind, rows in tables.items():
            rows = rows.select(*columns(kind), SEQ)
            part = rows.select(F.lit(kind).alias("kind"), "t_ns", "entity_path", SEQ, *columns(kind)[2:])
            wide = part if wide is None else wide.unionByName(part, allowMissingColumns=True)
        return self._publish(wide, None, batch_rows, None)

    def _publish(self, wide: DataFrame, batch: tuple[str, int] | None, batch_rows: int | None, told: list[Flushed] | None) -> int:
        """Write rows of several kinds, which ``kind`` tells, in one job, and list them in a new version."""
        now, name = self._latest(), uuid.uuid4().hex
        wide = wide.withColumn(SEQ, F.col(SEQ) + F.lit(now["next_seq"]))
        folder = f"{self.root}/data/{name}"
        if batch_rows:
            wide = self._in_batches(wide, f"drafts/{name}", batch_rows)
        wide = wide.sortWithinPartitions("kind", "t_ns", SEQ)
        wide.write.option("maxRecordsPerFile", batch_rows or 0).partitionBy("kind").parquet(folder)
        if batch_rows:
            self.files.delete(f"drafts/{name}")
        kinds = [n.partition("=")[2] for n in self.files.names(f"data/{name}") if n.startswith("kind=")]
        if not kinds and batch is None:
            return now["version"]
        top = now["next_seq"]
        if kinds:
            rows = self.spark.read.schema(f"t_ns long, {SEQ} long, kind string").parquet(folder)
            manifest_of(rows.where(F.col("kind") != REJECTED), F.col("kind"), self.bucket_ns).write.parquet(f"{self.root}/manifest/{name}")
            by_file = rows.groupBy("kind", F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n"), F.max(SEQ).alias("top"))
            by_kind = by_file.groupBy("kind").agg(F.count(F.lit(1)).alias("files"), F.sum("n"), F.max("n"), F.max("top")).collect()
            top = max(r[-1] for r in by_kind) + 1
            if told is not None:
                told += [Flushed(*r[:4]) for r in by_kind if r[0] != REJECTED]
        version = now["version"] + 1
        new = {
            "version": version,
            "bucket_ns": self.bucket_ns,
            "next_seq": top,
            "base": now["base"],
            "commits": now["commits"] + [{"name": name, "kinds": sorted(kinds)}] * bool(kinds),
            "done": now["done"] | ({batch[0]: batch[1]} if batch else {}),
        }
        if len(new["commits"]) >= CHAIN:
            self.files.publish(f"bases/{name}.json", json.dumps(self._commits(new)))
            new |= {"base": name, "commits": []}
        self.files.publish(f"versions/{version:012d}.json", json.dumps(new))
        return version

    def _in_batches(self, wide: DataFrame, draft: str, batch_rows: int) -> DataFrame:
        """Rows dealt out so that tasks have whole batches of a kind, and only one of them what is left.

        The rows are written once, a file for each kind and task; the counts of these files and a row's place in its own
        number the rows of a kind without gaps, and no row is read or sorted for that.
        """
        folder = f"{self.root}/{draft}"
        wide.write.partitionBy("kind").parquet(folder)
        ordered = [*(f for f in wide.schema if f.name != "kind"), wide.schema["kind"]]
        file = F.col("_metadata.file_path").alias("__file")
        held = self.spark.read.schema(StructType(ordered)).parquet(folder)
        counts = held.select("kind", file).groupBy("kind", "__file").agg(F.count(F.lit(1)).alias("__n"))
        earlier = Window.partitionBy("kind").orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
        begins = counts.select("__file", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__begin"))
        placed = held.select("*", file, F.col("_metadata.row_index").alias("__at")).join(begins, "__file")
        together = max(1, ROWS_TOGETHER // batch_rows) * batch_rows
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))  # adaptive execution would go by bytes, and files cost more
        return placed.repartition(tasks, "kind", F.floor((F.col("__begin") + F.col("__at")) / together)).select(*wide.columns)

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The tables of a version (the latest if none is given), pinned to its files."""
        now = self._latest() if version is None else json.loads(self.files.read(f"versions/{version:012d}.json"))
        commits = self._commits(now)
        if not commits:
            return empty_snapshot(self.spark, self.bucket_ns)
        tables = {}
        for kind in KINDS:
            paths = [f"{self.root}/data/{c['name']}/kind={kind}" for c in commits if kind in c["kinds"]]
            if paths:
                ddl = schema(kind).add(SEQ, "long")
                tables[kind] = self.spark.read.schema(ddl).parquet(*paths)
        parts = self.spark.read.schema(_MANIFEST).parquet(*(f"{self.root}/manifest/{c['name']}" for c in commits))
        paths = [f"{self.root}/data/{c['name']}/kind={REJECTED}" for c in commits if REJECTED in c["kinds"]]
        rejected = self.spark.read.schema(REJECT_COLUMNS).parquet(*paths) if paths else None
        return Snapshot(self.spark, self.bucket_ns, tables, parts, rejected)

    def compact(self, rows_per_file: int = 5_000_000) -> int:
        """Rewrite all commits as one, sorted by time within files, and publish it as a version."""
        now = self._latest()
        snap = self.snapshot()
        if len(self._commits(now)) < 2:
            return now["version"]
        wide = None
        held = snap.tables | ({REJECTED: snap.rejected} if snap.rejected is not None else {})
        for kind, rows in held.items():
            part = rows.select(F.lit(kind).alias("kind"), *rows.columns)
            wide = part if wide is None else wide.unionByName(part, allowMissingColumns=True)
        name = uuid.uuid4().hex
        (
            wide.repartitionByRange("kind", "t_ns").sortWithinPartitions("kind", "t_ns", SEQ)
            .write.option("maxRecordsPerFile", rows_per_file).partitionBy("kind").parquet(f"{self.root}/data/{name}")
        )
        snap.manifest().write.parquet(f"{self.root}/manifest/{name}")
        version = now["version"] + 1
        new = now | {"version": version, "base": None, "commits": [{"name": name, "kinds": sorted(held)}]}
        self.files.publish(f"versions/{version:012d}.json", json.dumps(new))
        return version


def validate(snapshot: Snapshot, kind: str, *, rows_per_span: int = ROWS_PER_SPAN) -> bool:
    """Whether times don't decrease in order of arrival over all rows of a kind; a check of quality that nothing enforces.

    Rows are dealt out by spans of their arrival. A span tells whether times fall within it and its first and last time; a
    row for each span is then compared with the one before it.
    """
    if kind not in snapshot.tables:
        return True
    rows = with_spans(snapshot.table(kind).select(F.lit(0).alias("__all"), SEQ, "t_ns"), "__all", [SEQ], rows_per_span)
    inside = Window.partitionBy(SPAN).orderBy(SEQ)
    told = (
        rows.withColumn("back", F.col("t_ns") < F.lag("t_ns").over(inside))
        .groupBy(SPAN)
        .agg(F.max("back").alias("back"), F.min_by("t_ns", SEQ).alias("first"), F.max_by("t_ns", SEQ).alias("last"))
    )
    between = F.col("first") < F.lag("last").over(Window.orderBy(SPAN))
    return told.select((F.coalesce("back", F.lit(False)) | F.coalesce(between, F.lit(False))).alias("back")).where("back").isEmpty()


__all__ = ["Snapshot", "Store", "SchemaMismatch", "empty_snapshot", "snapshot_of", "validate"]
