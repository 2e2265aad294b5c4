"""Partition metadata and the counters of a query's plan."""

from __future__ import annotations

import time
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.time import bucket_of


@dataclass
class QueryPlan:
    """What a query had to look at. Partitions are (kind, bucket) pairs; times are those of their actual rows."""

    query_type: str
    candidate_partitions: int
    pruned_by_kind: int
    pruned_by_time: int
    scanned_partitions: int
    scanned_rows: int
    returned_rows: int = 0
    latency_us: int = 0

    def as_dict(self) -> dict:
        return asdict(self)


def manifest_of(rows: DataFrame, kind: str | Column, bucket_ns: int) -> DataFrame:
    """kind, bucket_start_ns, rows, t_min_ns, t_max_ns: a row for each partition of a table with t_ns."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return (
        rows.select(kind.alias("kind"), bucket_of(F.col("t_ns"), bucket_ns).alias("bucket_start_ns"), "t_ns")
        .groupBy("kind", "bucket_start_ns")
        .agg(F.count(F.lit(1)).alias("rows"), F.min("t_ns").alias("t_min_ns"), F.max("t_ns").alias("t_max_ns"))
    )


def merge_manifests(parts: DataFrame) -> DataFrame:
    return parts.groupBy("kind", "bucket_start_ns").agg(
        F.sum("rows").alias("rows"), F.min("t_min_ns").alias("t_min_ns"), F.max("t_max_ns").alias("t_max_ns")
    )


def reaches_latest(at_ns: int) -> Column:
    """Partitions that a lookup at an instant can't leave out."""
    return F.col("t_min_ns") <= F.lit(at_ns)


def reaches_range(start_ns: int, end_ns: int) -> Column:
    return (F.col("t_max_ns") >= F.lit(start_ns)) & (F.col("t_min_ns") < F.lit(end_ns))


def counters(manifest: DataFrame, kind: str, reaches: Column) -> DataFrame:
    """One row: candidate_partitions, pruned_by_kind, pruned_by_time, scanned_partitions, scanned_rows."""
    own = F.col("kind") == kind
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("long")
    return manifest.agg(
        F.count(F.lit(1)).alias("candidate_partitions"),
        count(~own).alias("pruned_by_kind"),
        count(own & ~reaches).alias("pruned_by_time"),
        count(own & reaches).alias("scanned_partitions"),
        F.coalesce(F.sum(F.when(own & reaches, F.col("rows"))), F.lit(0)).cast("long").alias("scanned_rows"),
    )


def plan_of(query_type: str, manifest: DataFrame, kind: str, reaches: Column) -> QueryPlan:
    return QueryPlan(query_type, **counters(manifest, kind, reaches).first().asDict())


class Timed:
    """Microseconds since it was made."""

    def __init__(self):
        self.began = time.perf_counter()

    def us(self) -> int:
        return int((time.perf_counter() - self.began) * 1e6)
