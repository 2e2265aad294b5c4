"""Predicates and buckets on event time, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.errors import InvertedBounds

BUCKET_NS = 1_000_000_000
MIN_NS, MAX_NS = -(2**63), 2**63 - 1


def bucket_of(t: Column, bucket_ns: int) -> Column:
    """Start of the bucket that holds t: the largest multiple of the width that isn't later; 0 if there is no width."""
    if bucket_ns <= 0:
        return F.lit(0).cast("long")
    return t - F.pmod(t, F.lit(bucket_ns).cast("long"))


def check_bounds(start_ns: int, end_ns: int) -> None:
    if start_ns > end_ns:
        raise InvertedBounds(f"start {start_ns} is after end {end_ns}")


def half_open(t: Column, start_ns: int, end_ns: int) -> Column:
    """start <= t < end."""
    return (t >= F.lit(start_ns)) & (t < F.lit(end_ns))


def timestamps_within(column: str, kind: str, start_ns: int | None = None, end_ns: int | None = None) -> Column:
    """start <= t < end as bounds on a timestamp column of type ``kind``, which a Parquet scan takes over.

    The column has microseconds, so a bound between two of them is the later one. A bound of None is left out.
    """
    out = F.lit(True)
    for bound, test in ((start_ns, Column.__ge__), (end_ns, Column.__lt__)):
        if bound is not None:
            out = out & test(F.col(column), F.timestamp_micros(F.lit(-(-bound // 1000))).cast(kind))
    return out


def nanos(ts: Column) -> Column:
    """Nanoseconds since the epoch of a timestamp of microseconds; the session's time zone must be UTC for one without zone."""
    return F.unix_micros(ts.cast("timestamp")) * F.lit(1000).cast("long")
