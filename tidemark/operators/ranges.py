"""Time-range scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.time import check_bounds, half_open
from tidemark.schema import BUCKET, SEQ, entity_path


def range_scan(
    rows: DataFrame, start_ns: int, end_ns: int, entity: str | None = None, *, ordered: bool = False
) -> DataFrame:
    """Rows with start <= t_ns < end; equal bounds give none, inverted ones raise.

    With ``ordered`` the rows come bucket by bucket, in a bucket in order of arrival. The predicates are plain
    comparisons, so a Parquet scan skips row groups by their statistics.
    """
    check_bounds(start_ns, end_ns)
    found = rows.where(half_open(F.col("t_ns"), start_ns, end_ns))
    if entity is not None:
        found = found.where(F.col("entity_path") == entity_path(entity))
    return found.orderBy(*([BUCKET] if BUCKET in rows.columns else []), SEQ) if ordered else found
