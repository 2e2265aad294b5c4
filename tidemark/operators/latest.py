"""Point-in-time lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.schema import SEQ, entity_path


def latest_at(rows: DataFrame, at_ns: int, entity: str | None = None, *, ordered: bool = True, by: str = "entity_path") -> DataFrame:
    """Per entity the row with the largest t_ns that isn't after ``at_ns``; of equal ones that which arrived last.

    ``rows`` has t_ns, entity_path, ingest_seq and any other columns, all of which come back. Entities without such a row
    are absent. Sorted by entity, bytewise, unless ``ordered`` is false. A partial aggregate leaves one row per
    entity and task, so the shuffle doesn't grow with the history.
    """
    found = rows.where(F.col("t_ns") <= F.lit(at_ns))
    if entity is not None:
        found = found.where(F.col(by) == entity_path(entity))
    others = [c for c in rows.columns if c != by]
    best = found.groupBy(by).agg(F.max_by(F.struct(*others), F.struct("t_ns", SEQ)).alias("__row"))
    best = best.select(*(F.col(by) if c == by else F.col(f"__row.`{c}`") for c in rows.columns))
    return best.orderBy(by) if ordered else best
