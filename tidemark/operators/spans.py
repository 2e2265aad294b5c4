"""Histories dealt out by spans, so that no entity has to be one task.

A row begins a new span if a hash of it says so, one of ``rows_per_span`` on average. So spans hold about as many rows wherever an
entity's samples are dense or sparse, need no count beforehand, and come out alike however often they are worked out.
What a span needs from those before it is a row, which is found by an aggregate and carried over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a span on average.
ROWS_PER_SPAN = 1_000_000
SPAN = "__span"


def _bounds(rows: DataFrame, by: str, order: list[str], rows_per_span: int) -> DataFrame:
    """__by, __bounds: of entities that have any, the places at which spans begin, in order. A place is a struct of ``order``."""
    begins = F.pmod(F.xxhash64(by, *order), F.lit(rows_per_span)) == 0
    return (
        rows.where(begins)
        .groupBy(F.col(by).alias("__by"))
        .agg(F.sort_array(F.collect_set(F.struct(*order))).alias("__bounds"))
    )


def _number(place: Column) -> Column:
    """How many bounds aren't after a place: first among every w-th of them, then among the w that follow."""
    w = F.greatest(F.lit(1), F.sqrt(F.size("__bounds")).cast("int"))
    steps = F.sequence(F.lit(0), ((F.size("__bounds") - 1) / w).cast("int"))
    heads = F.transform(steps, lambda i: F.element_at("__bounds", i * w + 1))
    coarse = F.size(F.filter(heads, lambda b: b <= place))
    fine = F.size(F.filter(F.slice("__bounds", F.greatest(F.lit(1), (coarse - 1) * w + 1), w), lambda b: b <= place))
    return F.when(F.col("__bounds").isNull() | (coarse == 0), 0).otherwise((coarse - 1) * w + fine)


def with_spans(rows: DataFrame, by: str, order: list[str], rows_per_span: int | None = ROWS_PER_SPAN) -> DataFrame:
    """``rows`` with the number of each row's span within its entity; None makes an entity one span.

    The join with the bounds, one row for each entity that has any, is left to the optimizer: it broadcasts them if they are small.
    """
    if rows_per_span is None:
        return rows.withColumn(SPAN, F.lit(0))
    found = _bounds(rows, by, order, rows_per_span)
    names = rows.columns
    return rows.join(found, F.col(by).eqNullSafe(F.col("__by")), "left").select(*names, _number(F.struct(*order)).alias(SPAN))


def carried(spanned: DataFrame, by: str, order: list[str], value: Column, *, source: Column | None = None) -> DataFrame:
    """__by, __of, __carried: for each span but an entity's first one, the ``value`` of the last row before it.

    Only rows for which ``source`` holds count; a span without such a row hands on what it was given. Entities of one
    span have no rows here, and a task sends a row for each span it has rows of.
    """
    counts = F.lit(True) if source is None else source
    last = (
        spanned.groupBy(F.col(by).alias("__by"), F.col(SPAN).alias("__of"))
        .agg(F.max_by(F.when(counts, value), F.when(counts, F.struct(*order))).alias("__last"))
    )
    before = Window.partitionBy("__by").orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)  # a row for each span
    return last.select("__by", "__of", F.last("__last", ignorenulls=True).over(before).alias("__carried")).where("__of > 0")


def join_carried(rows: DataFrame, by: str, handed: DataFrame) -> DataFrame:
    """``rows`` with the column __carried of their span, or null."""
    on = F.col(by).eqNullSafe(F.col("__by")) & (F.col(SPAN) == F.col("__of"))
    return rows.join(handed, on, "left").drop("__by", "__of")
