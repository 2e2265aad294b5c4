"""As-of lookup at many instants."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.errors import SchemaMismatch
from tidemark.operators.spans import ROWS_PER_SPAN, SPAN, carried, join_carried, with_spans
from tidemark.schema import SEQ


def as_of(
    instants: DataFrame,
    samples: DataFrame,
    *,
    by: str = "entity_path",
    at: str = "t_ns",
    prefix: str = "sample_",
    tolerance_ns: int | None = None,
    rows_per_span: int | None = ROWS_PER_SPAN,
) -> DataFrame:
    """Each row of ``instants`` with the columns of the sample that ``latest_at`` finds for its entity and instant.

    ``samples`` has ``by``, t_ns, ingest_seq and any other columns; all but ``by`` come back with ``prefix`` before their
    names. The sample is the one with the largest t_ns that isn't after the instant, of equal ones that which arrived last; with
    ``tolerance_ns`` it must not be older than that. Where there is none its columns are null; a null instant has none,
    and samples of null time are never found. Instants are kept as they are, repeated ones too. A null entity is one like others.

    Both tables are merged by (entity, time), samples before instants of the same time, and the last sample is filled
    forward: one shuffle, whatever the number of instants, no join on ranges. An entity is dealt out by spans of
    about ``rows_per_span`` rows, between which the last sample is carried over; None makes an entity one span.
    """
    taken = [prefix + c for c in samples.columns if c != by]
    if clash := sorted({*taken, "__sample", "__instant", "__t", "__of", SPAN} & set(instants.columns)):
        raise SchemaMismatch(f"the instants have columns named {', '.join(clash)}")
    others = [c for c in samples.columns if c != by]
    left = instants.select(
        F.col(by).alias("__key"), F.col(at).cast("long").alias("__t"), F.lit(None).cast("long").alias("__seq"),
        F.struct(*(F.col(f"`{c}`") for c in instants.columns)).alias("__instant"),
    )
    right = samples.where(F.col("t_ns").isNotNull()).select(
        F.col(by).cast(left.schema["__key"].dataType).alias("__key"), F.col("t_ns").cast("long").alias("__t"), F.col(SEQ).cast("long").alias("__seq"),
        F.struct(*(F.col(f"`{c}`") for c in others)).alias("__sample"),
    )
    both = right.unionByName(left, allowMissingColumns=True)
    both = both.withColumn("__late", F.col("__instant").isNotNull().cast("int"))
    order = ["__t", "__late", "__seq"]
    spanned = with_spans(both, "__key", order, rows_per_span)
    w = Window.partitionBy("__key", SPAN).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = spanned.withColumn("__found", F.last("__sample", ignorenulls=True).over(w)).where("__late = 1")
    if rows_per_span is not None:
        handed = carried(spanned, "__key", order, F.col("__sample"), source=F.col("__late") == 0)
        filled = join_carried(filled, "__key", handed).withColumn("__found", F.coalesce("__found", "__carried"))
    fresh = F.col("__t").isNotNull()
    if tolerance_ns is not None:
        fresh &= F.col("__t") - F.col("__found.t_ns") <= F.lit(tolerance_ns)
    found = F.when(fresh, F.col("__found")).alias("__found")
    return filled.select("__instant", found).select("__instant.*", *(F.col(f"__found.`{c}`").alias(prefix + c) for c in others))
