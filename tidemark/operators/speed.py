"""Speed over ground."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.time import MAX_NS, MIN_NS
from tidemark.operators.ranges import range_scan
from tidemark.operators.spans import ROWS_PER_SPAN, SPAN, carried, join_carried, with_spans
from tidemark.schema import SEQ


def speed_over_ground(
    poses: DataFrame,
    entity: str | None = None,
    start_ns: int = MIN_NS,
    end_ns: int = MAX_NS,
    *,
    ordered: bool = True,
    rows_per_span: int | None = ROWS_PER_SPAN,
) -> DataFrame:
    """entity_path, t_start_ns, t_end_ns, dt_ns, distance_m, speed_mps between samples that follow each other.

    Samples are ordered by (t_ns, arrival) within an entity; pairs without a positive time step are left out after
    they were paired, so the last of several samples of one instant is what the next one is measured from. Without
    ``entity`` every entity is worked on at once. The window is half-open.

    An entity's history is dealt out by spans of about ``rows_per_span`` samples, however far apart these are; what carries over from
    one to the next is a row a span. With None an entity is one task.
    """
    names = ["t_ns", "tx", "ty", "tz"]
    rows = range_scan(poses, start_ns, end_ns, entity).select("entity_path", *names, SEQ)
    spanned = with_spans(rows, "entity_path", ["t_ns", SEQ], rows_per_span)
    w = Window.partitionBy("entity_path", SPAN).orderBy("t_ns", SEQ)
    steps = spanned.withColumn("__before", F.lag(F.struct(*names)).over(w))
    if rows_per_span is not None:
        handed = carried(spanned, "entity_path", ["t_ns", SEQ], F.struct(*names))
        steps = join_carried(steps, "entity_path", handed).withColumn("__before", F.coalesce("__before", "__carried"))
    dx, dy, dz = (F.col(c) - F.col(f"__before.{c}") for c in names[1:])
    out = (
        steps.where(F.col("t_ns") > F.col("__before.t_ns"))
        .select(
            "entity_path",
            F.col("__before.t_ns").alias("t_start_ns"),
            F.col("t_ns").alias("t_end_ns"),
            (F.col("t_ns") - F.col("__before.t_ns")).alias("dt_ns"),
            F.sqrt(dx * dx + dy * dy + dz * dz).alias("distance_m"),
        )
        .withColumn("speed_mps", F.col("distance_m") / (F.col("dt_ns").cast("double") * F.lit(1e-9)))
    )
    return out.orderBy("entity_path", "t_start_ns") if ordered else out
