"""Events from and to JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.spans import SPAN, with_spans
from tidemark.schema import KINDS, RAW, SEQ, columns, schema

# The fields that each kind's payload must have.
REQUIRED = {k: [c for c in columns(k)[2:] if c != "unit"] for k in KINDS}
_STRINGS = ["entity_path", "timeline", "component"]  # a kind that is none of the known strings is refused anyhow
_PAYLOAD_STRINGS = ["unit", "uri", "format", "label"]
_DOUBLES = ["tx", "ty", "tz", "qx", "qy", "qz", "qw", "value"]


def _finite(c: Column) -> Column:
    return F.abs(c) < F.lit(float("inf"))


def _is_string(json: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(json, f"$[0].{path}", "variant")) == "STRING"


#: Why a line is no event that is kept, by the first test that it fails.
REASONS = {"json": "not one JSON object without repeated keys", "kind": "no known kind", "field": "a field is missing or of another type", "time": "a negative time"}


def decode(lines: DataFrame, column: str = "value", *, rejects: bool = False) -> DataFrame:
    """All columns of ``lines`` but its text, then ``event`` (the raw struct; null if malformed) and ``blank``. With ``rejects``
    also ``reason`` (of REASONS; null for blank lines and events that are kept) and ``line``, the text of what has a reason.

    A line is an event only if it is one JSON object without repeated keys that has every field of its kind in the right
    type: integers where the schema says so, strings as strings, finite numbers, three coordinates a point, and a known
    kind. Fields beyond those are ignored. Names are compared with case.
    """
    event, json = F.col("__event"), F.col("__json")
    kind = event["payload"]["kind"]
    alone = F.try_variant_get(json, "$[1]", "variant").isNull()
    whole = F.try_variant_get(json, "$[0]", "variant").isNotNull() & alone
    typed = F.col("__corrupt").isNull() & event["t_ns"].isNotNull()
    for path in _STRINGS:
        typed &= _is_string(json, path)
    for c in _PAYLOAD_STRINGS:
        typed &= event["payload"][c].isNull() | _is_string(json, f"payload.{c}")
    for c in _DOUBLES:
        typed &= event["payload"][c].isNull() | _finite(event["payload"][c])
    fields = F.lit(False)
    for k, names in REQUIRED.items():
        has = kind == k
        for c in names:
            has &= event["payload"][c].isNotNull()
        fields |= has
    points = event["payload"]["points"]
    cloud = F.forall(points, lambda p: p.isNotNull() & (F.size(p) == 3) & F.forall(p, lambda x: x.isNotNull() & _finite(x)))
    good = lambda c: F.coalesce(c, F.lit(False))
    ok = good(typed & fields & (points.isNull() | cloud) & alone)
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__corrupt", "allowNonNumericNumbers": "false"}
    parsed = F.from_json(column, f"{RAW}, __corrupt string", options)
    wrapped = F.try_parse_json(F.concat(F.lit("["), F.col(column), F.lit("]")))
    others = [c for c in lines.columns if c != column]
    known = F.try_variant_get(json, "$[0].payload.kind", "string").isin(*KINDS)
    blank = F.col("__line") == ""
    # a projection that isn't deterministic keeps Catalyst from pushing filters on events below it, where each of their terms
    # would parse the line again
    kept = F.when(F.col("__ok") & (F.spark_partition_id() >= 0), event)
    out = [*others, kept.alias("event"), blank.alias("blank")]
    if rejects:
        late = F.when(event["t_ns"] < 0, "time")
        why = F.when(F.col("__ok"), late).when(blank | F.col("__line").isNull(), None)
        why = why.when(~good(whole), "json").when(~good(known), "kind").otherwise("field")
        out += [why.alias("reason"), F.when(why.isNotNull(), F.col("__text")).alias("line")]
    return (
        lines.select(*others, F.col(column).alias("__text"), F.trim(column, F.lit(" \t\r\n")).alias("__line"), parsed.alias("__all"), wrapped.alias("__json"))
        .select("*", F.col("__all").dropFields("__corrupt").alias("__event"), F.col("__all.__corrupt").alias("__corrupt"))
        .select("*", ok.alias("__ok"))
        .select(*out)
    )


def read_events(spark: SparkSession, path: str, *, rejects: bool = False) -> DataFrame:
    """event, blank, ingest_seq and file of every line of a file or folder; see ``decode`` for ``rejects``.

    The sequence follows files by name and lines by place, and needs no sort of the data.
    """
    return decode(in_order(lines_of(spark.read.text(path))), rejects=rejects)


def lines_of(text: DataFrame) -> DataFrame:
    """value, with the file and the start of the split that it comes from, of text files; for in_order."""
    return text.select(
        "value",
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__start"),
    )


#: Lines of a split that are dealt out together at most.
LINES_TOGETHER = 10_000


def in_order(text: DataFrame, *, splits_per_span: int = 1000) -> DataFrame:
    """value, ingest_seq, file: lines numbered from 0 in order of (file, place), without gaps.

    A split lies in one task. Lines are dealt out once, by blocks of a split, so that the tasks that decode them have as many
    each; that shuffle serves both the count of each block's lines and the numbering. The counts are added up in two levels,
    within spans of about ``splits_per_span`` blocks and over these, and joined back; nothing goes through the driver.
    """
    here = ["__file", "__start", "__block"]
    tasks = 4 * int(text.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = text.withColumn("__row", F.monotonically_increasing_id())
    at = F.col("__row").bitwiseAND(F.lit((1 << 33) - 1))  # a line's place in its task
    block = F.coalesce(F.floor(at / LINES_TOGETHER), F.lit(0))  # never null, else the join's filter would part its shuffle from the counts'
    dealt = rows.withColumn("__block", block).repartition(tasks, *here)
    # counting the values, and placing blocks by all their columns, keep Catalyst from reading the text apart for the counts
    splits = dealt.groupBy(*here).agg(F.min("__row").alias("__first"), F.count("value").alias("__n")).withColumn("__all", F.lit(0))
    spanned = with_spans(splits, "__all", [*here, "__first", "__n"], splits_per_span)
    before = Window.partitionBy(SPAN).orderBy(*here).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy(SPAN).rowsBetween(Window.unboundedPreceding, -1)  # a row for each span
    tops = spanned.groupBy(SPAN).agg(F.sum("__n").alias("__n")).select(SPAN, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__top"))
    within = spanned.withColumn("__at", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    places = within.join(tops.hint("shuffle_hash"), SPAN).select(*here, (F.col("__top") + F.col("__at") - F.col("__first")).alias("__shift"))
    numbered = dealt.join(places.hint("shuffle_hash"), here)
    return numbered.select("value", (F.col("__row") + F.col("__shift")).alias(SEQ), F.col("__file").alias("file"))


def field_of(name: str) -> Column:
    """A column of a kind's table, from ``event``."""
    if name in ("t_ns", "entity_path"):
        return F.col(f"event.{name}")
    if name == "points":
        return F.transform("event.payload.points", lambda p: F.struct(p[0].alias("x"), p[1].alias("y"), p[2].alias("z")))
    return F.col(f"event.payload.{name}")


def table_of(events: DataFrame, kind: str) -> DataFrame:
    """The rows of one kind in its own columns, with ingest_seq. ``events`` has event and ingest_seq."""
    own = events.where(F.col("event.payload.kind") == kind)
    return own.select(*(field_of(f.name).alias(f.name) for f in schema(kind)), SEQ)


def write_json_rows(df: DataFrame, path: str) -> None:
    """A JSON object per row, as text files in a folder."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.text(path)
