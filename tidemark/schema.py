"""Kinds of events, their tables, and the raw event of JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import InvalidEntityPath, SchemaMismatch, UnknownKind

_LONG, _TEXT, _DOUBLE, _INT = T.LongType(), T.StringType(), T.DoubleType(), T.IntegerType()
_POINT = T.StructType([T.StructField(c, _DOUBLE, False) for c in "xyz"])

PREFIX = [("t_ns", _LONG), ("entity_path", _TEXT)]

# Kinds in their order, and the columns of each after the common prefix.
KINDS = {
    "Transform3D": [(c, _DOUBLE) for c in ("tx", "ty", "tz", "qx", "qy", "qz", "qw")],
    "Points3D": [("points", T.ArrayType(_POINT, False))],
    "Scalar": [("value", _DOUBLE), ("unit", _TEXT)],
    "ImageRef": [("uri", _TEXT), ("width", _INT), ("height", _INT), ("format", _TEXT)],
    "Annotation": [("label", _TEXT)],
}

#: Columns that may be null.
NULLABLE = {"unit"}

#: Columns that the store adds to each row: arrival order, and the start of the row's time bucket.
SEQ, BUCKET = "ingest_seq", "bucket_start_ns"

RAW = (
    "entity_path string, timeline string, t_ns long, component string, payload struct<kind:string,"
    "tx:double,ty:double,tz:double,qx:double,qy:double,qz:double,qw:double,points:array<array<double>>,"
    "value:double,unit:string,uri:string,width:int,height:int,format:string,label:string>"
)

TIMELINES = ("wall_time", "sim_time")


def check_kind(kind: str) -> str:
    if kind not in KINDS:
        raise UnknownKind(f"{kind!r} is none of {', '.join(KINDS)}")
    return kind


def ordinal(kind: str) -> int:
    return list(KINDS).index(check_kind(kind))


def schema(kind: str) -> T.StructType:
    return T.StructType([T.StructField(n, t, n in NULLABLE) for n, t in PREFIX + KINDS[check_kind(kind)]])


def columns(kind: str) -> list[str]:
    """Names of a kind's columns, common prefix first."""
    return schema(kind).names


def check_table(df: DataFrame, kind: str) -> None:
    """Raise unless ``df`` has the columns of the kind with their types; nullability and more columns don't matter."""
    have = dict(df.dtypes)
    for f in schema(kind):
        if have.get(f.name) != f.dataType.simpleString():
            raise SchemaMismatch(f"{kind}: column {f.name} is {have.get(f.name)}, not {f.dataType.simpleString()}")


def entity_path(path: str) -> str:
    """An entity path as a query's argument: it begins with one slash, has a name, and no empty name inside."""
    if not path.startswith("/") or path == "/" or "//" in path:
        raise InvalidEntityPath(f"{path!r} must begin with '/', be longer than that, and not hold '//'")
    return path


def valid_path(c: Column) -> Column:
    """The same as a predicate on a column."""
    return c.startswith("/") & (F.length(c) > 1) & ~c.contains("//")
