"""The operators as table functions of SQL, over the tables of a snapshot.

They are functions whose body is a query, so Catalyst puts their arguments in as literals: bounds of time and entity reach the
scan, and what surrounds a call is optimized together with it. An argument of null is no bound.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from tidemark.functions.time import MAX_NS, MIN_NS
from tidemark.operators.proximity import FAR
from tidemark.operators.spans import ROWS_PER_SPAN
from tidemark.schema import KINDS, SEQ, columns, schema
from tidemark.sources.store import Snapshot

_SPEED = "entity_path STRING, t_start_ns BIGINT, t_end_ns BIGINT, dt_ns BIGINT, distance_m DOUBLE, speed_mps DOUBLE"
_PAIRS = "at_ns BIGINT, entity_a STRING, entity_b STRING, distance DOUBLE"


def _declared(kind: str) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema(kind)) + f", {SEQ} bigint"


def _latest(view: str, kind: str) -> str:
    others = ", ".join(c for c in [*columns(kind), SEQ] if c != "entity_path")
    out = ", ".join("entity_path" if c == "entity_path" else f"best.{c}" for c in [*columns(kind), SEQ])
    return f"""
SELECT {out} FROM (
  SELECT entity_path, max_by(struct({others}), struct(t_ns, {SEQ})) AS best FROM {view}
  WHERE t_ns <= at_ns AND (entity IS NULL OR entity_path = entity) GROUP BY entity_path)"""


def _range(view: str, kind: str) -> str:
    return f"""
SELECT {', '.join([*columns(kind), SEQ])} FROM {view}
WHERE t_ns >= coalesce(start_ns, {MIN_NS}) AND t_ns < coalesce(end_ns, {MAX_NS}) AND (entity IS NULL OR entity_path = entity)"""


def _speed(scan: str, rows_per_span: int) -> str:
    """Spans as in tidemark.operators.spans."""
    value = "struct(t_ns, tx, ty, tz)"
    return f"""
WITH s AS (SELECT entity_path, t_ns, tx, ty, tz, {SEQ} FROM {scan}(start_ns, end_ns, entity)),
bounds AS (SELECT entity_path, sort_array(collect_set(struct(t_ns, {SEQ}))) AS bounds FROM s
  WHERE pmod(xxhash64(entity_path, t_ns, {SEQ}), {rows_per_span}) = 0 GROUP BY entity_path),
spanned AS (SELECT s.*, coalesce(size(filter(bounds, b -> b <= struct(s.t_ns, s.{SEQ}))), 0) AS span
  FROM s LEFT JOIN bounds ON s.entity_path <=> bounds.entity_path),
handed AS (SELECT entity_path, span, lag(last_row) OVER (PARTITION BY entity_path ORDER BY span) AS carried
  FROM (SELECT entity_path, span, max_by({value}, struct(t_ns, {SEQ})) AS last_row FROM spanned GROUP BY entity_path, span)),
paired AS (SELECT entity_path, span, t_ns, tx, ty, tz, lag({value}) OVER (PARTITION BY entity_path, span ORDER BY t_ns, {SEQ}) AS before FROM spanned),
filled AS (SELECT p.entity_path, p.t_ns, p.tx, p.ty, p.tz, coalesce(p.before, h.carried) AS before
  FROM paired p LEFT JOIN handed h ON p.entity_path <=> h.entity_path AND p.span = h.span),
far AS (SELECT entity_path, before.t_ns AS t0, t_ns AS t1, sqrt((tx - before.tx) * (tx - before.tx) + (ty - before.ty) * (ty - before.ty)
  + (tz - before.tz) * (tz - before.tz)) AS distance FROM filled WHERE t_ns > before.t_ns)
SELECT entity_path, t0, t1, t1 - t0, distance, distance / (CAST(t1 - t0 AS DOUBLE) * 1e-9D) FROM far"""


def _pairs(latest: str) -> str:
    """Cells as in tidemark.operators.proximity; a least width takes the place of its join on coordinates for a radius of 0."""
    plain, axes = -100_000, ("tx", "ty", "tz")
    key = lambda d: ", ".join(f"CAST(floor({c} / width) AS BIGINT){d} AS k{c}" for c in axes)
    square = "(" + " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in axes) + ")"
    bad = "raise_error('the radius must be finite and not negative')"
    return f"""
WITH p AS (SELECT entity_path, tx, ty, tz, greatest(abs(tx), abs(ty), abs(tz)) AS far,
  CASE WHEN radius >= 0 AND radius < double('Infinity') THEN greatest(radius * (1 + power(2D, -20)), 1e-150D) ELSE {bad} END AS cell
  FROM {latest}(at, NULL) WHERE {' AND '.join(f"abs({c}) < double('Infinity')" for c in axes)}),
q AS (SELECT *, CAST(ceil(log2(far)) AS INT) AS power FROM p),
own AS (SELECT *, {key('')} FROM (SELECT *, CASE WHEN level = {plain} THEN cell ELSE power(2D, level - 30) END AS width
  FROM (SELECT *, CASE WHEN far < cell * {FAR!r}D THEN {plain} ELSE power END AS level FROM q))),
levels AS (SELECT *, explode(CASE WHEN far < cell * {FAR - 4!r}D THEN array({plain})
  WHEN far < cell * {FAR + 4!r}D THEN array({plain}, power - 1, power, power + 1) ELSE array(power - 1, power, power + 1) END) AS level FROM q),
spread AS (SELECT *, x.d AS dx, y.d AS dy, z.d AS dz FROM (SELECT *, CASE WHEN level = {plain} THEN cell ELSE power(2D, level - 30) END AS width FROM levels)
  LATERAL VIEW explode(array(-1, 0, 1)) x AS d LATERAL VIEW explode(array(-1, 0, 1)) y AS d LATERAL VIEW explode(array(-1, 0, 1)) z AS d),
around AS (SELECT entity_path, tx, ty, tz, level, {', '.join(f"CAST(floor({c} / width) AS BIGINT) + d{c[1]} AS k{c}" for c in axes)} FROM spread)
SELECT at, a.entity_path, b.entity_path, sqrt({square}) FROM own a JOIN around b
ON a.level = b.level AND {' AND '.join(f'a.k{c} = b.k{c}' for c in axes)}
WHERE a.entity_path < b.entity_path AND {square} <= radius * radius"""


def register_functions(snapshot: Snapshot, prefix: str = "", *, rows_per_span: int = ROWS_PER_SPAN) -> list[str]:
    """Make temporary views and functions of a snapshot; their names are returned.

    ``latest_at_<kind>(at_ns, entity)``, ``range_scan_<kind>(start_ns, end_ns, entity)``, ``speed_over_ground(entity, start_ns, end_ns)``
    and ``proximity_pairs(at, radius)``. They answer as the operators do, without an order of rows; an entity of null is every
    entity. A radius that is negative or not finite raises when the query runs; a start after the end gives no rows.
    """
    spark: SparkSession = snapshot.spark
    snapshot.register_views(prefix)
    made: list[str] = []

    def make(name: str, arguments: str, returns: str, body: str) -> None:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({arguments}) RETURNS TABLE ({returns}) RETURN {body}")
        made.append(prefix + name)

    for kind in KINDS:
        view = prefix + kind.lower()
        make(f"latest_at_{kind.lower()}", "at_ns BIGINT, entity STRING DEFAULT NULL", _declared(kind), _latest(view, kind))
        make(f"range_scan_{kind.lower()}", "start_ns BIGINT, end_ns BIGINT, entity STRING DEFAULT NULL", _declared(kind), _range(view, kind))
    bounds = "entity STRING DEFAULT NULL, start_ns BIGINT DEFAULT NULL, end_ns BIGINT DEFAULT NULL"
    make("speed_over_ground", bounds, _SPEED, _speed(f"{prefix}range_scan_transform3d", rows_per_span))
    make("proximity_pairs", "at BIGINT, radius DOUBLE", _PAIRS, _pairs(f"{prefix}latest_at_transform3d"))
    return made
