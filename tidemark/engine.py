"""Queries over a snapshot, each with the counters of its plan."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row

from tidemark import operators as ops
from tidemark.functions.time import MAX_NS, MIN_NS, check_bounds
from tidemark.operators.proximity import check_radius
from tidemark.plans.manifest import QueryPlan, Timed, plan_of, reaches_latest, reaches_range
from tidemark.schema import columns, entity_path
from tidemark.sources.store import Snapshot


@dataclass
class Result:
    """Rows of a query as a DataFrame. ``stream`` brings them to the driver a partition at a time; ``plan`` counts, running the
    query only if they weren't streamed to the end; ``considered`` says how many rows the operator had (entities of a proximity query,
    samples of a speed query)."""

    rows: DataFrame
    _snapshot: Snapshot
    _kind: str
    _type: str
    _reaches: object
    _considered: DataFrame | None = None
    _returned: int | None = None
    _us: int = 0

    def stream(self) -> Iterator[Row]:
        """The rows in order, of which the driver holds one partition."""
        timed, n = Timed(), 0
        for row in self.rows.toLocalIterator():
            n += 1
            yield row
        self._returned, self._us = n, timed.us()

    def plan(self) -> QueryPlan:
        timed = Timed()
        returned = self.rows.count() if self._returned is None else self._returned
        us = self._us or timed.us()
        plan = plan_of(self._type, self._snapshot.manifest(), self._kind, self._reaches)
        plan.returned_rows, plan.latency_us = returned, us
        return plan

    def considered(self) -> int:
        return 0 if self._considered is None else self._considered.count()


def latest_at(snapshot: Snapshot, kind: str, at_ns: int, entity: str | None = None) -> Result:
    rows = ops.latest_at(snapshot.table(kind), at_ns, entity).select(*columns(kind))
    return Result(rows, snapshot, kind, "latest_at", reaches_latest(at_ns))


def range_scan(snapshot: Snapshot, kind: str, start_ns: int, end_ns: int, entity: str | None = None) -> Result:
    rows = ops.range_scan(snapshot.table(kind), start_ns, end_ns, entity, ordered=True).select(*columns(kind))
    return Result(rows, snapshot, kind, "range_scan", reaches_range(start_ns, end_ns))


def proximity_pairs(snapshot: Snapshot, at_ns: int, radius: float, method: str = "auto") -> Result:
    check_radius(radius)
    here = ops.latest_at(snapshot.table("Transform3D"), at_ns, ordered=False)
    rows = ops.near_pairs(here, at_ns, radius, method=method)
    return Result(rows, snapshot, "Transform3D", "proximity_pairs", reaches_latest(at_ns), here)


def speed_over_ground(snapshot: Snapshot, entity: str, start_ns: int | None = None, end_ns: int | None = None) -> Result:
    start, end = (MIN_NS if start_ns is None else start_ns), (MAX_NS if end_ns is None else end_ns)
    check_bounds(start, end)
    poses = snapshot.table("Transform3D")
    rows = ops.speed_over_ground(poses, entity_path(entity), start, end)
    return Result(rows, snapshot, "Transform3D", "speed_over_ground", reaches_range(start, end), ops.range_scan(poses, start, end, entity))
