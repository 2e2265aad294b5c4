"""Pairs of entities that are near each other at one instant."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.errors import InvalidRadius
from tidemark.operators.latest import latest_at

#: Cells from the origin within which rounding can't move a point by more than one cell.
FAR = 2.0**30
#: Coordinates below this may differ by so little that the square of the difference is 0.
TINY = 1e-140
#: The level of points that lie within FAR cells.
_PLAIN = -100_000
_AXES = ("tx", "ty", "tz")
_CELL = ["__level", *(f"__{c}" for c in _AXES)]
#: Points of a cell, and of one side of a block, beyond which they are divided; how often a cell is halved at most.
CROWD, DEPTH = 1000, 3
#: By how much of a cell's width parts of it are taken wider.
EDGE = 2.0**-16


def check_radius(radius: float) -> float:
    if not (math.isfinite(radius) and radius >= 0):
        raise InvalidRadius(f"radius {radius} must be finite and not negative")
    return float(radius)


def _pairs(a: DataFrame, b: DataFrame, at_ns: int, radius: float, on: Column) -> DataFrame:
    dx, dy, dz = (F.col(f"a.{c}") - F.col(f"b.{c}") for c in _AXES)
    d2 = dx * dx + dy * dy + dz * dz
    near = on & (F.col("a.entity_path") < F.col("b.entity_path")) & (d2 <= F.lit(radius * radius))
    return a.alias("a").join(b.alias("b"), near).select(
        F.lit(at_ns).cast("long").alias("at_ns"),
        F.col("a.entity_path").alias("entity_a"),
        F.col("b.entity_path").alias("entity_b"),
        F.sqrt(d2).alias("distance"),
    )


def _same_place(points: DataFrame, at_ns: int, radius: float) -> DataFrame:
    """Pairs of points whose distance has the square 0: an equality join on the coordinates, tiny ones counting as 0."""
    keys = [F.when(F.abs(c) < TINY, 0.0).otherwise(F.col(c)).alias(f"__{c}") for c in _AXES]
    keyed = points.select("*", *keys)
    on = F.lit(True)
    for c in _AXES:
        on = on & (F.col(f"a.__{c}") == F.col(f"b.__{c}"))
    return _pairs(keyed, keyed, at_ns, radius, on)


def _left(value: Column, by: Column) -> Column:
    return F.call_function("shiftleft", value, by)


def _crowded(own: DataFrame) -> DataFrame:
    """The cells of more than CROWD points, with __depth: how often they are halved along each axis."""
    depth = F.least(F.lit(DEPTH), F.ceil(F.log(F.col("n") / CROWD) / math.log(8)).cast("int"))
    return own.groupBy(*_CELL).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWD).select(*_CELL, depth.alias("__depth"))


def _parts_in_reach(radius: float) -> Column:
    """Numbers of the parts of a divided cell that a ball about a point touches.

    Part s has the coordinates (s, s >> depth, s >> 2 * depth), each of depth bits. The parts are taken EDGE wider than they
    are, which is more than rounding moves a point.
    """
    side = _left(F.lit(1), F.col("__depth"))

    def reached(s: Column) -> Column:
        square = F.lit(0.0)
        for n, c in enumerate(_AXES):
            at = (F.col(c) / F.col("__width") - F.col(f"__{c}")) * side  # in parts
            low = F.call_function("shiftrightunsigned", s, F.col("__depth") * n).bitwiseAND(side - 1)
            off = F.greatest(low - at, at - low - 1, F.lit(0.0)) / side - EDGE
            square = square + F.when(off > 0, off * off).otherwise(0.0)
        return square <= F.pow(F.lit(radius) / F.col("__width"), 2) * (1 + EDGE)

    return F.filter(F.sequence(F.lit(0), _left(F.lit(1), F.col("__depth") * 3) - 1), reached)


def _divided(own: DataFrame, around: DataFrame, radius: float) -> tuple[DataFrame, DataFrame]:
    """Both sides with the part of their cell as __part and the block of that part as __i and __j.

    A cell of many points is divided by a tree of up to DEPTH levels, and a point is put only into the parts that it can be near
    to. What is left in one part, points at one spot at last, is dealt into blocks: all pairs of them meet, each of about CROWD
    points, so no key has more of the points that stand in a part, and work is dealt out evenly over many keys.
    """
    crowded = _crowded(own)
    number = F.lit(0)
    for n, c in enumerate(_AXES):
        side = _left(F.lit(1), F.col("__depth"))
        at = F.floor((F.col(c) / F.col("__width") - F.col(f"__{c}")) * side).cast("int")
        at = F.greatest(F.lit(0), F.least(side - 1, at))
        number = number.bitwiseOR(_left(at, F.col("__depth") * n))
    own = own.join(crowded, _CELL, "left").withColumn("__part", F.when(F.col("__depth").isNull(), 0).otherwise(number))
    around = around.join(crowded, _CELL, "left")
    parts = F.when(F.col("__depth").isNull(), F.array(F.lit(0))).otherwise(_parts_in_reach(radius))
    around = around.withColumn("__part", F.explode(parts))
    key = [*_CELL, "__part"]
    many = own.where("__depth is not null").groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / CROWD).cast("int").alias("__blocks")).where("__blocks > 1")
    first, every = F.array(F.lit(0)), F.sequence(F.lit(0), F.col("__blocks") - 1)
    one = F.col("__blocks").isNull()
    block = lambda seed: F.when(one, 0).otherwise(F.pmod(F.xxhash64("entity_path", F.lit(seed)), F.col("__blocks")).cast("int"))
    spread = F.explode(F.when(one, first).otherwise(every))
    own = own.join(many, key, "left").withColumn("__i", block(1)).withColumn("__j", spread)
    around = around.join(many, key, "left").withColumn("__j", block(2)).withColumn("__i", spread)
    return own, around


def _in_cells(points: DataFrame, at_ns: int, radius: float) -> DataFrame:
    """Pairs of points in neighbouring cells.

    Cells are a little wider than the radius. Points beyond FAR of them are put into cells of the 2**-30th part of their own
    power of two instead: near points have the same power or neighbouring ones. So every pair meets by equal keys.
    """
    cell = radius * (1 + 2.0**-20)
    far = F.greatest(*(F.abs(c) for c in _AXES))
    power = F.ceil(F.log2(far)).cast("int")
    plain = F.lit(_PLAIN)
    width = F.when(F.col("__level") == plain, F.lit(cell)).otherwise(F.pow(F.lit(2.0), F.col("__level") - 30))
    key = [F.floor(F.col(c) / F.col("__width")).cast("long").alias(f"__{c}") for c in _AXES]
    own = points.withColumn("__level", F.when(far < cell * FAR, plain).otherwise(power))
    own = own.withColumn("__width", width).select("*", *key)
    levels = (
        F.when(far < cell * (FAR - 4), F.array(plain))
        .when(far < cell * (FAR + 4), F.array(plain, power - 1, power, power + 1))
        .otherwise(F.array(power - 1, power, power + 1))
    )
    around = points.withColumn("__level", F.explode(levels)).withColumn("__width", width).select("*", *key)
    for c in _AXES:
        k = F.col(f"__{c}")
        around = around.withColumn(f"__{c}", F.explode(F.array(k - 1, k, k + 1)))
    own, around = _divided(own, around, radius)
    on = F.lit(True)
    for c in [*_CELL, "__part", "__i", "__j"]:
        on = on & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    return _pairs(own, around, at_ns, radius, on)


def near_pairs(poses: DataFrame, at_ns: int, radius: float, *, method: str = "auto", ordered: bool = True) -> DataFrame:
    """at_ns, entity_a, entity_b, distance of pairs a < b of rows (entity_path, tx, ty, tz) with d² <= r².

    ``auto`` joins on equal keys: on the coordinates where the radius has the square 0, else on the 27 cells around a point,
    so that work follows the near pairs. Only a radius whose square is infinite makes every pair a candidate, as every
    pair is in the result then. ``nested`` compares all pairs, for comparison on small inputs. Points that aren't finite are
    near to none.
    """
    radius = check_radius(radius)
    points = poses.select("entity_path", *(F.col(c).cast("double").alias(c) for c in _AXES))
    points = points.where(" and ".join(f"abs({c}) < double('Infinity')" for c in _AXES))
    square = radius * radius
    if method == "nested" or math.isinf(square):
        out = _pairs(points, points, at_ns, radius, F.lit(True))
    elif square == 0:
        out = _same_place(points, at_ns, radius)
    else:
        out = _in_cells(points, at_ns, radius)
    return out.orderBy("entity_a", "entity_b") if ordered else out


def proximity_pairs(poses: DataFrame, at_ns: int, radius: float, *, method: str = "auto", ordered: bool = True) -> DataFrame:
    """``near_pairs`` of where each entity was last seen at ``at_ns``, however long before."""
    check_radius(radius)
    here = latest_at(poses.select("t_ns", "entity_path", "ingest_seq", *_AXES), at_ns, ordered=False)
    return near_pairs(here, at_ns, radius, method=method, ordered=ordered)
