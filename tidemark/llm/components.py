"""Connected components by alternating large-star and small-star steps, as DataFrame jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import split_join, stored


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.shiftright(F.xxhash64("u", "v"), 20))).first()
    return row[0], row[1] or 0


def _hook(pairs: DataFrame, keep) -> DataFrame:
    """Of rows (u, v): link what keep selects to the smallest of u and its v."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return split_join(pairs, least, "u").transform(keep).where("u > v").distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node, component: every node that has a link, with the smallest node reachable from it.

    Rows with a null end or two equal ends make no link. Each round is written to the shared folder, so its
    lineage is one read. Stars shrink in a logarithmic number of rounds; minima are taken before the shuffle, and the
    join of a hub's links with its minimum has shuffles of its own, so that adaptive execution can split the hub. No links
    give an empty table.
    """
    edges = (
        links.where(f"{a} <> {b}")
        .select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
        .distinct()
        .transform(lambda d: stored(d, "links"))
    )
    before = _state(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _hook(both, lambda d: d.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        large = stored(large, "large-star")
        small = _hook(
            large,
            lambda d: d.select("v", "m").union(d.select("u", "m")).toDF("u", "v"),
        )
        edges = stored(small, "small-star")
        after = _state(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("u"), F.col("v")).distinct()
    return edges.union(roots).toDF("node", "component")
