"""As-of lookup at many instants, and the spans that entities are dealt out by."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark import errors, operators
from tidemark.operators.spans import SPAN, with_spans


def samples(spark, rows):
    return spark.createDataFrame(rows, "t_ns long, entity_path string, ingest_seq long, value double, tag string")


def instants(spark, rows):
    return spark.createDataFrame(rows, "t_ns long, entity_path string, name string")


def plain(asked, known, tolerance=None):
    out = []
    for t, e, name in asked:
        best = max((s for s in known if t is not None and s[0] is not None and s[1] == e and s[0] <= t), key=lambda s: (s[0], s[2]), default=None)
        if best and tolerance is not None and t - best[0] > tolerance:
            best = None
        out.append((t, e, name, *((best[0], *best[2:]) if best else (None,) * 4)))
    return sorted(out, key=repr)


def random_rows(r):
    who = ["/a", "/a", "/a", "/b", "/c", None]
    known = [(r.choice([None, *range(-20, 60)]), r.choice(who), i, float(i), r.choice(["x", None])) for i in range(150)]
    asked = [(r.choice([None, *range(-30, 70)]), r.choice([*who, "/none"]), f"q{i % 40}") for i in range(120)]
    return asked, known


@pytest.mark.parametrize("span", [None, 1, 3, 20, 10**9])
@pytest.mark.parametrize("tolerance", [None, 4])
def test_as_of_equals_loops(spark, span, tolerance):
    asked, known = random_rows(random.Random(5))
    got = operators.as_of(instants(spark, asked), samples(spark, known), rows_per_span=span, tolerance_ns=tolerance)
    assert got.columns == ["t_ns", "entity_path", "name", "sample_t_ns", "sample_ingest_seq", "sample_value", "sample_tag"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain(asked, known, tolerance)


def test_as_of_is_latest_at_for_each_instant(spark):
    _, known = random_rows(random.Random(6))
    rows = samples(spark, [s for s in known if s[0] is not None and s[1] is not None])
    at = instants(spark, [(t, e, "x") for t in (-25, 0, 17, 99) for e in ("/a", "/b", "/c")])
    got = {(r["t_ns"], r["entity_path"]): r["sample_value"] for r in operators.as_of(at, rows).collect()}
    for t in (-25, 0, 17, 99):
        latest = {r["entity_path"]: r["value"] for r in operators.latest_at(rows, t).collect()}
        assert {e: v for (x, e), v in got.items() if x == t and v is not None} == latest


def test_no_rows_and_clashing_names(spark):
    asked, known = random_rows(random.Random(7))
    none = samples(spark, known).where("false")
    assert operators.as_of(instants(spark, asked), none).where("sample_t_ns is null").count() == len(asked)
    assert operators.as_of(instants(spark, asked).where("false"), samples(spark, known)).count() == 0
    odd = instants(spark, asked).select("*", F.lit(1).alias("value"), F.lit(2).alias("a b.c"))
    assert operators.as_of(odd, samples(spark, known)).columns[3:5] == ["value", "a b.c"]
    with pytest.raises(errors.SchemaMismatch):
        operators.as_of(instants(spark, asked).withColumn("sample_value", F.lit(1)), samples(spark, known))


def test_no_join_on_ranges(spark):
    asked, known = random_rows(random.Random(8))
    plan = operators.as_of(instants(spark, asked), samples(spark, known))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_a_hot_sparse_entity_is_dealt_out_evenly(spark):
    """Samples a day apart, and a burst of them: spans follow the rows, not the time."""
    day = 86_400_000_000_000
    rows = spark.range(40_000).select((F.when(F.col("id") < 20_000, F.col("id") * day).otherwise(F.lit(20_000 * day) + F.col("id"))).alias("t_ns"), F.lit("/a").alias("entity_path"), F.col("id").alias("ingest_seq"))
    sizes = [r["count"] for r in with_spans(rows, "entity_path", ["t_ns", "ingest_seq"], 1000).groupBy(SPAN).count().collect()]
    assert 25 < len(sizes) < 60 and max(sizes) < 8000
    spanned = with_spans(rows, "entity_path", ["t_ns", "ingest_seq"], 1000)
    order = spanned.groupBy(SPAN).agg(F.min("t_ns").alias("a"), F.max("t_ns").alias("b")).orderBy(SPAN).collect()
    assert all(x["b"] < y["a"] for x, y in zip(order, order[1:]))
