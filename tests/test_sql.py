"""The operators as table functions of SQL."""

import random

import pytest

from tidemark import operators, schema
from tidemark.sources import Store, snapshot_of
from tidemark.sql import register_functions


@pytest.fixture(scope="module")
def rows():
    r = random.Random(9)
    xyz = lambda: [r.choice([0.0, -0.0, 1e-170, r.random(), 1e12 * r.random(), float(r.randrange(4))]) for _ in range(3)]
    return [(r.randrange(-5, 40), f"/e/{r.randrange(30)}", *xyz(), 0.0, 0.0, 0.0, 1.0) for _ in range(150)]


@pytest.fixture(scope="module")
def stored(spark, rows, tmp_path_factory):
    store = Store(spark, f"file://{tmp_path_factory.mktemp('s')}/s")
    store.append("Transform3D", spark.createDataFrame(rows, schema.schema("Transform3D")).coalesce(1))
    store.append("Scalar", spark.createDataFrame([(t, e, x, None) for t, e, x, *_ in rows], schema.schema("Scalar")).coalesce(1))
    snap = store.snapshot()
    register_functions(snap, "t_", rows_per_span=7)
    return snap


def same(a, b):
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


def test_calls_equal_the_python_form(spark, stored):
    poses, scalars = stored.table("Transform3D").drop("bucket_start_ns"), stored.table("Scalar").drop("bucket_start_ns")
    names = [c for c in poses.columns if c in poses.columns]
    for at in (-10, 3, 99):
        same(spark.sql(f"SELECT * FROM t_latest_at_scalar({at})"), operators.latest_at(scalars, at))
        same(spark.sql(f"SELECT * FROM t_latest_at_transform3d({at}, '/e/7')").select(names), operators.latest_at(poses, at, "/e/7"))
    same(spark.sql("SELECT * FROM t_range_scan_scalar(0, 9)"), operators.range_scan(scalars, 0, 9))
    same(spark.sql("SELECT * FROM t_range_scan_scalar(0, 9, '/e/3')"), operators.range_scan(scalars, 0, 9, "/e/3"))
    assert spark.sql("SELECT * FROM t_range_scan_scalar(9, 0)").count() == spark.sql("SELECT * FROM t_latest_at_points3d(9)").count() == 0
    same(spark.sql("SELECT * FROM t_speed_over_ground()"), operators.speed_over_ground(poses))
    same(spark.sql("SELECT * FROM t_speed_over_ground('/e/3', 2, 30)"), operators.speed_over_ground(poses, "/e/3", 2, 30))


@pytest.mark.parametrize("radius", [0.0, 1e-165, 0.3, 2.0, 1e11, 1e200])
def test_pairs_equal_the_python_form(spark, stored, radius):
    same(spark.sql(f"SELECT * FROM t_proximity_pairs(50, {radius!r}D)"), operators.proximity_pairs(stored.table("Transform3D"), 50, radius))


def test_a_bad_radius_raises(spark, stored):
    for radius in ("-1D", "double('NaN')", "double('Infinity')"):
        with pytest.raises(Exception, match="radius"):
            spark.sql(f"SELECT * FROM t_proximity_pairs(50, {radius})").collect()


def test_bounds_reach_the_scan(spark, stored):
    def pushed(query):
        plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(spark.sql(query)._jdf.queryExecution(), "formatted")
        return plan[plan.index("PushedFilters: [") :].partition("]")[0]

    assert "LessThanOrEqual(t_ns,5)" in pushed("SELECT * FROM t_latest_at_scalar(5)")
    found = pushed("SELECT value FROM t_range_scan_scalar(1, 5, '/e/3') WHERE value > 0.5")
    assert all(x in found for x in ("GreaterThanOrEqual(t_ns,1)", "LessThan(t_ns,5)", "EqualTo(entity_path,/e/3)", "GreaterThan(value,0.5)"))
    assert "EqualTo(entity_path,/e/3)" in pushed("SELECT * FROM t_speed_over_ground('/e/3')")


def test_functions_over_a_snapshot_of_frames(spark, rows):
    snap = snapshot_of(spark, {"Transform3D": spark.createDataFrame(rows, schema.schema("Transform3D"))})
    made = register_functions(snap, "u_")
    assert len(made) == 12 and spark.sql("SELECT * FROM u_latest_at_transform3d(99)").count() == len({e for _, e, *_ in rows})
