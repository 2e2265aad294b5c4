"""Every registered query of the event engine against DuckDB on the same tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark import queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = duck.sql(f"SELECT {', '.join(cols)} FROM ({entry.oracle_sql()[name]})")
    assert plain(df.select(cols).collect()) == plain(want.fetchall())


def test_every_core_query_has_sql():
    assert set(queries.queries()) == set(queries.oracle_sql())


@pytest.mark.parametrize("name,pushed", [("range_scan_entity", ("GreaterThanOrEqual(ts,", "LessThan(ts,", "EqualTo(user_id,8)")), ("latest_at_entity", ("LessThan(ts,", "EqualTo(user_id,8)")), ("speed_window", ("LessThan(ts,", "EqualTo(user_id,8)")), ("proximity_pairs", ("LessThan(o_orderdate,",))])
def test_bounds_reach_the_scan(spark, name, pushed):
    df = entry.queries()[name](spark, SF)
    plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    filters = plan[plan.index("PushedFilters: [") :].partition("]")[0]
    assert all(p in filters for p in pushed), filters
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_queries_need_no_session():
    import subprocess
    import sys

    root = entry.__file__.rpartition("/")[0]
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    got = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=60)
    assert got.returncode == 0, got.stderr


def test_entry(spark):
    assert entry.entry(spark).count() > 0
