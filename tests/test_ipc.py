"""Arrow IPC dumps: round trips, planning by record batch, commit and abort."""

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark import queries, schema
from tidemark.sources import ipc, snapshot_of

SF = "/root/testdata/sf0.001"


def same(a, b):
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.select(a.columns).collect()), key=repr)


def test_all_kinds_come_back(spark, tmp_path):
    tables = {k: queries._decoded(k)(spark, SF) for k in schema.KINDS}
    snap = snapshot_of(spark, tables, queries.DAY)
    path = f"file://{tmp_path}/dump"
    assert ipc.dump(snap, path) == list(schema.KINDS)
    back = ipc.load(spark, path, bucket_ns=queries.DAY)
    for kind in schema.KINDS:
        schema.check_table(back.table(kind), kind)
        same(snap.table(kind), back.table(kind))
    assert back.count_by_kind() == snap.count_by_kind()
    ipc.dump(snap, path)  # takes the place of the first
    assert ipc.load(spark, path).total_rows() == snap.total_rows()
    assert ipc.load(spark, path, ["Scalar"]).table("Points3D").count() == 0 == ipc.load(spark, f"file://{tmp_path}/none").total_rows()


def test_a_partition_for_some_record_batches(spark, tmp_path):
    path = f"file://{tmp_path}/d"
    rows = spark.range(1000).select("id", F.array("id", "id").alias("a"), F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("s"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        ipc.write_ipc(rows.coalesce(1), path)
        (name,) = (x for x in os.listdir(tmp_path / "d") if not x.startswith("."))
        assert pa.ipc.open_file(f"{tmp_path}/d/{name}").num_record_batches == 20
        back = ipc.read_ipc(spark, path, batches=3)
        assert back.rdd.getNumPartitions() == 7 and back.dtypes == rows.dtypes
        same(rows, back)
        same(rows.select("s"), ipc.read_ipc(spark, path, back.select("s").schema))
        ipc.write_ipc(rows.limit(10), path)
        assert ipc.read_ipc(spark, path).count() == 1010
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_failed_job_changes_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/d"
    ipc.write_ipc(spark.range(10), path)
    before = ipc._files(path)
    bad = spark.range(0, 1000, 1, 4).select(F.when(F.col("id") == 999, F.raise_error(F.lit("stop"))).otherwise(F.col("id")).cast("long").alias("id"))
    for overwrite in (False, True):
        with pytest.raises(Exception, match="stop"):
            ipc.write_ipc(bad, path, overwrite=overwrite)
    assert ipc._files(path) == before and ipc.read_ipc(spark, path).count() == 10


def test_no_rows(spark, tmp_path):
    path = f"file://{tmp_path}/d"
    ipc.write_ipc(spark.range(0), path)
    assert ipc.read_ipc(spark, path, spark.range(0).schema).count() == 0
    with pytest.raises(Exception, match="no file"):
        ipc.read_ipc(spark, path)
