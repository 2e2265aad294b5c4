"""Streams with state of their own."""

import random

import pyarrow as pa
import pytest

from tidemark import operators
from tidemark.streaming.latest import current_latest, fewer, follow_latest, latest_changes
from tidemark.streaming.ranges import follow_range, range_changes

ROW = "t_ns long, entity_path string, ingest_seq long, value double, unit string"


def write(spark, rows, folder):
    spark.createDataFrame(rows, ROW).coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder, files=1):
    return spark.readStream.schema(ROW).option("maxFilesPerTrigger", files).parquet(folder)


def some_rows(n, seed):
    r = random.Random(seed)
    rows = [(r.randrange(0, 30), r.choice(["/a", "/b", "/c", "/d"]), i, float(i), r.choice(["V", None])) for i in range(n)]
    r.shuffle(rows)
    return rows


def plain(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.fixture
def dirs(tmp_path):
    return [f"file://{tmp_path}/{x}" for x in ("in", "out", "checkpoint")]


def test_latest_of_shuffled_batches_with_restarts(spark, dirs):
    folder, out, checkpoint = dirs
    rows = some_rows(90, 1) + [(None, "/a", 999, 1.0, None), (99, "/e", None, 1.0, None), (5, None, 1000, 2.0, None), (4, None, 1001, 3.0, None)]
    for k in range(0, len(rows), 30):
        write(spark, rows[k : k + 30], folder)
        if k != 30:  # the second file waits for the third run
            follow_latest(stream(spark, folder), out, checkpoint).awaitTermination()
    changes = spark.read.schema(ROW).parquet(out)
    good = [x for x in rows if x[0] is not None and x[2] is not None]
    want = operators.latest_at(spark.createDataFrame(good, ROW), 1000).select(*changes.columns)
    assert plain(current_latest(changes).collect()) == plain(want.collect())
    n = changes.count()
    assert n < len(good)
    follow_latest(stream(spark, folder), out, checkpoint).awaitTermination()
    assert spark.read.schema(ROW).parquet(out).count() == n  # nothing is told twice


@pytest.mark.parametrize("held", [3, 20, 10_000])
def test_fewer_rows_reach_the_state(spark, held):
    rows = some_rows(400, 2) + [(5, None, 1000, 2.0, None), (4, None, 1001, None, "V"), (2**62 + 1, "/a", 2**53 + 1, None, None), (2**62, "/a", 2**60, 1.0, "V")]
    names = [c.split()[0] for c in ROW.split(", ")]
    types = [pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.string()]
    cut = [pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 30]), types)], names=names) for k in range(0, len(rows), 30)]
    left = [tuple(x.values()) for b in fewer("entity_path", held)(iter([*cut, cut[0].slice(0, 0)])) for x in b.to_pylist()]
    best = {}
    for x in rows:
        best[x[1]] = max(x, best.get(x[1], x), key=lambda y: (y[0], y[2]))
    assert set(best.values()) <= set(left) <= set(rows) and len(left) < len(rows)
    assert held < 10_000 or sorted(left, key=repr) == sorted(best.values(), key=repr)


def test_the_state_gets_what_is_left_of_a_micro_batch(spark, dirs):
    write(spark, some_rows(10, 3), dirs[0])
    plan = latest_changes(stream(spark, dirs[0]))._jdf.queryExecution().analyzed().toString()
    assert plan.index("TransformWithState") < plan.index("MapInArrow") < plan.index("RepartitionByExpression")


def test_latest_begins_with_a_snapshot(spark, dirs):
    folder, out, checkpoint = dirs
    before = spark.createDataFrame([(50, "/a", 1, 1.0, "V"), (1, "/b", 2, 2.0, "V")], ROW)
    write(spark, [(49, "/a", 3, 3.0, None), (50, "/a", 0, 4.0, None), (2, "/b", 4, 5.0, None)], folder)
    follow_latest(stream(spark, folder), out, checkpoint, initial=before).awaitTermination()
    assert plain(spark.read.schema(ROW).parquet(out).collect()) == [(2, "/b", 4, 5.0, None)]


SECOND = 1_000_000_000


@pytest.mark.parametrize("lateness,parts", [("0 seconds", 1), ("5 seconds", 3)])
def test_range_of_a_stream_equals_the_batch_scan(spark, dirs, lateness, parts):
    folder, out, checkpoint = dirs
    r = random.Random(4)
    times = sorted(r.randrange(0, 30 * SECOND) for _ in range(80))
    for _ in range(25):  # some come late
        i = r.randrange(70)
        j = i + r.randrange(10)
        times[i], times[j] = times[j], times[i]
    rows = [(t, r.choice(["/a", "/b", "/c"]), i, float(i), None) for i, t in enumerate(times)] + [(60 * SECOND, "/a", 80, 0.0, None), (None, "/a", 81, 0.0, None)]
    for k in range(0, len(rows), 20):
        write(spark, rows[k : k + 20], folder)
        changes = range_changes(stream(spark, folder), 3 * SECOND, 22 * SECOND, bucket_ns=2 * SECOND, lateness=lateness, parts=parts)
        follow_range(changes, out, checkpoint).awaitTermination()
    found = spark.read.parquet(out).collect()
    want = operators.range_scan(spark.createDataFrame(rows, ROW), 3 * SECOND, 22 * SECOND).collect()
    assert plain(tuple(r)[:5] for r in found) == plain(want)
    late = [r for r in found if r["is_late"]]
    assert len(late) < len(found) and bool(late) == (lateness == "0 seconds")
    assert all(r["bucket_start_ns"] == r["t_ns"] // (2 * SECOND) * 2 * SECOND for r in found)
