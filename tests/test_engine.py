"""Hand-made fixtures of the operators, the store and the plan counters."""

import hashlib
import json
import struct

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark import engine, errors, operators, schema
from tidemark.functions.time import bucket_of
from tidemark.sources import generator, snapshot_of
from tidemark.sources.store import Store, empty_snapshot, validate

B = 1_000_000_000


def poses(spark, rows):
    full = [(t, e, float(x), *map(float, rest), *([0.0] * (2 - len(rest))), 0.0, 0.0, 0.0, 1.0) for e, t, x, *rest in rows]
    return spark.createDataFrame(full, schema.schema("Transform3D"))


def snap(spark, rows, more=()):
    df = poses(spark, rows).coalesce(1).withColumn("ingest_seq", F.monotonically_increasing_id())
    return snapshot_of(spark, {"Transform3D": df, **dict(more)})


def tx(result):
    return [r["tx"] for r in result.rows.collect()]


def test_kinds_and_paths():
    assert list(schema.KINDS) == ["Transform3D", "Points3D", "Scalar", "ImageRef", "Annotation"]
    assert len({tuple(schema.columns(k)) for k in schema.KINDS}) == 5
    assert all(schema.columns(k)[:2] == ["t_ns", "entity_path"] for k in schema.KINDS)
    with pytest.raises(errors.UnknownKind):
        schema.check_kind("transform3d")
    for bad in ("", "/", "a", "/a//b", "//"):
        with pytest.raises(errors.InvalidEntityPath):
            schema.entity_path(bad)
    assert schema.entity_path("/a/") == "/a/" and "/robot/10" < "/robot/2"


def test_latest_at(spark):
    s = snap(spark, [("/agent/1", 100, 1), ("/agent/1", 200, 2), ("/agent/1", 300, 3)])
    assert tx(engine.latest_at(s, "Transform3D", 250)) == [2.0]
    assert tx(engine.latest_at(s, "Transform3D", 99)) == []
    assert engine.latest_at(s, "Transform3D", 250).rows.columns == schema.columns("Transform3D")
    s = snap(spark, [("/a/1", 100, 1), ("/a/2", 150, 2.5), ("/a/3", 180, 9), ("/a/1", 200, 2)])
    assert tx(engine.latest_at(s, "Transform3D", 300)) == [2.0, 2.5, 9.0]
    assert tx(engine.latest_at(s, "Transform3D", 300, "/a/3")) == [9.0]
    assert tx(engine.latest_at(s, "Transform3D", 300, "/none")) == []
    assert engine.latest_at(empty_snapshot(spark), "Scalar", -5).rows.collect() == []


def test_ties_go_to_the_last_arrival(spark, tmp_path):
    assert tx(engine.latest_at(snap(spark, [("/a", 100, 1), ("/a", 100, 2)]), "Transform3D", 100)) == [2.0]
    store = Store(spark, f"file://{tmp_path}/s")
    store.append("Transform3D", poses(spark, [("/a", 100, 1)]))
    store.append("Transform3D", poses(spark, [("/a", 100, 7)]))
    assert tx(engine.latest_at(store.snapshot(), "Transform3D", 100)) == [7.0]


def test_counters(spark):
    s = snap(spark, [("/a", 100, 1), ("/a", 2 * B, 2), ("/a", 4 * B, 3)])
    r = engine.latest_at(s, "Transform3D", B + 500)
    p = r.plan()
    assert (p.candidate_partitions, p.scanned_partitions, p.pruned_by_time, tx(r)) == (3, 1, 2, [1.0])
    notes = spark.createDataFrame([(100, "/a", "hello")], schema.schema("Annotation"))
    p = engine.latest_at(snap(spark, [("/a", 100, 1)], {"Annotation": notes}.items()), "Transform3D", 1000).plan()
    assert (p.candidate_partitions, p.pruned_by_kind, p.returned_rows) == (2, 1, 1)
    s = snap(spark, [("/a", 0, 1), ("/a", 2 * B, 2), ("/a", 4 * B, 3)])
    p = engine.range_scan(s, "Transform3D", 2 * B, 3 * B).plan()
    assert (p.candidate_partitions, p.scanned_partitions, p.pruned_by_time, p.returned_rows, p.scanned_rows) == (3, 1, 2, 1, 1)
    assert p.query_type == "range_scan" and p.latency_us > 0


def test_range_scan(spark):
    s = snap(spark, [("/a", t, t) for t in (100, 200, 300, 400)])
    assert tx(engine.range_scan(s, "Transform3D", 200, 400)) == [200.0, 300.0]
    assert tx(engine.range_scan(s, "Transform3D", 150, 150)) == []
    with pytest.raises(errors.InvertedBounds):
        engine.range_scan(s, "Transform3D", 200, 100)
    s = snap(spark, [("/a/0", 100, 1), ("/a/1", 200, 2), ("/a/0", 300, 3)])
    assert tx(engine.range_scan(s, "Transform3D", 0, 1000, "/a/0")) == [1.0, 3.0]
    s = snap(spark, [("/a", B, 1), ("/a", 5, 2), ("/a", 3, 3)])
    assert tx(engine.range_scan(s, "Transform3D", 0, 2 * B)) == [2.0, 3.0, 1.0]


@pytest.mark.parametrize("method", ["nested", "grid", "auto"])
def test_proximity(spark, method):
    near = lambda rows, at, r: [tuple(x)[1:] for x in engine.proximity_pairs(snap(spark, rows), at, r, method).rows.collect()]
    assert near([("/a/0", 100, 0), ("/a/1", 100, 1), ("/a/2", 100, 10)], 100, 2.0) == [("/a/0", "/a/1", 1.0)]
    assert near([("/a", 1, 0), ("/b", 1, 10)], 1, 1.0) == []
    assert near([("/a", 1, 0), ("/b", 1, 3, 4)], 1, 5.0) == [("/a", "/b", 5.0)]
    moved = [("/a", 100, 0), ("/b", 100, 5), ("/a", 200, 0), ("/b", 200, 0)]
    assert near(moved, 150, 1.0) == [] and len(near(moved, 250, 1.0)) == 1
    assert near([("/c", 1, 0), ("/a", 1, 0), ("/b", 1, 0)], 1, 0.5) == [("/a", "/b", 0.0), ("/a", "/c", 0.0), ("/b", "/c", 0.0)]


def test_proximity_arguments(spark):
    s = snap(spark, [("/a", 1, 0), ("/b", 1, 0), ("/c", 1, float("nan"))])
    for bad in (-1.0, float("nan"), float("inf")):
        with pytest.raises(errors.InvalidRadius):
            engine.proximity_pairs(s, 1, bad)
    assert engine.proximity_pairs(s, 1, 0.0).rows.count() == 1
    assert engine.proximity_pairs(s, 1, 1e300).rows.count() == 1
    assert engine.proximity_pairs(s, 1, 1e-300).rows.count() == 1
    assert engine.proximity_pairs(s, 1, 1.0).considered() == 3


@pytest.mark.parametrize("scale,radius", [(1.0, 2.0), (1e12, 2.0), (2.0**31, 2.5), (1e300, 1e280), (1e-300, 2e-300), (1e-160, 0.0), (1e-320, 1e-320), (1.0, 1e200)])
def test_near_pairs_at_every_scale(spark, scale, radius):
    import random

    r = random.Random(3)
    far = [(f"/e/{i:03}", *(float(scale * r.choice([0, 1, -1, 1 + 2**-31, r.random()]) + radius * r.choice([0, 0.4, 1, -1.5])) for _ in "xyz")) for i in range(60)]
    far += [("/edge/0", radius * 2.0**30, 0.0, 0.0), ("/edge/1", radius * (2.0**30 + 1), 0.0, 0.0), ("/edge/2", radius * (2.0**30 - 0.5), radius / 2, 0.0), ("/e/neg", -0.0, 0.0, 0.0)]
    df = spark.createDataFrame(far, "entity_path string, tx double, ty double, tz double")
    pairs = lambda method: [tuple(x) for x in operators.near_pairs(df, 7, radius, method=method).collect()]
    assert pairs("auto") == pairs("nested") and pairs("auto")


def crowd(spark, n, spread, more=()):
    """Half of ``n`` points within ``spread`` of the origin's cell, the others wide apart."""
    import random

    r = random.Random(n)
    rows = [(f"/c/{i:05}", *(0.3 + spread * r.random() for _ in "xyz")) for i in range(n // 2)]
    rows += [(f"/f/{i:05}", *(1000 * r.random() for _ in "xyz")) for i in range(n // 2)]
    return spark.createDataFrame([*rows, *more], "entity_path string, tx double, ty double, tz double")


@pytest.mark.parametrize("spread,most", [(0.0, 5), (0.4, 1), (1.5, 1), (4.0, 5)])
def test_crowded_cells_lose_no_pair(spark, monkeypatch, spread, most):
    from tidemark.operators import proximity

    monkeypatch.setattr(proximity, "CROWD", most)
    df = crowd(spark, 100, spread, [("/edge/0", 1.0, 1.0, 1.0), ("/edge/1", 2.0, 1.0, 1.0), ("/edge/2", 1.0, -1e9, 1.0), ("/edge/3", 1.0, -1e9 - 1, 1.0)])
    pairs = lambda method: [tuple(x) for x in operators.near_pairs(df, 7, 1.0, method=method).collect()]
    assert pairs("auto") == pairs("nested") and len(pairs("auto")) > 20


def test_half_of_all_points_in_a_cell_are_dealt_out(spark, monkeypatch):
    from tidemark.operators import proximity

    monkeypatch.setattr(proximity, "CROWD", 50)
    seen = {}
    divided = proximity._divided
    monkeypatch.setattr(proximity, "_divided", lambda *a: seen.setdefault("sides", divided(*a)))
    for spread in (0.0, 0.9):
        seen.clear()
        operators.near_pairs(crowd(spark, 4000, spread), 7, 1.0)
        own, around = seen["sides"]
        key = [*proximity._CELL, "__part", "__i", "__j"]
        left, right = (x.groupBy(*key).count() for x in (own, around))
        work = left.join(right.withColumnRenamed("count", "m"), key).select((F.col("count") * F.col("m")).alias("w"))
        shares = [r["w"] for r in work.groupBy(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(8)).alias("task")).agg(F.sum("w").alias("w")).collect()]
        assert max(shares) <= 2 * sorted(shares)[len(shares) // 2]
        assert left.agg(F.max("count")).first()[0] <= 3 * 50


def test_near_pairs_join_on_equal_keys(spark):
    df = spark.createDataFrame([("/a", 1.0, 2.0, 3.0)], "entity_path string, tx double, ty double, tz double")
    for radius in (0.0, 0.5):
        plan = operators.near_pairs(df, 0, radius)._jdf.queryExecution().optimizedPlan().toString()
        assert "Join Inner, " in plan and "__tx" in plan and "__tz" in plan


@pytest.mark.parametrize("span", [1, 2, 5, 30, 10**9])
def test_speed_does_not_depend_on_spans(spark, span):
    import random

    r = random.Random(2)
    rows = [(f"/e/{r.randrange(3)}", r.randrange(-20, 40), r.randrange(9)) for _ in range(120)]
    t = snap(spark, rows).table("Transform3D")
    want = [tuple(x) for x in operators.speed_over_ground(t, rows_per_span=None).collect()]
    assert [tuple(x) for x in operators.speed_over_ground(t, rows_per_span=span).collect()] == want and len(want) > 60


@pytest.mark.parametrize("span", [1, 3, 10**6])
def test_order_of_arrival_is_over_all_entities(spark, span):
    order = lambda *times: validate(snap(spark, [(f"/{'ab'[i % 2]}", t, 0) for i, t in enumerate(times)]), "Transform3D", rows_per_span=span)
    assert order(1, 2, 2, 3, 7, 9, 9, 12) and order(5) and order()
    assert not order(2, 1) and not order(1, 2, 3, 4, 5, 4) and not order(9, 1, 2, 3)


def test_speed(spark):
    s = snap(spark, [("/a", i * B, i) for i in range(11)])
    r = engine.speed_over_ground(s, "/a")
    rows = r.rows.collect()
    assert len(rows) == 10 and r.considered() == 11 and all(abs(x["speed_mps"] - 1) < 1e-9 for x in rows)
    assert engine.speed_over_ground(snap(spark, [("/a", 1, 0)]), "/a").rows.count() == 0
    assert engine.speed_over_ground(s, "/a", B, 3 * B).rows.count() == 1
    r = engine.speed_over_ground(snap(spark, [("/a", 100, 0), ("/a", 100, 5), ("/a", B + 100, 1)]), "/a")
    assert [x["distance_m"] for x in r.rows.collect()] == [4.0]
    s = snap(spark, [("/a/1", 0, 0), ("/a/1", B, 1), ("/a/2", B // 2, 7)])
    assert [x["speed_mps"] for x in engine.speed_over_ground(s, "/a/1").rows.collect()] == [1.0]
    with pytest.raises(errors.InvertedBounds):
        engine.speed_over_ground(s, "/a/1", 5, 1)


def test_store_partitions_and_snapshots(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    assert store.snapshot().num_partitions() == 0 and store.append("Transform3D", poses(spark, [])) == 0
    store.append("Transform3D", poses(spark, [("/a", t, 0) for t in (0, B // 2, B - 1, B, B + 10)]))
    held = store.snapshot()
    got = sorted(tuple(r)[1:] for r in held.manifest().collect())
    assert got == [(0, 3, 0, B - 1), (B, 2, B, B + 10)]
    store.append("Transform3D", poses(spark, [("/a", t, 0) for t in (5, 3 * B, 1)]))
    assert (held.total_rows(), held.table("Transform3D").count()) == (5, 5)
    now = store.snapshot()
    assert (now.total_rows(), now.num_partitions(), now.table("Transform3D").count()) == (8, 3, 8)
    assert now.count_by_kind() == {"Transform3D": 8} and list(now.by_kind()) == ["Transform3D"]
    assert not validate(now, "Transform3D") and validate(held, "Transform3D")
    store.compact()
    assert store.snapshot().total_rows() == 8 and len(store._latest()["commits"]) == 1
    assert sorted(store.snapshot().table("Transform3D").collect()) == sorted(now.table("Transform3D").collect())
    assert Store(spark, f"file://{tmp_path}/s", bucket_ns=7).bucket_ns == B
    with pytest.raises(errors.SchemaMismatch):
        store.append("Scalar", poses(spark, [("/a", 1, 1)]))
    with pytest.raises(errors.VersionConflict):
        store.files.publish(f"versions/{store.version():012d}.json", "{}")


def test_latest_plan_has_a_partial_aggregate(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.append("Transform3D", poses(spark, [("/a", 1, 1), ("/b", 2, 2)]))
    plan = engine.latest_at(store.snapshot(), "Transform3D", 5).rows._jdf.queryExecution().toString()
    assert "partial_max_by" in plan and "PushedFilters: [IsNotNull(t_ns), LessThanOrEqual(t_ns,5)]" in plan and "Python" not in plan


def test_golden_streams(spark, tmp_path):
    config = generator.GenConfig(agents=4, ticks=100)
    events = list(generator.run_events(config))
    assert generator.count_by_kind(events) == {"Transform3D": 400, "Scalar": 80, "ImageRef": 4}
    text = "".join(map(generator.line, events))
    assert hashlib.sha256(text.encode()).hexdigest() == "7b2a6c5189d12ed46bfe350f35ced74983df7504c4108f463d7d2ba4f21e0dd6"
    generator.write_jsonl(events, f"{tmp_path}/deep/run.jsonl")
    assert (tmp_path / "deep/run.jsonl").read_text() == text
    from tidemark.streaming import ingest_file

    store = Store(spark, f"file://{tmp_path}/s")
    summary = ingest_file(spark, f"{tmp_path}/deep", store)
    assert (summary.events_received, summary.events_rejected, summary.rows_emitted) == (484, 0, 484)
    rows = engine.proximity_pairs(store.snapshot(), 250_000_000, 2.5).rows.collect()
    h = hashlib.sha256(struct.pack("<Q", len(rows)))
    for at, a, b, d in rows:
        h.update(struct.pack("<q", at))
        for e in (a, b):
            h.update(struct.pack("<Q", len(e.encode())) + e.encode())
        h.update(struct.pack("<d", d))
    assert h.hexdigest() == "3a2ec9a75d7ca0dc0e47b6b62006bc91858878ec251b3323362a9485ac0245d5"


def test_generator(spark):
    a, b = (list(generator.run_events(generator.GenConfig(seed=s, agents=3, ticks=20))) for s in (1, 2))
    assert a == list(generator.run_events(generator.GenConfig(seed=1, agents=3, ticks=20))) and a != b and len(a) == len(b)
    keys = [(e["t_ns"], e["entity_path"]) for e in a]
    assert keys == sorted(keys)
    assert [generator.number(x) for x in (1e-5, 1.5e-5, 1e-7, 1.25e-6, 0.1, 1e16, -2e-5, 3.0)] == [
        "0.00001", "0.000015", "1e-7", "1.25e-6", "0.1", "1e+16".replace("+", ""), "-0.00002", "3.0",
    ]
    assert generator.scaled_run(spark, generator.GenConfig(agents=5, ticks=40)).count() == 200


quick = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


@quick
@given(st.lists(st.integers(-(10**12), 10**12), min_size=1, max_size=50), st.integers(1, 10**10))
def test_buckets_hold_their_times(spark, times, width):
    df = spark.createDataFrame([(t,) for t in times], "t long")
    for t, got in df.select("t", bucket_of(F.col("t"), width)).collect():
        assert got <= t < got + width and got % width == 0
    assert spark.range(1).select(bucket_of(F.lit(-1), 10), bucket_of(F.lit(7), 0)).first() == (-10, 0)


@quick
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 8), st.integers(-3, 3)), max_size=40), st.integers(-1, 9))
def test_operators_against_brute_force(spark, rows, at):
    rows = [(f"/e/{e}", t, x) for e, t, x in rows]
    s = snap(spark, rows)
    last, before, steps = {}, {}, []
    for i, (e, t, x) in enumerate(rows):
        if t <= at and (e not in last or t >= last[e][0]):
            last[e] = (t, float(x))
    for _, (e, t, x) in sorted(enumerate(rows), key=lambda r: (r[1][0], r[1][1], r[0])):
        if e in before and t > before[e][0]:
            steps.append((e, before[e][0], t, abs(x - before[e][1])))
        before[e] = (t, x)
    got = engine.latest_at(s, "Transform3D", at).rows
    assert [(r["entity_path"], (r["t_ns"], r["tx"])) for r in got.collect()] == sorted(last.items())
    got = operators.speed_over_ground(s.table("Transform3D")).collect()
    assert [tuple(r)[:3] + (r["distance_m"],) for r in got] == steps
    pairs = sorted((a, b) for a in last for b in last if a < b and abs(last[a][1] - last[b][1]) <= 1.5)
    for method in ("grid", "nested"):
        got = engine.proximity_pairs(s, at, 1.5, method).rows.collect()
        assert [(r["entity_a"], r["entity_b"]) for r in got] == pairs


def test_versions_stay_small(spark, tmp_path, monkeypatch):
    from tidemark.sources import store as stores

    monkeypatch.setattr(stores, "CHAIN", 3)
    store = Store(spark, f"file://{tmp_path}/s")
    held = []
    for i in range(8):
        store.append("Transform3D", poses(spark, [("/a", i, i)]))
        held.append(store.snapshot())
    assert all(len(json.loads(store.files.read(f"versions/{v:012d}.json"))["commits"]) < 3 for v in range(1, 9))
    assert [s.total_rows() for s in held] == list(range(1, 9)) and store.snapshot(5).total_rows() == 5
    assert [r["tx"] for r in store.snapshot().table("Transform3D").orderBy("ingest_seq").collect()] == list(range(8))
    store.compact()
    assert store.snapshot().total_rows() == 8 and len(store._commits(store._latest())) == 1


def test_of_two_writers_one_publishes_a_version(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    stores = [Store(spark, f"file://{tmp_path}/s") for _ in range(2)]
    stores[0].append("Transform3D", poses(spark, [("/a", 0, 0)]))

    def write(k):
        wins = 0
        for i in range(6):
            try:
                stores[k].append("Transform3D", poses(spark, [(f"/{k}", i, i)]))
                wins += 1
            except errors.VersionConflict:
                pass
        return wins

    with ThreadPoolExecutor(2) as pool:
        wins = sum(pool.map(write, (0, 1)))
    assert stores[0].version() == 1 + wins and stores[0].snapshot().total_rows() == 1 + wins
    assert not [n for n in stores[0].files.names("versions") if n.endswith(".draft")]


def test_readers_beside_a_writer_see_whole_versions(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    store, done = Store(spark, f"file://{tmp_path}/s"), []

    def write():
        for i in range(12):
            store.append("Transform3D", poses(spark, [(f"/e/{k}", i, k) for k in range(4)]))
        done.append(True)

    def read(_):
        seen = []
        while not done or not seen:
            s = Store(spark, f"file://{tmp_path}/s").snapshot()
            seen.append((s.total_rows(), s.table("Transform3D").count()))
        return seen

    with ThreadPoolExecutor(4) as pool:
        writer, readers = pool.submit(write), [pool.submit(read, k) for k in range(3)]
        writer.result()
        for seen in (r.result() for r in readers):
            assert all(a == b and a % 4 == 0 for a, b in seen) and seen == sorted(seen)
    assert store.snapshot().total_rows() == 48


def test_scaled_tables(spark):
    config = generator.GenConfig(agents=5, ticks=40, image_every=15, scalar_every=7)
    tables = generator.scaled_tables(spark, config)
    s = snapshot_of(spark, tables)
    assert s.count_by_kind() == generator.count_by_kind(generator.run_events(config))
    exact = {(e["t_ns"], e["entity_path"]): e["payload"] for e in generator.run_events(config) if e["payload"]["kind"] == "Scalar"}
    got = {(r["t_ns"], r["entity_path"]): r["value"] for r in tables["Scalar"].collect()}
    assert got == {k: p["value"] for k, p in exact.items()}
    assert {r["uri"] for r in tables["ImageRef"].collect()} == {e["payload"]["uri"] for e in generator.run_events(config) if e["payload"]["kind"] == "ImageRef"}
