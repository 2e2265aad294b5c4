"""Strict decoding of JSON lines, batch and streaming ingest."""

import json
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark import schema
from tidemark.sources import generator, jsonl
from tidemark.sources import store as stores
from tidemark.sources.store import Store
from tidemark.streaming import IngestSummary, cancel, ingest_file, ingest_rows, ingest_stream


def event(t=1, payload=None, **more):
    return {"entity_path": "/a", "timeline": "sim_time", "t_ns": t, "component": "c", "payload": payload or {"kind": "Annotation", "label": "x"}} | more


SCALAR = {"kind": "Scalar", "value": 1.5, "unit": "V"}
IMAGE = {"kind": "ImageRef", "uri": "u", "width": 1, "height": 2, "format": "png"}
CLOUD = {"kind": "Points3D", "points": [[1, 2, 3], [4.5, 5, 6]]}
POSE = {"kind": "Transform3D"} | {c: 0.5 for c in ("tx", "ty", "tz", "qx", "qy", "qz", "qw")}
j = json.dumps
GOOD = [
    j(event()), j(event(payload=SCALAR)), j(event(payload=IMAGE)), j(event(payload=CLOUD)), j(event(payload=POSE)),
    j(event(payload={"kind": "Scalar", "value": 2})), j(event(payload={"kind": "Points3D", "points": []})),
    j(event(extra={"deep": [1, "}"]})), "  " + j(event()) + "\t", j(event(t=-5)), j(event(entity_path="no slash")),
    j(event(payload=SCALAR | {"unit": None})), j(event(entity_path="/é  ")),
]
BAD = [
    "garbage", "{", "[]", "3", '"x"', "null", j(event()) + " tail", j(event()) + j(event()), j(event()) + "," + j(event()),
    j(event(t=6.0)), j(event(t="7")), j(event(t=2**63)), j(event(payload=SCALAR | {"value": "1"})),
    j(event(payload=IMAGE | {"width": 3_000_000_000})), j(event(payload=SCALAR)).replace("1.5", "1e999"),
    j(event(payload=SCALAR)).replace("1.5", "NaN"), j(event(payload=SCALAR)).replace("1.5", '"Infinity"'),
    j(event(payload={"kind": "Points3D", "points": [[1, 2]]})), j(event(payload={"kind": "Points3D", "points": [[1, 2, 3, 4]]})),
    j(event(payload={"kind": "Points3D", "points": [None]})), j(event(payload={"kind": "Points3D", "points": [[1, None, 2]]})),
    j(event()).replace("t_ns", "T_NS"), j(event(payload=SCALAR | {"kind": "scalar"})), j(event(payload=SCALAR | {"kind": "Other"})),
    j(event()).replace('"t_ns": 1', '"t_ns": 1, "t_ns": 2'), j(event(entity_path=5)), j(event(timeline=None)),
    j(event(payload={"kind": "Annotation", "label": 5})), j(event(payload={"kind": "Annotation"})),
    j({k: v for k, v in event().items() if k != "component"}), j(event(payload=POSE | {"qw": None})),
]


@pytest.mark.parametrize("lines,good", [(GOOD, True), (BAD, False)])
def test_strictness(spark, lines, good):
    df = spark.createDataFrame(list(enumerate(lines)), "no long, value string")
    wrong = [lines[r["no"]] for r in jsonl.decode(df).collect() if (r["event"] is not None) != good or r["blank"]]
    assert wrong == []


def test_blank_lines(spark):
    got = jsonl.decode(spark.createDataFrame([("",), (" \t",), ("x",)], "value string")).collect()
    assert [(r["event"], r["blank"]) for r in got] == [(None, True), (None, True), (None, False)]


def test_tables_of_all_kinds(spark):
    df = spark.createDataFrame(list(enumerate(GOOD)), "ingest_seq long, value string")
    events = jsonl.decode(df)
    for kind in schema.KINDS:
        table = jsonl.table_of(events, kind)
        schema.check_table(table, kind)
        assert table.count() >= 1
    cloud = jsonl.table_of(events, "Points3D").orderBy("ingest_seq").first()
    assert [tuple(p) for p in cloud["points"]] == [(1.0, 2.0, 3.0), (4.5, 5.0, 6.0)]


def test_ingest_counts_and_order(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/b.jsonl").write_text("\n".join([*GOOD, *BAD, "", ""]))
    (tmp_path / "in/a.jsonl").write_text("\n".join(j(event(t=t, payload={"kind": "Annotation", "label": str(t)})) for t in (3, 1, 2, -1)))
    store = Store(spark, f"file://{tmp_path}/s")
    s = ingest_file(spark, f"{tmp_path}/in", store)
    assert (s.events_received, s.events_rejected, s.rows_emitted) == (len(GOOD) + 4, 2, len(GOOD) + 2)
    rows = store.snapshot().table("Annotation").orderBy("ingest_seq").collect()
    assert [r["label"] for r in rows][:4] == ["3", "1", "2", "x"]
    assert store.snapshot().total_rows() == s.rows_emitted
    before = max(r["ingest_seq"] for r in rows)
    ingest_rows(spark, [event(9)], store)
    assert store.snapshot().table("Annotation").agg(F.max("ingest_seq")).first()[0] > before


def test_stream_equals_batch_and_repeats_change_nothing(spark, tmp_path):
    events = list(generator.run_events(generator.GenConfig(agents=2, ticks=60)))
    for i in range(3):
        generator.write_jsonl(events[i::3], f"{tmp_path}/in/{i}.jsonl")
    batch, live = Store(spark, f"file://{tmp_path}/batch"), Store(spark, f"file://{tmp_path}/live")
    ingest_file(spark, f"{tmp_path}/in", batch)
    total = IngestSummary()
    q = ingest_stream(spark, f"{tmp_path}/in", live, f"{tmp_path}/cp", summary=total, files_per_trigger=1)
    assert q.awaitTermination(120) and total.rows_emitted == len(events)
    assert total.batches_flushed == sum(len({e["payload"]["kind"] for e in events[i::3]}) for i in range(3))  # a file of each kind
    held = live.snapshot()
    for kind in ("Transform3D", "Scalar", "ImageRef"):
        a, b = (s.table(kind).drop("ingest_seq").collect() for s in (batch.snapshot(), live.snapshot()))
        assert sorted(a) == sorted(b)
    generator.write_jsonl([event(10**12, payload=POSE)], f"{tmp_path}/in/late.jsonl")
    q = ingest_stream(spark, f"{tmp_path}/in", live, f"{tmp_path}/cp", files_per_trigger=1)
    assert q.awaitTermination(120)
    assert live.snapshot().total_rows() == len(events) + 1 and held.total_rows() == len(events)
    version = live.version()
    lines = spark.createDataFrame([(j(event()), 0)], "value string, ingest_seq long")
    assert live.append_events(jsonl.decode(lines), next(iter(live._latest()["done"].items()))) == version


def test_stream_keeps_the_order_of_lines_in_split_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for f in (0, 1):
        (tmp_path / f"in/{f}.jsonl").write_text("\n".join(j(event(payload={"kind": "Annotation", "label": f"{f}-{i:04}"})) for i in range(400)))
    store = Store(spark, f"file://{tmp_path}/s")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10k")
    try:
        assert ingest_stream(spark, f"{tmp_path}/in", store, f"{tmp_path}/cp").awaitTermination(120)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    rows = store.snapshot().table("Annotation").orderBy("ingest_seq").collect()
    assert [r["label"] for r in rows] == [f"{f}-{i:04}" for f in (0, 1) for i in range(400)]
    assert len({r["ingest_seq"] for r in rows}) == 800


def test_batches_have_a_row_cap_and_are_counted_by_kind(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [j(event(t, SCALAR)) for t in range(25)] + [j(event(t)) for t in range(7)] + [j(event(-1))]
    (tmp_path / "in/a.jsonl").write_text("\n".join(lines))
    store = Store(spark, f"file://{tmp_path}/s")
    s = ingest_file(spark, f"{tmp_path}/in", store, batch_rows=10)
    assert (s.events_received, s.events_rejected, s.rows_emitted, s.batches_flushed, s.max_batch_rows) == (33, 1, 32, 4, 10)
    name = store._commits(store._latest())[0]["name"]
    assert len(list((tmp_path / f"s/data/{name}/kind=Scalar").glob("*.parquet"))) == 3
    assert sorted(r[0] for r in store.snapshot().table("Scalar").select("ingest_seq").collect()) == list(range(25))


@pytest.mark.parametrize("cap,together", [(10, 1), (10, 60), (7, 100_000), (1000, 1)])
def test_batches_are_whole_however_many_tasks_read_the_file(spark, tmp_path, monkeypatch, cap, together):
    monkeypatch.setattr(stores, "ROWS_TOGETHER", together)
    (tmp_path / "in").mkdir()
    lines = [j(event(t, SCALAR)) if t % 3 else j(event(t)) if t % 2 else "garbage" for t in range(600)]
    (tmp_path / "in/a.jsonl").write_text("\n".join(lines))
    store = Store(spark, f"file://{tmp_path}/s")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5k")
    try:
        s = ingest_file(spark, f"{tmp_path}/in", store, batch_rows=cap)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert (s.rows_emitted, s.batches_flushed, s.max_batch_rows) == (500, -(-400 // cap) + -(-100 // cap), min(cap, 400))
    snap = store.snapshot()
    for kind, own in (("Scalar", [t for t in range(600) if t % 3]), ("Annotation", [t for t in range(600) if t % 3 == 0 and t % 2])):
        assert sorted(map(tuple, snap.table(kind).select("t_ns", "ingest_seq").collect())) == [(t, t) for t in own]
    assert snap.rejects().count() == 100 and store.files.names("drafts") == []


def test_a_cancelled_stream_says_so_and_goes_on(spark, tmp_path):
    generator.write_jsonl([event(t) for t in range(5)], f"{tmp_path}/in/0.jsonl")
    store, told = Store(spark, f"file://{tmp_path}/s"), IngestSummary()
    q = ingest_stream(spark, f"{tmp_path}/in", store, f"{tmp_path}/cp", summary=told, delay_ms=100)
    q.processAllAvailable()
    cancel(q, told)
    cancel(q, told)
    assert told.cancelled and told.rows_emitted == 5 and not q.isActive
    generator.write_jsonl([event(9)], f"{tmp_path}/in/1.jsonl")
    told = IngestSummary()
    assert ingest_stream(spark, f"{tmp_path}/in", store, f"{tmp_path}/cp", summary=told).awaitTermination(120)
    cancel(q, told)
    assert (told.cancelled, told.rows_emitted, store.snapshot().total_rows()) == (False, 1, 6)


def test_every_bad_line_has_a_reason(spark):
    lines = [*GOOD, *BAD, "", " \t"]
    got = jsonl.decode(spark.createDataFrame(list(enumerate(lines)), "no long, value string"), rejects=True).collect()
    why = {lines[r["no"]]: r["reason"] for r in got}
    for r in got:
        bad = lines[r["no"]] in BAD or lines[r["no"]] == j(event(t=-5))
        assert (r["reason"] is not None) == bad and r["line"] == (lines[r["no"]] if bad else None)
    assert {why[x] for x in BAD} == {"json", "kind", "field"} and why[j(event(t=-5))] == "time"
    assert why["garbage"] == why[j(event()) + j(event())] == "json" and why[j(event(t="7"))] == "field"
    assert why[j(event(payload=SCALAR | {"kind": "scalar"}))] == "kind"


def test_rejects_are_committed_with_the_rows_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / f"in/{k}.jsonl").write_text("\n".join([j(event(k)), "garbage", "", j(event(-1)), j(event(k + 10))]))
    store, checkpoint = Store(spark, f"file://{tmp_path}/s"), f"{tmp_path}/cp"
    assert ingest_stream(spark, f"{tmp_path}/in", store, checkpoint, files_per_trigger=1).awaitTermination(120)
    version = store.version()
    again = jsonl.read_events(spark, f"{tmp_path}/in/1.jsonl", rejects=True)
    for number in range(3):
        assert store.append_events(again, (checkpoint, number)) == version
    snap = store.snapshot()
    rows = [(r["file"][-7:], r["reason"], r["line"]) for r in snap.rejects().orderBy("ingest_seq").collect()]
    assert sorted(rows) == [(f"{k}.jsonl", *x) for k in range(3) for x in (("json", "garbage"), ("time", j(event(-1))))]
    places = [r[0] for t in (snap.rejects(), snap.table("Annotation")) for r in t.select("ingest_seq").collect()]
    assert len(set(places)) == 12 and snap.total_rows() == 6 and "Rejected" not in snap.count_by_kind()
    store.compact()
    assert store.snapshot().rejects().count() == 6 and store.snapshot().total_rows() == 6
    clean = Store(spark, f"file://{tmp_path}/clean")
    clean.append_events(jsonl.decode(spark.createDataFrame([(0, j(event()))], "ingest_seq long, value string"), rejects=True))
    assert clean.snapshot().rejects().count() == 0


@pytest.mark.parametrize("per_span", [1, 3, 1000])
def test_lines_are_numbered_without_gaps(spark, tmp_path, per_span):
    for f in range(4):
        (tmp_path / f"{f}.txt").write_text("\n".join(f"{f}-{i:05}" for i in range(300 * f)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        rows = jsonl.in_order(jsonl.lines_of(spark.read.text(str(tmp_path))), splits_per_span=per_span).orderBy("ingest_seq").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["ingest_seq"] for r in rows] == list(range(len(rows)))
    assert [r["value"] for r in rows] == [f"{f}-{i:05}" for f in range(4) for i in range(300 * f)]


@pytest.mark.parametrize("together", [1, 7, 100])
def test_lines_of_a_split_are_dealt_out_over_tasks(spark, tmp_path, monkeypatch, together):
    monkeypatch.setattr(jsonl, "LINES_TOGETHER", together)
    for f in range(2):
        (tmp_path / f"{f}.txt").write_text("\n".join(f"{f}-{i:05}" for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10k")  # three splits of a file; tasks may hold several
    try:
        lines = jsonl.in_order(jsonl.lines_of(spark.read.text(str(tmp_path))))
        rows = lines.withColumn("task", F.spark_partition_id()).orderBy("ingest_seq").collect()
        final = lines._jdf.queryExecution()
        lines.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r["ingest_seq"], r["value"]) for r in rows] == list(enumerate(f"{f}-{i:05}" for f in range(2) for i in range(3000)))
    sizes = Counter(r["task"] for r in rows)
    assert len(sizes) >= 10 and max(sizes.values()) < 1500
    assert final.executedPlan().toString().partition("Initial Plan")[0].count("FileScan text") == 1


def test_numbering_reads_the_text_once_and_broadcasts_no_places(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\ny")
    df = jsonl.in_order(jsonl.lines_of(spark.read.text(str(tmp_path))))
    plan = df._jdf.queryExecution().executedPlan().toString()
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    assert "ShuffledHashJoin" in plan and "ReusedExchange" in final
    assert set(re.findall(r"FileScan text \[(\w+)", final)) == {"value"}  # the counts share the shuffle of the text
