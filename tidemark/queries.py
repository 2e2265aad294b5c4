"""Registered queries of the event engine over the driver's tables, with their SQL.

Adapters give the tables the shape of the kinds: events are scalars, annotations and one-dimensional poses of a
user; orders are poses of a customer with many equal times; embeddings are poses and clouds of a vector; pages are images.
A time window or an entity is also put as bounds on the table's own columns, which the Parquet scan takes over.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import engine
from tidemark import operators as ops
from tidemark.functions.time import nanos, timestamps_within
from tidemark.operators.proximity import near_pairs
from tidemark.plans.manifest import counters, manifest_of, reaches_latest, reaches_range
from tidemark.schema import KINDS, SEQ, columns
from tidemark.sources import ipc
from tidemark.sources.generator import GenConfig, scaled_tables
from tidemark.sources.jsonl import decode, read_events, table_of
from tidemark.sources.scratch import scratch
from tidemark.sql import register_functions
from tidemark.sources.store import Snapshot, Store, snapshot_of, validate
from tidemark.streaming.latest import current_latest, follow_latest
from tidemark.streaming.ranges import follow_range, range_changes
from tidemark.streaming.ingest import IngestSummary, cancel, ingest_file, ingest_rows, ingest_stream

AT = 1_704_931_200_000_000_000
START, END = 1_704_500_000_000_000_000, 1_704_900_000_000_000_000
DAY = 86_400_000_000_000
RADIUS = 0.05
#: An instant within the orders, at which many customers were last seen long before, and a radius in their prices.
ORDERS_AT, PRICE_RADIUS = 900_000_000_000_000_000, 40.0


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rows(
    df: DataFrame, time: str, prefix: str, key: str, seq: str, columns: dict[str, Column],
    start: int | None = None, end: int | None = None, entity: str | None = None,
) -> DataFrame:
    """A kind's rows of a table, within start <= t < end and of one entity, if these are given."""
    df = df.where(timestamps_within(time, dict(df.dtypes)[time], start, end))
    if entity is not None:
        df = df.where(F.col(key) == F.lit(entity.removeprefix(prefix)).cast(dict(df.dtypes)[key]))
    return df.select(
        nanos(F.col(time)).alias("t_ns"),
        F.concat(F.lit(prefix), F.col(key)).alias("entity_path"),
        F.col(seq).alias(SEQ),
        *(c.alias(n) for n, c in columns.items()),
    )


def _pose(x: Column, y: Column | None = None, z: Column | None = None) -> dict[str, Column]:
    zero = F.lit(0.0)
    return {"tx": x, "ty": zero if y is None else y, "tz": zero if z is None else z, "qx": zero, "qy": zero, "qz": zero, "qw": F.lit(1.0)}


def _events(columns) -> object:
    return lambda spark, d, *within: _rows(_read(spark, d, "events"), "ts", "/user/", "user_id", "event_id", columns(), *within)


scalars = _events(lambda: {"value": F.col("value"), "unit": F.lit(None).cast("string")})
labels = _events(lambda: {"label": F.col("event_type")})
event_poses = _events(lambda: _pose(F.col("value")))


def order_poses(spark, d, *within) -> DataFrame:
    return _rows(_read(spark, d, "orders"), "o_orderdate", "/cust/", "o_custkey", "o_orderkey", _pose(F.col("o_totalprice")), *within)


def vector_poses(spark, d) -> DataFrame:
    at = lambda i: F.col("embedding")[i].cast("double")
    return _read(spark, d, "embeddings").select(
        F.col("vec_id").alias("t_ns"),
        F.concat(F.lit("/vec/"), F.col("vec_id")).alias("entity_path"),
        F.col("vec_id").alias(SEQ),
        *(c.alias(n) for n, c in _pose(at(0), at(1), at(2)).items()),
    )


def snapshot(spark, d) -> Snapshot:
    """Each event a scalar and its type an annotation, each order a pose, in buckets of a day."""
    tables = {"Transform3D": order_poses(spark, d), "Scalar": scalars(spark, d), "Annotation": labels(spark, d)}
    return snapshot_of(spark, tables, DAY)


# ---- events as JSON lines ----


def _line(path: Column, t_ns: Column, component: str, kind: str, **payload: Column) -> Column:
    return F.to_json(
        F.struct(
            path.alias("entity_path"),
            F.lit("wall_time").alias("timeline"),
            t_ns.alias("t_ns"),
            F.lit(component).alias("component"),
            F.struct(F.lit(kind).alias("kind"), *(c.alias(n) for n, c in payload.items())).alias("payload"),
        )
    )


def _lines_of(kind: str, spark, d) -> DataFrame:
    """value, ingest_seq: a line of the kind for each row of a table."""
    if kind == "Transform3D":
        df, seq, pose = _read(spark, d, "orders"), "o_orderkey", _pose(F.col("o_totalprice"), F.col("o_custkey") + 0.5)
        text = _line(F.concat(F.lit("/cust/"), F.col("o_custkey")), nanos(F.col("o_orderdate")), "pose", kind, **pose)
    elif kind == "Points3D":
        df, seq = _read(spark, d, "embeddings"), "vec_id"
        e = F.col("embedding")
        number = F.sequence(F.lit(0), (F.floor(F.size(e) / 3) - 1).cast("int"))
        points = F.transform(number, lambda i: F.transform(F.slice(e, i * 3 + 1, 3), lambda x: x.cast("double")))
        text = _line(F.concat(F.lit("/vec/"), F.col("vec_id")), F.col("vec_id") * 1000, "cloud", kind, points=points)
    elif kind == "ImageRef":
        df, seq = _read(spark, d, "pages"), "page_id"
        size = (F.col("page_id") % 4096 + 1).cast("int")
        text = _line(F.concat(F.lit("/page/"), F.col("page_id") % 7), F.col("page_id"), "camera", kind, uri=F.col("url"), width=size, height=F.lit(480), format=F.lit("HTML"))
    elif kind == "Annotation":
        df, seq = _read(spark, d, "events"), "event_id"
        text = _line(F.concat(F.lit("/user/"), F.col("user_id")), nanos(F.col("ts")), "note", kind, label=F.col("event_type"))
    else:
        df, seq = _read(spark, d, "events"), "event_id"
        text = _line(F.concat(F.lit("/user/"), F.col("user_id")), nanos(F.col("ts")), "value", kind, value=F.col("value"), unit=F.lit("V"))
    return df.select(text.alias("value"), F.col(seq).alias(SEQ))


def _decoded(kind: str):
    """The kind's table of its lines, decoded strictly."""
    return lambda spark, d: table_of(decode(_lines_of(kind, spark, d)), kind)


def _told_clouds(clouds: DataFrame) -> DataFrame:
    """Clouds told by their number of points and their first and last coordinate."""
    points = F.col("points")
    return clouds.select(
        "t_ns",
        "entity_path",
        F.size(points).cast("long").alias("n_points"),
        points[0]["x"].alias("first_x"),
        F.element_at(points, -1)["z"].alias("last_z"),
    )


def points_build(spark, d) -> DataFrame:
    return _told_clouds(_decoded("Points3D")(spark, d))


#: What is done to the lines of events by the remainder of their number by 10, and whether they are still events then.
DAMAGE = {1: "half", 2: "tail", 3: "key", 4: "text", 5: "kind", 6: "blank", 7: "early"}


def _damaged(spark, d) -> DataFrame:
    line, seq = F.col("value"), F.col(SEQ)
    changed = {
        "half": F.substring(line, 1, 40),
        "tail": F.concat(line, F.lit("}")),
        "key": F.regexp_replace(line, '"t_ns":', '"t_ns":1,"t_ns":'),
        "text": F.regexp_replace(line, '"t_ns":([0-9]+)', '"t_ns":"$1"'),
        "kind": F.regexp_replace(line, '"Scalar"', '"scalar"'),
        "blank": F.lit("  "),
        "early": F.regexp_replace(line, '"t_ns":', '"t_ns":-'),
    }
    value = line
    for k, name in DAMAGE.items():
        value = F.when(seq % 10 == k, changed[name]).otherwise(value)
    return _lines_of("Scalar", spark, d).select(value.alias("value"), SEQ)


def json_malformed(spark, d) -> DataFrame:
    """Of the lines of events, by what was done to them: how many there are, are events, are blank, and have a negative time."""
    name = F.lit("none")
    for k, what in DAMAGE.items():
        name = F.when(F.col(SEQ) % 10 == k, what).otherwise(name)
    rows = decode(_damaged(spark, d)).withColumn("damage", name)
    return rows.groupBy("damage").agg(
        F.count(F.lit(1)).alias("lines"),
        F.count("event").alias("events"),
        F.count_if("blank").alias("blank"),
        F.count_if(F.col("event.t_ns") < 0).alias("early"),
    )


def json_ingest(spark, d) -> DataFrame:
    """Events written as JSON lines, decoded strictly, and counted by user."""
    rows = _decoded("Scalar")(spark, d)
    return rows.groupBy("entity_path").agg(
        F.count(F.lit(1)).alias("n"), F.min("t_ns").alias("t_min_ns"), F.max("t_ns").alias("t_max_ns"), F.max("value").alias("max_value")
    )


def _files(spark, d, kinds=tuple(KINDS)) -> str:
    """A folder of JSON lines of all kinds, damaged scalars among them."""
    folder, wide = scratch(spark, "lines"), None
    for kind in kinds:
        own = (_damaged if kind == "Scalar" else lambda s, p, k=kind: _lines_of(k, s, p))(spark, d).select("value")
        wide = own if wide is None else wide.union(own)
    wide.write.text(folder)
    return folder


def _store(spark) -> Store:
    return Store(spark, scratch(spark, "store"), DAY)


def _kinds(store: Store) -> DataFrame:
    """By kind, from the manifest of the store's last version: rows, partitions, times."""
    return store.snapshot().manifest().groupBy("kind").agg(
        F.sum("rows").alias("n"), F.count(F.lit(1)).alias("partitions"), F.min("t_min_ns").alias("t_min_ns"), F.max("t_max_ns").alias("t_max_ns")
    )


def store_ingest(spark, d) -> DataFrame:
    """Files of lines of all kinds read into a store, by kind."""
    store = _store(spark)
    ingest_file(spark, _files(spark, d), store)
    return _kinds(store)


def stream_ingest(spark, d) -> DataFrame:
    """The same by a stream of micro-batches of four files."""
    store = _store(spark)
    query = ingest_stream(spark, _files(spark, d, ("Scalar", "Annotation")), store, scratch(spark, "stream"), files_per_trigger=4)
    query.awaitTermination()
    return _kinds(store)


def _dumped(spark, d, kinds=tuple(KINDS)) -> Snapshot:
    """The decoded lines of all kinds, written as Arrow IPC files and read back."""
    folder = scratch(spark, "dump")
    ipc.dump(snapshot_of(spark, {k: _decoded(k)(spark, d) for k in kinds}, DAY), folder)
    return ipc.load(spark, folder, bucket_ns=DAY)


def ipc_dump(spark, d) -> DataFrame:
    """By kind, what a dump gives back."""
    return _dumped(spark, d).manifest().groupBy("kind").agg(
        F.sum("rows").alias("n"), F.count(F.lit(1)).alias("partitions"), F.min("t_min_ns").alias("t_min_ns"), F.max("t_max_ns").alias("t_max_ns")
    )


def ipc_points(spark, d) -> DataFrame:
    """Clouds of a dump, told as points_build does."""
    return _told_clouds(_dumped(spark, d, ("Points3D",)).table("Points3D"))


#: Rows of a file that ingest_files writes at most.
CAP = 1000


def ingest_files(spark, d) -> DataFrame:
    """The same of one file of scalars, with the files that it wrote under a cap of rows."""
    folder = scratch(spark, "lines")
    _damaged(spark, d).select("value").coalesce(1).write.text(folder)
    told = ingest_file(spark, folder, _store(spark), batch_rows=CAP)
    return spark.createDataFrame([(told.rows_emitted, told.batches_flushed, told.max_batch_rows)], "rows_emitted long, batches_flushed long, max_batch_rows long")


def stream_delayed(spark, d) -> DataFrame:
    """A stream that flushes by time, fifty milliseconds at least apart, until it is cancelled; by kind."""
    store, told = _store(spark), IngestSummary()
    query = ingest_stream(spark, _files(spark, d, ("Annotation",)), store, scratch(spark, "stream"), summary=told, delay_ms=50)
    query.processAllAvailable()
    cancel(query, told)
    return _kinds(store).withColumn("cancelled", F.lit(told.cancelled))


def stream_rejects(spark, d) -> DataFrame:
    """What a stream of damaged scalars rejected, by reason, beside what it kept; the last micro-batch is offered again."""
    store, checkpoint = _store(spark), scratch(spark, "stream")
    folder = _files(spark, d, ("Scalar",))
    ingest_stream(spark, folder, store, checkpoint, files_per_trigger=4).awaitTermination()
    store.append_events(read_events(spark, folder, rejects=True), (checkpoint, 0))
    snap = store.snapshot()
    told = snap.rejects().select("reason", SEQ).union(snap.table("Scalar").select(F.lit("none"), SEQ))
    return told.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(SEQ).alias("places"))


def stream_latest(spark, d) -> DataFrame:
    """The last scalar of each user, from a stream to which the events come in four micro-batches, dealt out by a hash."""
    rows, folder, out = scalars(spark, d), scratch(spark, "arrivals"), scratch(spark, "changes")
    rows.repartition(8, F.xxhash64(SEQ)).write.parquet(folder)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(folder)
    follow_latest(stream, out, scratch(spark, "stream")).awaitTermination()
    return current_latest(spark.read.schema(rows.schema).parquet(out)).select("t_ns", "entity_path", "value")


def stream_range(spark, d) -> DataFrame:
    """Scalars of a time range from a stream that has the events in eight files, by time but for some that come last."""
    rows, folder, out = scalars(spark, d), scratch(spark, "arrivals"), scratch(spark, "released")
    last = F.when(F.col(SEQ) % 50 == 7, F.lit(9 * 10**18)).otherwise(F.col("t_ns"))
    rows.repartitionByRange(8, last).write.parquet(folder)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(folder)
    changes = range_changes(stream, START, END, bucket_ns=DAY, lateness="1 hour", parts=4)
    follow_range(changes, out, scratch(spark, "stream")).awaitTermination()
    return spark.read.schema(changes.schema).parquet(out).select("t_ns", "entity_path", "value")


def ingest_summary(spark, d) -> DataFrame:
    """What an ingest of damaged scalars tells."""
    told: IngestSummary = ingest_file(spark, _files(spark, d, ("Scalar",)), _store(spark), batch_rows=1000)
    row = (told.events_received, told.events_rejected, told.events_sent, told.rows_emitted, told.cancelled)
    return spark.createDataFrame([row], "events_received long, events_rejected long, events_sent long, rows_emitted long, cancelled boolean")


def store_latest(spark, d) -> DataFrame:
    """The last scalar of each user in a store to which the events came in two commits, the later ones first."""
    store = _store(spark)
    late = nanos(F.col("ts")) >= START
    for part in (late, ~late):
        store.append("Scalar", _rows(_read(spark, d, "events").where(part), "ts", "/user/", "user_id", "event_id", {"value": F.col("value"), "unit": F.lit(None).cast("string")}))
    return ops.latest_at(store.snapshot().table("Scalar"), AT).select("t_ns", "entity_path", "value")


def _latest_sql(table: str, time: str, key: str, seq: str, prefix: str, columns: str, where: str) -> str:
    return f"""
SELECT epoch_ns({time}) AS t_ns, '{prefix}' || {key} AS entity_path, {columns} FROM {table} WHERE {where}
QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY {time} DESC, {seq} DESC) = 1"""


def _speed_sql(table: str, time: str, key: str, seq: str, prefix: str, value: str, where: str = "true") -> str:
    return f"""
WITH l AS (SELECT '{prefix}' || {key} AS entity_path, epoch_ns({time}) AS t, {value} AS v,
  lag(epoch_ns({time})) OVER w AS t0, lag({value}) OVER w AS v0 FROM {table} WHERE {where}
  WINDOW w AS (PARTITION BY {key} ORDER BY {time}, {seq}))
SELECT entity_path, t0 AS t_start_ns, t AS t_end_ns, t - t0 AS dt_ns, sqrt((v - v0) * (v - v0)) AS distance_m,
  sqrt((v - v0) * (v - v0)) / (CAST(t - t0 AS DOUBLE) * 1e-9::DOUBLE) AS speed_mps FROM l WHERE t - t0 > 0"""


def _proximity_sql(radius: float) -> str:
    return f"""
WITH p AS (SELECT '/vec/' || vec_id AS e, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings),
j AS (SELECT a.e AS entity_a, b.e AS entity_b, (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) AS d2
  FROM p a JOIN p b ON a.e < b.e)
SELECT CAST({AT} AS BIGINT) AS at_ns, entity_a, entity_b, sqrt(d2) AS distance FROM j WHERE d2 <= {radius!r}::DOUBLE * {radius!r}::DOUBLE"""


_MANIFEST = f"""e AS (SELECT 'Scalar' AS kind, epoch_ns(ts) AS t FROM events UNION ALL SELECT 'Annotation', epoch_ns(ts) FROM events
  UNION ALL SELECT 'Transform3D', epoch_ns(o_orderdate) FROM orders),
m AS (SELECT kind, t - t % {DAY} AS bucket_start_ns, count(*) AS n, min(t) AS lo, max(t) AS hi FROM e GROUP BY 1, 2)"""


def _counters_sql(kind: str, keep: str) -> str:
    return f"""WITH {_MANIFEST} SELECT count(*) AS candidate_partitions, count(*) FILTER (kind <> '{kind}') AS pruned_by_kind,
  count(*) FILTER (kind = '{kind}' AND NOT ({keep})) AS pruned_by_time, count(*) FILTER (kind = '{kind}' AND {keep}) AS scanned_partitions,
  CAST(coalesce(sum(n) FILTER (kind = '{kind}' AND {keep}), 0) AS BIGINT) AS scanned_rows FROM m"""


def _counters(kind, reaches, *times):
    return lambda spark, d: counters(snapshot(spark, d).manifest(), kind, reaches(*times))


def _latest(table, columns, at=AT, entity=None):
    within = (None, at + 1, entity)
    return lambda spark, d: ops.latest_at(table(spark, d, *within), at, entity).select("t_ns", "entity_path", *columns)


def _range(start, end, entity=None):
    return lambda spark, d: ops.range_scan(scalars(spark, d, start, end, entity), start, end, entity).select("t_ns", "entity_path", "value")


def _speed(table, *args):
    entity, start, end = (*args, None, None, None)[:3]
    return lambda spark, d: ops.speed_over_ground(table(spark, d, start, end, entity), *args)


def _near(radius):
    return lambda spark, d: near_pairs(vector_poses(spark, d), AT, radius)


def stale_pairs(spark, d) -> DataFrame:
    """Customers whose last orders at an instant, however old, were nearly of one price."""
    return ops.proximity_pairs(order_poses(spark, d, None, ORDERS_AT + 1), ORDERS_AT, PRICE_RADIUS)


#: Where the dates of orders are put among the events: a day of them is 18 minutes from the first event's month on.
ORDERS_BEGIN, EVENTS_BEGIN, SHRINK = 788_918_400_000_000_000, 1_704_067_200_000_000_000, 80


def asof_orders(spark, d) -> DataFrame:
    """Each order, its date put among the events, with the last event of the user of the customer's number."""
    at = F.lit(EVENTS_BEGIN) + F.expr(f"(unix_micros(cast(o_orderdate as timestamp)) * 1000 - {ORDERS_BEGIN}) div {SHRINK}")
    orders = _read(spark, d, "orders").select("o_orderkey", F.concat(F.lit("/user/"), F.col("o_custkey")).alias("entity_path"), at.alias("t_ns"))
    found = ops.as_of(orders, _rows(_read(spark, d, "events"), "ts", "/user/", "user_id", "event_id", {"value": F.col("value"), "label": F.col("event_type")}))
    return found.select("o_orderkey", "entity_path", "t_ns", F.col("sample_ingest_seq").alias("event_id"), F.col("sample_t_ns").alias("event_t_ns"), "sample_value", "sample_label")


#: How old a view may be that a purchase is traced to: six hours.
FRESH_NS = 6 * 3_600_000_000_000


def asof_fresh(spark, d) -> DataFrame:
    """Each purchase with the same user's last view of the six hours before it."""
    events = _read(spark, d, "events")
    kind = lambda k: _rows(events.where(F.col("event_type") == k), "ts", "/user/", "user_id", "event_id", {"value": F.col("value")})
    found = ops.as_of(kind("purchase"), kind("view"), tolerance_ns=FRESH_NS)
    return found.select(F.col(SEQ).alias("event_id"), "entity_path", "t_ns", "value", F.col("sample_ingest_seq").alias("view_id"), F.col("sample_t_ns").alias("view_t_ns"), F.col("sample_value").alias("view_value"))


def _placed(rows: DataFrame) -> DataFrame:
    """Small results with the place at which each row comes."""
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())).cast("long"))


def latest_at_order(spark, d) -> DataFrame:
    return _placed(engine.latest_at(snapshot(spark, d), "Scalar", AT).rows).select("place", "entity_path", "t_ns")


def range_scan_order(spark, d) -> DataFrame:
    """Orders of one customer by day, then by arrival, which isn't the order of time."""
    return _placed(engine.range_scan(snapshot(spark, d), "Transform3D", 0, 10**18, "/cust/8").rows).select("place", "t_ns", "tx")


def _called(call: str, columns: str = "*"):
    """A call of a table function over the snapshot."""

    def query(spark, d) -> DataFrame:
        register_functions(snapshot(spark, d), "tm_")
        return spark.sql(f"SELECT {columns} FROM tm_{call}")

    return query


def engine_plans(spark, d) -> DataFrame:
    """The counters of a query of each type over one snapshot, without their times."""
    s = snapshot(spark, d)
    results = [
        engine.latest_at(s, "Scalar", AT),
        engine.range_scan(s, "Annotation", START, END, "/user/8"),
        engine.proximity_pairs(s, ORDERS_AT, PRICE_RADIUS),
        engine.speed_over_ground(s, "/cust/8"),
    ]
    rows = [{k: v for k, v in r.plan().as_dict().items() if k != "latency_us"} | {"considered": r.considered()} for r in results]
    kinds = ", ".join(f"{k} {'string' if k == 'query_type' else 'long'}" for k in rows[0])
    return spark.createDataFrame([tuple(r.values()) for r in rows], kinds)


def monotone(spark, d) -> DataFrame:
    """By kind, whether times never fall in order of arrival."""
    s = snapshot(spark, d)
    return spark.createDataFrame([(k, validate(s, k)) for k in KINDS], "kind string, in_order boolean")


RUN = GenConfig(agents=4, ticks=100, scalar_every=7, image_every=30)


def memory_ingest(spark, d) -> DataFrame:
    """Lines of events, damaged ones among them, ingested from a DataFrame in place of files."""
    store = _store(spark)
    ingest_rows(spark, _damaged(spark, d).select("value"), store)
    return _kinds(store)


def _scaled(kind: str):
    """A run with an agent for each supplier."""
    return lambda spark, d: scaled_tables(spark, replace(RUN, agents=_read(spark, d, "supplier").count()))[kind].select(*columns(kind))


def manifest(spark, d) -> DataFrame:
    return manifest_of(scalars(spark, d), "Scalar", DAY)


def kind_counts(spark, d) -> DataFrame:
    """Rows per kind, from the snapshot's manifest."""
    return snapshot(spark, d).manifest().groupBy("kind").agg(F.sum("rows").alias("n"))


def queries() -> dict:
    pose = ("tx", "ty", "tz")
    return {
        "latest_at_all": _latest(scalars, ["value"]),
        "latest_at_entity": _latest(scalars, ["value"], AT, "/user/8"),
        "latest_at_label": _latest(labels, ["label"]),
        "latest_at_before_data": _latest(scalars, ["value"], 0),
        "latest_at_ties": _latest(order_poses, pose, 10**18 * 4),
        "range_scan_all": _range(START, END),
        "range_scan_entity": _range(START, END, "/user/8"),
        "range_scan_empty": _range(START, START),
        "speed_entity": _speed(event_poses, "/user/8"),
        "speed_window": _speed(event_poses, "/user/8", START, END),
        "speed_all_entities": _speed(event_poses),
        "speed_zero_dt": _speed(order_poses),
        "proximity_pairs": stale_pairs,
        "proximity_grid": _near(RADIUS),
        "proximity_radius_zero": _near(0.0),
        "asof_orders": asof_orders,
        "asof_fresh": asof_fresh,
        "latest_at_order": latest_at_order,
        "range_scan_order": range_scan_order,
        "sql_latest_at": _called(f"latest_at_scalar({AT})", "t_ns, entity_path, value"),
        "sql_range_scan": _called(f"range_scan_scalar({START}, {END}, '/user/8')", "t_ns, entity_path, value"),
        "sql_speed": _called("speed_over_ground()"),
        "sql_proximity": _called(f"proximity_pairs({ORDERS_AT}, {PRICE_RADIUS!r}D)"),
        "bucket_manifest": manifest,
        "plan_counters_latest_at": _counters("Scalar", reaches_latest, AT),
        "plan_counters_range": _counters("Transform3D", reaches_range, ORDERS_AT, ORDERS_AT + 100 * DAY),
        "kind_counts": kind_counts,
        "points3d_build": points_build,
        "transform3d_table": _decoded("Transform3D"),
        "scalar_table": _decoded("Scalar"),
        "image_table": _decoded("ImageRef"),
        "annotation_table": _decoded("Annotation"),
        "json_ingest": json_ingest,
        "json_malformed": json_malformed,
        "store_ingest": store_ingest,
        "store_latest": store_latest,
        "stream_ingest": stream_ingest,
        "ipc_dump": ipc_dump,
        "ipc_points": ipc_points,
        "ingest_files": ingest_files,
        "stream_delayed": stream_delayed,
        "stream_rejects": stream_rejects,
        "stream_range": stream_range,
        "stream_latest": stream_latest,
        "ingest_summary": ingest_summary,
        "memory_ingest": memory_ingest,
        "engine_plans": engine_plans,
        "monotone": monotone,
        "generated_scalars": _scaled("Scalar"),
        "generated_images": _scaled("ImageRef"),
    }


def _stored_sql(kinds: tuple[str, ...], damaged: bool = True) -> str:
    lost = f" WHERE event_id % 10 NOT IN ({', '.join(str(k) for k in DAMAGE)})" if damaged else ""
    parts = {
        "Transform3D": "SELECT 'Transform3D' AS kind, epoch_ns(o_orderdate) AS t FROM orders",
        "Points3D": "SELECT 'Points3D' AS kind, vec_id * 1000 AS t FROM embeddings",
        "Scalar": f"SELECT 'Scalar' AS kind, epoch_ns(ts) AS t FROM events{lost}",
        "ImageRef": "SELECT 'ImageRef' AS kind, page_id AS t FROM pages",
        "Annotation": "SELECT 'Annotation' AS kind, epoch_ns(ts) AS t FROM events",
    }
    rows = " UNION ALL ".join(parts[k] for k in kinds)
    return f"SELECT kind, count(*) AS n, count(DISTINCT t // {DAY}) AS partitions, min(t) AS t_min_ns, max(t) AS t_max_ns FROM ({rows}) GROUP BY kind"


def _plans_sql(pairs: str) -> str:
    event, order = ("events", "ts", "user_id", "event_id", "/user/"), ("orders", "o_orderdate", "o_custkey", "o_orderkey", "/cust/")
    span = f"user_id = 8 AND epoch_ns(ts) >= {START} AND epoch_ns(ts) < {END}"
    last = _latest_sql(*order, "o_totalprice AS x", f"epoch_ns(o_orderdate) <= {ORDERS_AT}")
    parts = [
        ("latest_at", "Scalar", f"lo <= {AT}", _latest_sql(*event, "value", f"epoch_ns(ts) <= {AT}"), "SELECT 1 WHERE false"),
        ("range_scan", "Annotation", f"hi >= {START} AND lo < {END}", f"SELECT 1 FROM events WHERE {span}", "SELECT 1 WHERE false"),
        ("proximity_pairs", "Transform3D", f"lo <= {ORDERS_AT}", pairs, last),
        ("speed_over_ground", "Transform3D", "true", _speed_sql(*order, "o_totalprice", "o_custkey = 8"), "SELECT 1 FROM orders WHERE o_custkey = 8"),
    ]
    rows = (
        f"SELECT '{name}' AS query_type, (SELECT count(*) FROM ({rows})) AS returned_rows, (SELECT count(*) FROM ({considered})) AS considered, * FROM ({_counters_sql(kind, keep)})"
        for name, kind, keep, rows, considered in parts
    )
    return " UNION ALL ".join(rows)


def _scaled_sql(every: int, columns: str) -> str:
    return f"""SELECT tick * {RUN.tick_ns} AS t_ns, '/agent/' || a AS entity_path, {columns}
FROM (SELECT unnest(range(0, {RUN.ticks}, {every})) AS tick) CROSS JOIN (SELECT unnest(range((SELECT count(*) FROM supplier))) AS a)"""


def oracle_sql() -> dict[str, str]:
    event = ("events", "ts", "user_id", "event_id", "/user/")
    order = ("orders", "o_orderdate", "o_custkey", "o_orderkey", "/cust/")
    span = f"epoch_ns(ts) >= {START} AND epoch_ns(ts) < {END}"
    scan = "SELECT epoch_ns(ts) AS t_ns, '/user/' || user_id AS entity_path, value FROM events WHERE "
    names = " ".join(f"WHEN {k} THEN '{v}'" for k, v in DAMAGE.items())
    return {
        "latest_at_all": _latest_sql(*event, "value", f"epoch_ns(ts) <= {AT}"),
        "latest_at_entity": _latest_sql(*event, "value", f"user_id = 8 AND epoch_ns(ts) <= {AT}"),
        "latest_at_label": _latest_sql(*event, "event_type AS label", f"epoch_ns(ts) <= {AT}"),
        "latest_at_before_data": _latest_sql(*event, "value", "epoch_ns(ts) <= 0"),
        "latest_at_ties": _latest_sql(*order, "o_totalprice AS tx, 0.0::DOUBLE AS ty, 0.0::DOUBLE AS tz", "true"),
        "range_scan_all": scan + span,
        "range_scan_entity": scan + f"user_id = 8 AND {span}",
        "range_scan_empty": scan + "false",
        "speed_entity": _speed_sql(*event, "value", "user_id = 8"),
        "speed_window": _speed_sql(*event, "value", f"user_id = 8 AND {span}"),
        "speed_all_entities": _speed_sql(*event, "value"),
        "speed_zero_dt": _speed_sql(*order, "o_totalprice"),
        "proximity_pairs": (pairs := f"""
WITH p AS ({_latest_sql(*order, "o_totalprice AS x", f"epoch_ns(o_orderdate) <= {ORDERS_AT}")})
SELECT CAST({ORDERS_AT} AS BIGINT) AS at_ns, a.entity_path AS entity_a, b.entity_path AS entity_b, sqrt((a.x - b.x) * (a.x - b.x)) AS distance
FROM p a JOIN p b ON b.x BETWEEN a.x - 41 AND a.x + 41 AND a.entity_path < b.entity_path AND (a.x - b.x) * (a.x - b.x) <= {PRICE_RADIUS!r}::DOUBLE * {PRICE_RADIUS!r}::DOUBLE"""),
        "proximity_grid": _proximity_sql(RADIUS),
        "proximity_radius_zero": _proximity_sql(0.0),
        "latest_at_order": f"SELECT row_number() OVER (ORDER BY entity_path) AS place, entity_path, t_ns FROM ({_latest_sql(*event, 'value', f'epoch_ns(ts) <= {AT}')})",
        "range_scan_order": f"SELECT row_number() OVER (ORDER BY epoch_ns(o_orderdate) // {DAY}, o_orderkey) AS place, epoch_ns(o_orderdate) AS t_ns, o_totalprice AS tx FROM orders WHERE o_custkey = 8 AND epoch_ns(o_orderdate) < {10**18}",
        "sql_latest_at": _latest_sql(*event, "value", f"epoch_ns(ts) <= {AT}"),
        "sql_range_scan": scan + f"user_id = 8 AND {span}",
        "sql_speed": _speed_sql(*order, "o_totalprice"),
        "sql_proximity": pairs,
        "asof_orders": f"""
WITH o AS (SELECT o_orderkey, o_custkey, {EVENTS_BEGIN} + (epoch_ns(o_orderdate) - {ORDERS_BEGIN}) // {SHRINK} AS t_ns FROM orders)
SELECT o_orderkey, '/user/' || o_custkey AS entity_path, t_ns, event_id, epoch_ns(ts) AS event_t_ns, value AS sample_value, event_type AS sample_label
FROM o ASOF LEFT JOIN (SELECT *, epoch_ns(ts) AS t FROM events QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) = 1) e
ON o.o_custkey = e.user_id AND o.t_ns >= e.t""",
        "asof_fresh": f"""
WITH e AS (SELECT *, epoch_ns(ts) AS t FROM events),
v AS (SELECT * FROM e WHERE event_type = 'view' QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) = 1)
SELECT p.event_id, '/user/' || p.user_id AS entity_path, p.t AS t_ns, p.value, CASE WHEN p.t - v.t <= {FRESH_NS} THEN v.event_id END AS view_id,
  CASE WHEN p.t - v.t <= {FRESH_NS} THEN v.t END AS view_t_ns, CASE WHEN p.t - v.t <= {FRESH_NS} THEN v.value END AS view_value
FROM (SELECT * FROM e WHERE event_type = 'purchase') p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.t >= v.t""",
        "bucket_manifest": f"WITH {_MANIFEST} SELECT kind, bucket_start_ns, n AS rows, lo AS t_min_ns, hi AS t_max_ns FROM m WHERE kind = 'Scalar'",
        "plan_counters_latest_at": _counters_sql("Scalar", f"lo <= {AT}"),
        "plan_counters_range": _counters_sql("Transform3D", f"hi >= {ORDERS_AT} AND lo < {ORDERS_AT + 100 * DAY}"),
        "kind_counts": f"WITH {_MANIFEST} SELECT kind, CAST(sum(n) AS BIGINT) AS n FROM m GROUP BY kind",
        "points3d_build": (clouds := "SELECT vec_id * 1000 AS t_ns, '/vec/' || vec_id AS entity_path, len(embedding) // 3 AS n_points, embedding[1]::DOUBLE AS first_x, embedding[3 * (len(embedding) // 3)]::DOUBLE AS last_z FROM embeddings"),
        "ipc_dump": _stored_sql(tuple(KINDS), damaged=False),
        "ipc_points": clouds,
        "transform3d_table": f"SELECT epoch_ns(o_orderdate) AS t_ns, '/cust/' || o_custkey AS entity_path, o_totalprice AS tx, o_custkey + 0.5::DOUBLE AS ty, 0.0::DOUBLE AS tz, 0.0::DOUBLE AS qx, 0.0::DOUBLE AS qy, 0.0::DOUBLE AS qz, 1.0::DOUBLE AS qw, o_orderkey AS {SEQ} FROM orders",
        "scalar_table": f"SELECT epoch_ns(ts) AS t_ns, '/user/' || user_id AS entity_path, value, 'V' AS unit, event_id AS {SEQ} FROM events",
        "image_table": f"SELECT page_id AS t_ns, '/page/' || page_id % 7 AS entity_path, url AS uri, CAST(page_id % 4096 + 1 AS INTEGER) AS width, CAST(480 AS INTEGER) AS height, 'HTML' AS format, page_id AS {SEQ} FROM pages",
        "annotation_table": f"SELECT epoch_ns(ts) AS t_ns, '/user/' || user_id AS entity_path, event_type AS label, event_id AS {SEQ} FROM events",
        "json_ingest": "SELECT '/user/' || user_id AS entity_path, count(*) AS n, min(epoch_ns(ts)) AS t_min_ns, max(epoch_ns(ts)) AS t_max_ns, max(value) AS max_value FROM events GROUP BY user_id",
        "json_malformed": f"SELECT CASE event_id % 10 {names} ELSE 'none' END AS damage, count(*) AS lines, count(*) FILTER (event_id % 10 IN (0, 7, 8, 9)) AS events, count(*) FILTER (event_id % 10 = 6) AS blank, count(*) FILTER (event_id % 10 = 7) AS early FROM events GROUP BY 1",
        "store_ingest": _stored_sql(tuple(KINDS)),
        "store_latest": _latest_sql(*event, "value", f"epoch_ns(ts) <= {AT}"),
        "stream_ingest": _stored_sql(("Scalar", "Annotation")),
        "ingest_files": f"SELECT count(*) AS rows_emitted, CAST(ceil(count(*) / {CAP}) AS BIGINT) AS batches_flushed, least(count(*), {CAP}) AS max_batch_rows FROM events WHERE event_id % 10 IN (0, 8, 9)",
        "stream_delayed": f"SELECT *, true AS cancelled FROM ({_stored_sql(('Annotation',))})",
        "stream_rejects": "SELECT CASE WHEN event_id % 10 IN (1, 2, 3) THEN 'json' WHEN event_id % 10 = 4 THEN 'field' WHEN event_id % 10 = 5 THEN 'kind' WHEN event_id % 10 = 7 THEN 'time' ELSE 'none' END AS reason, count(*) AS n, count(*) AS places FROM events WHERE event_id % 10 <> 6 GROUP BY 1",
        "stream_range": scan + span,
        "stream_latest": _latest_sql(*event, "value", "true"),
        "ingest_summary": "SELECT count(*) AS events_received, count(*) FILTER (event_id % 10 = 7) AS events_rejected, count(*) FILTER (event_id % 10 <> 7) AS events_sent, count(*) FILTER (event_id % 10 <> 7) AS rows_emitted, false AS cancelled FROM events WHERE event_id % 10 IN (0, 7, 8, 9)",
        "memory_ingest": _stored_sql(("Scalar",)),
        "engine_plans": _plans_sql(pairs),
        "monotone": """
WITH e AS (SELECT 'Scalar' AS kind, event_id AS q, ts AS t FROM events UNION ALL SELECT 'Annotation', event_id, ts FROM events
  UNION ALL SELECT 'Transform3D', o_orderkey, o_orderdate FROM orders),
l AS (SELECT kind, t < lag(t) OVER (PARTITION BY kind ORDER BY q) AS back FROM e)
SELECT kind, NOT coalesce(bool_or(back), false) AS in_order FROM l GROUP BY kind UNION ALL SELECT unnest(['Points3D', 'ImageRef']), true""",
        "generated_scalars": _scaled_sql(RUN.scalar_every, f"1.0::DOUBLE - tick / {float(RUN.ticks)!r}::DOUBLE AS value, 'ratio' AS unit"),
        "generated_images": _scaled_sql(RUN.image_every, "'synthetic://agent/' || a || '/tick/' || tick AS uri, CAST(640 AS INTEGER) AS width, CAST(480 AS INTEGER) AS height, 'JPEG' AS format"),
    }
