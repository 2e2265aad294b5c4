"""Command line: python -m tidemark.cli --help."""

from __future__ import annotations

import argparse
import json
import sys
import time
from collections.abc import Iterable
from itertools import islice

from pyspark.sql import Row, SparkSession

from tidemark import benchmarks, engine
from tidemark.errors import TidemarkError
from tidemark.report import JsonReporter, QuerySummary, Reporter, RunSummary, TerminalReporter
from tidemark.schema import KINDS, entity_path
from tidemark.sources.generator import GenConfig, count_by_kind, run_events, write_jsonl
from tidemark.sources.scratch import scratch
from tidemark.sources.store import Store
from tidemark.streaming.ingest import IngestSummary, ingest_file

# How kinds are named as arguments.
KIND_ARGUMENTS = dict(zip(("transform3d", "points3d", "scalar", "image-ref", "annotation"), KINDS))

LIMITS = [
    "One writer at a time commits to a store; a commit that meets another one raises VersionConflict and can be repeated.",
    "A store needs a file system whose rename is one step and refuses a taken name.",
    "Rows of a store can't be changed or deleted; compaction leaves the files of older versions where they are.",
    "A proximity query returns every near pair, so its result grows with the square of a crowd within one radius.",
    "Speed and as-of lookups need the rows of a span (about a million unless told otherwise) of an entity in one task.",
    "The exact generator draws its numbers one after another in one process; large runs come from scaled_run, with other numbers.",
    "Query and op commands print rows a partition at a time, in tables of a thousand; without --store they ingest into a folder of this machine, so on a local master only.",
    "Times are 64-bit nanoseconds; bounds on a timestamp column are those of its microseconds.",
]


def numbered_limits() -> str:
    return "".join(f"{i}. {x}\n" for i, x in enumerate(LIMITS, 1))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemark")
    p.add_argument("--json", action="store_true", help="report as JSON lines")
    sub = p.add_subparsers(dest="command", required=True)

    g = sub.add_parser("generate", help="write a synthetic run as JSON lines")
    g.add_argument("--seed", type=int, default=42)
    g.add_argument("--agents", type=int, default=8)
    g.add_argument("--ticks", type=int, default=1000)
    g.add_argument("--tick-ns", type=int, default=5_000_000)
    g.add_argument("--out", required=True)

    i = sub.add_parser("ingest", help="read JSON lines and print counters")
    i.add_argument("--input", required=True)
    i.add_argument("--producers", type=int, default=1, help="accepted, without effect")
    i.add_argument("--batch-rows", type=int, default=4096, help="most rows of a file that is written")
    i.add_argument("--max-delay-ms", type=int, default=50, help="accepted, without effect on a batch")
    i.add_argument("--store", help="folder of a store to append to; without it a temporary one is used")

    def query(sub, name: str) -> argparse.ArgumentParser:
        q = sub.add_parser(name)
        q.add_argument("--input", required=True)
        q.add_argument("--explain", action="store_true", help="print all counters of the plan")
        q.add_argument("--batch-rows", type=int, default=4096, help="most rows of a file that ingest writes")
        q.add_argument("--store", help="folder of a store to ingest into; without it a temporary one is used")
        return q

    kinds = sub.add_parser("query").add_subparsers(dest="query", required=True)
    q = query(kinds, "latest-at")
    q.add_argument("--kind", choices=KIND_ARGUMENTS, required=True)
    q.add_argument("--at", type=int, required=True)
    q.add_argument("--entity")
    q = query(kinds, "range")
    q.add_argument("--kind", choices=KIND_ARGUMENTS, required=True)
    q.add_argument("--start", type=int, required=True)
    q.add_argument("--end", type=int, required=True)
    q.add_argument("--entity")

    ops = sub.add_parser("op").add_subparsers(dest="op", required=True)
    q = query(ops, "proximity")
    q.add_argument("--at", type=int, required=True)
    q.add_argument("--radius", type=float, required=True)
    q = query(ops, "speed")
    q.add_argument("--entity", required=True)
    q.add_argument("--start", type=int)
    q.add_argument("--end", type=int)

    b = sub.add_parser("bench", help="time the scenarios")
    b.add_argument("--out", default="out/bench.json")
    b.add_argument("--samples", type=int, default=51)
    b.add_argument("--small", action="store_true")
    f = sub.add_parser("figs", help="draw a report of bench")
    f.add_argument("--from", "--input", dest="input", default="out/bench.json")
    f.add_argument("--out", default="out/figs")
    sub.add_parser("limits", aliases=["non-claims"], help="what this package doesn't claim")
    return p


def session() -> SparkSession:
    return (
        SparkSession.builder.appName("tidemark")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


#: Rows of a table that are laid out together.
PAGE = 1000


def show(rows: Iterable[Row], names: list[str], as_json: bool) -> None:
    """Rows as tables of PAGE rows at most, or as a JSON object per line; a field that is null is left out of its object. They
    are printed as they come."""
    if as_json:
        for r in rows:
            print(json.dumps({k: v for k, v in r.asDict(True).items() if v is not None}))
        return
    rows = iter(rows)
    page = list(islice(rows, PAGE))
    if not page:
        print("result=empty")
    while page:
        cells = [names, *([str(v) for v in r] for r in page)]
        widths = [max(map(len, column)) for column in zip(*cells)]
        rule = "+" + "+".join("-" * w for w in widths) + "+"
        lines = ["|" + "|".join(x.rjust(w) for x, w in zip(row, widths)) + "|" for row in cells]
        print("\n".join([rule, lines[0], rule, *lines[1:], rule]))
        page = list(islice(rows, PAGE))


def _load(spark: SparkSession, args, say: Reporter) -> tuple[Store, IngestSummary]:
    say.step(f"ingest {args.input}")
    store = Store(spark, args.store or scratch(spark, "store"))
    return store, ingest_file(spark, args.input, store, batch_rows=args.batch_rows)


def _answer(args, r: engine.Result, say: Reporter, ingest: IngestSummary, extra: list[tuple[str, object]]) -> None:
    show(r.stream(), r.rows.columns, args.json)
    plan = r.plan()
    shown = plan.as_dict() if args.explain else {k: plan.as_dict()[k] for k in ("returned_rows", "latency_us")}
    for k, v in shown.items():
        say.counter(k, v)
    for k, v in extra:
        say.info(f"{k}={v}")
    say.summary(RunSummary(plan.query_type, ingest, QuerySummary.of(plan), [(k, str(v)) for k, v in extra]))


def run(args, say: Reporter) -> None:
    say.phase(args.command)
    if args.command in ("limits", "non-claims"):
        print(numbered_limits(), end="")
    elif args.command == "generate":
        began = time.perf_counter()
        events = list(run_events(GenConfig(args.seed, args.agents, args.ticks, args.tick_ns)))
        n = write_jsonl(events, args.out)
        for kind, k in sorted(count_by_kind(events).items()):
            say.counter(kind, k)
        say.summary(RunSummary("generate", extra=[("events", str(n)), ("out", args.out), ("wall_ms", f"{(time.perf_counter() - began) * 1e3:.1f}")]))
    elif args.command == "figs":
        with open(args.input) as f:
            for path in benchmarks.figures(json.load(f), args.out):
                say.info(path)
    elif args.command == "bench":
        benchmarks.write_report(benchmarks.run_all(session(), args.samples, args.small), args.out)
        say.info(args.out)
    elif args.command == "ingest":
        store, told = _load(session(), args, say)
        snap = store.snapshot()
        say.counter("partitions", snap.num_partitions())
        say.counter("rows", snap.total_rows())
        say.summary(RunSummary("ingest", told))
    else:
        name = getattr(args, "entity", None)
        if name is not None:
            entity_path(name)
        store, told = _load(session(), args, say)
        snap, extra = store.snapshot(), []
        if args.command == "query" and args.query == "latest-at":
            r = engine.latest_at(snap, KIND_ARGUMENTS[args.kind], args.at, name)
        elif args.command == "query":
            r = engine.range_scan(snap, KIND_ARGUMENTS[args.kind], args.start, args.end, name)
        elif args.op == "proximity":
            r = engine.proximity_pairs(snap, args.at, args.radius)
            extra = [("considered_entities", r.considered()), ("complexity", "pairs within neighbouring cells")]
        else:
            r = engine.speed_over_ground(snap, name, args.start, args.end)
            extra = [("considered_samples", r.considered())]
        _answer(args, r, say, told, extra)
    say.done()


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    say = JsonReporter() if args.json else TerminalReporter()
    try:
        run(args, say)
    except TidemarkError as e:
        say.warn(str(e))
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
