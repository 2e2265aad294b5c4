"""Latency scenarios over synthetic runs, and charts of them."""

from __future__ import annotations

import json
import math
import platform
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession

from tidemark import engine
from tidemark.schema import SEQ
from tidemark.sources.generator import GenConfig, line, run_events
from tidemark.sources.jsonl import decode, table_of
from tidemark.sources.scratch import scratch
from tidemark.sources.store import Snapshot, Store, snapshot_of


def percentile(values: list[float], q: float) -> float:
    """Nearest rank."""
    held = sorted(values)
    return held[math.floor(q * (len(held) - 1) + 0.5)]


def measure(work: Callable[[], object], samples: int) -> list[float]:
    """Microseconds of each run after one that doesn't count."""
    work()
    out = []
    for _ in range(samples):
        began = time.perf_counter()
        work()
        out.append((time.perf_counter() - began) * 1e6)
    return out


def fixture(spark: SparkSession, agents: int, ticks: int, seed: int = 42) -> Snapshot:
    """A snapshot of a run, its tables held in memory."""
    events = run_events(GenConfig(seed=seed, agents=agents, ticks=ticks))
    lines = spark.createDataFrame([(i, line(e)) for i, e in enumerate(events)], f"{SEQ} long, value string")
    decoded = decode(lines).persist()
    tables = {k: table_of(decoded, k).persist() for k in ("Transform3D", "Scalar", "ImageRef")}
    for t in tables.values():
        t.count()
    return snapshot_of(spark, tables)


def _row(suite: str, name: str, n: int, rows: int, us: list[float], **more) -> dict:
    return {"suite": suite, "name": name, "n": n, "rows": rows} | {f"p{q}_us": percentile(us, q / 100) for q in (50, 95, 99)} | more


# The sizes of the scenarios.
INGEST = [(8, 500), (16, 500), (32, 500)]
LATEST = RANGES = [(8, 500), (32, 500), (64, 1000)]
PROXIMITY = [50, 100, 200, 400]
SPEED = [200, 500, 1000, 2000]
TICK = 5_000_000


def run_all(spark: SparkSession, samples: int = 51, small: bool = False) -> dict:
    """Every scenario. ``small`` keeps the first size of each suite, for a quick look."""
    pick = lambda sizes: sizes[:1] if small else sizes
    out, held = [], {}

    def snap(agents: int, ticks: int) -> Snapshot:
        if (agents, ticks) not in held:
            held[agents, ticks] = fixture(spark, agents, ticks)
        return held[agents, ticks]

    for agents, ticks in pick(INGEST):
        lines = [(i, line(e)) for i, e in enumerate(run_events(GenConfig(agents=agents, ticks=ticks)))]
        events = decode(spark.createDataFrame(lines, f"{SEQ} long, value string")).persist()
        events.count()
        us = measure(lambda events=events: Store(spark, scratch(spark, "bench")).append_events(events), samples)
        out.append(_row("ingest", f"{agents}x{ticks}", len(lines), len(lines), us, events_per_s=len(lines) / percentile(us, 0.5) * 1e6))
    for agents, ticks in pick(LATEST):
        r = engine.latest_at(snap(agents, ticks), "Transform3D", ticks // 2 * TICK).rows
        out.append(_row("latest_at", f"{agents}x{ticks}", agents * ticks, r.count(), measure(r.collect, samples)))
    for agents, ticks in pick(RANGES):
        span = ticks * TICK
        r = engine.range_scan(snap(agents, ticks), "Transform3D", span * 3 // 8, span * 5 // 8, "/agent/0").rows
        out.append(_row("range_scan", f"{agents}x{ticks}", agents * ticks, r.count(), measure(r.collect, samples)))
    for agents in pick(PROXIMITY):
        for method in ("nested", "grid"):
            r = engine.proximity_pairs(snap(agents, 100), 250_000_000, 1e9, method).rows
            out.append(_row("proximity", f"{agents} {method}", agents, r.count(), measure(r.collect, samples), method=method))
    for ticks in pick(SPEED):
        r = engine.speed_over_ground(snap(4, ticks), "/agent/0").rows
        out.append(_row("speed", str(ticks), ticks, r.count(), measure(r.collect, samples)))
    return {"samples": samples, "os": platform.system(), "arch": platform.machine(), "growth": growth(out), "scenarios": out}


def growth(scenarios: list[dict]) -> dict[str, float]:
    """The power of the size with which each suite's p50 grows from its smallest to its largest scenario; 1 is linear, 2 is
    what comparing all pairs takes."""
    suites: dict[str, list[tuple[int, float]]] = {}
    for s in scenarios:
        name = s["suite"] + (f" {s['method']}" if "method" in s else "")
        suites.setdefault(name, []).append((s["n"], s["p50_us"]))
    out = {}
    for name, points in suites.items():
        (n, a), (m, b) = min(points), max(points)
        if m > n:
            out[name] = math.log(b / a) / math.log(m / n)
    return out


def write_report(report: dict, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(report, indent=1))


def chart(title: str, points: list[tuple[float, float, float]], slope: int | None = None) -> str:
    """An SVG of p50 (full) and p95 (dashed) against size on logarithmic axes, with a line of the given slope."""
    width, height, pad = 480, 320, 50
    xs, ys, tops = ([math.log10(p[i]) for p in points] for i in range(3))
    low, high = min(ys) - 0.2, max(*ys, *tops) + 0.2
    left, right = min(xs), max(max(xs), min(xs) + 0.1)
    at = lambda x, y: (pad + (x - left) / (right - left) * (width - 2 * pad), height - pad - (y - low) / (high - low) * (height - 2 * pad))
    line_of = lambda pairs: " ".join(f"{a:.1f},{b:.1f}" for a, b in (at(*p) for p in pairs))
    marks = "".join(f'<circle cx="{a:.1f}" cy="{b:.1f}" r="3"/><text x="{a:.1f}" y="{height - 30}" font-size="10">{10**x:.0f}</text>' for (a, b), x in ((at(x, y), x) for x, y in zip(xs, ys)))
    guide = "" if slope is None else f'<polyline points="{line_of([(left, ys[0]), (right, ys[0] + slope * (right - left))])}" fill="none" stroke="gray" stroke-dasharray="4"/>'
    return (
        f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}"><text x="{pad}" y="24">{title}, p50 and p95 (dashed) in microseconds</text>'
        f'<polyline points="{line_of(zip(xs, ys))}" fill="none" stroke="black"/>{guide}{marks}'
        f'<polyline class="p95" points="{line_of(zip(xs, tops))}" fill="none" stroke="black" stroke-dasharray="6 3"/>'
        f'<text x="5" y="{pad}" font-size="10">{10**high:.0f}</text><text x="5" y="{height - pad}" font-size="10">{10**low:.0f}</text></svg>'
    )


def figures(report: dict, folder: str) -> list[str]:
    """A chart of each suite as an SVG file; returns their paths."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    out = []
    for suite in dict.fromkeys(s["suite"] for s in report["scenarios"]):
        rows = [s for s in report["scenarios"] if s["suite"] == suite and s.get("method", "grid") == "grid"]
        path = Path(folder, f"{suite}.svg")
        path.write_text(chart(suite, [(s["n"], s["p50_us"], s["p95_us"]) for s in rows], {"proximity": 2, "speed": 1}.get(suite)))
        out.append(str(path))
    return out
