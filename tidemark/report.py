"""Reporters of progress, and summaries of runs."""

from __future__ import annotations

import json
import sys
from dataclasses import dataclass, field
from typing import Protocol

from tidemark.plans.manifest import QueryPlan
from tidemark.streaming.ingest import IngestSummary


@dataclass
class QuerySummary:
    """A query's plan with its latency in milliseconds."""

    query_type: str
    candidate_partitions: int
    pruned_by_kind: int
    pruned_by_time: int
    scanned_partitions: int
    scanned_rows: int
    returned_rows: int
    latency_ms: float

    @classmethod
    def of(cls, p: QueryPlan) -> QuerySummary:
        d = p.as_dict()
        return cls(latency_ms=d.pop("latency_us") / 1e3, **d)


@dataclass
class RunSummary:
    command: str
    ingest: IngestSummary | None = None
    query: QuerySummary | None = None
    extra: list[tuple[str, str]] = field(default_factory=list)

    def as_dict(self) -> dict:
        return {
            "command": self.command,
            "ingest": self.ingest.as_dict() if self.ingest else None,
            "query": vars(self.query) if self.query else None,
            "extra": [list(x) for x in self.extra],
        }


class Reporter(Protocol):
    def phase(self, name: str) -> None: ...
    def step(self, text: str) -> None: ...
    def counter(self, name: str, value: object) -> None: ...
    def info(self, text: str) -> None: ...
    def warn(self, text: str) -> None: ...
    def summary(self, run: RunSummary) -> None: ...
    def done(self) -> None: ...


class NullReporter:
    def phase(self, name): ...
    def step(self, text): ...
    def counter(self, name, value): ...
    def info(self, text): ...
    def warn(self, text): ...
    def summary(self, run): ...
    def done(self): ...


class TerminalReporter:
    def __init__(self, out=None):
        self.out = out or sys.stderr

    def _say(self, tag: str, text: object) -> None:
        print(f"[{tag}] {text}", file=self.out, flush=True)

    def phase(self, name):
        self._say("tidemark", name)

    def step(self, text):
        self._say("step", text)

    def counter(self, name, value):
        self._say("metric", f"{name}={value}")

    def info(self, text):
        self._say("info", text)

    def warn(self, text):
        self._say("warn", text)

    def summary(self, run):
        self._say("summary", f"command={run.command}")
        for part in (run.ingest, run.query):
            for k, v in vars(part).items() if part else ():
                self._say("summary", f"{k}={v}")
        for k, v in run.extra:
            self._say("summary", f"{k}={v}")

    def done(self):
        self._say("done", "ok")


class JsonReporter:
    """A JSON object per line; a summary is the bare object."""

    def __init__(self, out=None):
        self.out = out or sys.stdout

    def _say(self, **fields) -> None:
        print(json.dumps(fields), file=self.out, flush=True)

    def phase(self, name):
        self._say(event="phase", name=name)

    def step(self, text):
        self._say(event="step", text=text)

    def counter(self, name, value):
        self._say(event="counter", name=name, value=value)

    def info(self, text):
        self._say(event="info", text=text)

    def warn(self, text):
        self._say(event="warn", text=text)

    def summary(self, run):
        self._say(**run.as_dict())

    def done(self):
        self._say(event="done")
