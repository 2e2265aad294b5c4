import io
import json

import pytest

from tidemark import benchmarks, cli
from tidemark.report import JsonReporter, NullReporter, RunSummary, TerminalReporter
from tidemark.streaming import IngestSummary


@pytest.fixture(scope="module")
def run_file(tmp_path_factory):
    path = tmp_path_factory.mktemp("cli") / "run.jsonl"
    assert cli.main(["generate", "--agents", "3", "--ticks", "50", "--out", str(path)]) == 0
    return str(path)


def said(capsys, *argv):
    assert cli.main(list(argv)) == 0
    got = capsys.readouterr()
    return got.out, got.err


def test_queries(spark, run_file, capsys):
    out, err = said(capsys, "query", "latest-at", "--input", run_file, "--kind", "transform3d", "--at", "100000000", "--explain")
    assert out.count("/agent/") == 3 and "[metric] candidate_partitions=" in err and "[done]" in err
    out, err = said(capsys, "query", "range", "--input", run_file, "--kind", "scalar", "--start", "0", "--end", "0")
    assert "result=empty" in out and "candidate_partitions" not in err.split("[summary]")[0]
    out, _ = said(capsys, "--json", "op", "speed", "--input", run_file, "--entity", "/agent/1")
    rows = [json.loads(x) for x in out.splitlines()]
    assert sum("speed_mps" in r for r in rows) == 49
    assert next(r for r in rows if r.get("command") == "speed_over_ground")["query"]["returned_rows"] == 49
    out, err = said(capsys, "op", "proximity", "--input", run_file, "--at", "100000000", "--radius", "9")
    assert "considered_entities=3" in err and out.count("/agent/") == 6


def test_rows_are_printed_in_pages(capsys, monkeypatch):
    from pyspark.sql import Row

    monkeypatch.setattr(cli, "PAGE", 2)
    rows = iter([Row(a=i, b=None) for i in range(5)])
    cli.show(rows, ["a", "b"], False)
    out = capsys.readouterr().out
    assert out.count("|a|") == 3 and out.count("None") == 5 and next(rows, None) is None
    cli.show(iter([]), ["a"], False)
    cli.show(iter([Row(a=1, b=None)]), ["a", "b"], True)
    assert capsys.readouterr().out == 'result=empty\n{"a": 1}\n'


def test_rows_streamed_once_and_files_capped(spark, run_file, capsys, tmp_path):
    out, err = said(capsys, "--json", "query", "range", "--input", run_file, "--kind", "scalar", "--start", "0", "--end", "30000000", "--store", f"file://{tmp_path}/s", "--batch-rows", "7")
    assert sum("unit" in json.loads(x) for x in out.splitlines()) == 6
    summary = next(json.loads(x) for x in out.splitlines() if '"ingest"' in x)["ingest"]
    assert summary["max_batch_rows"] == 7 and summary["batches_flushed"] > 20
    assert max(x.stat().st_size for x in (tmp_path / "s/versions").iterdir()) < 1000


def test_errors_and_ingest(spark, run_file, capsys):
    assert cli.main(["op", "speed", "--input", run_file, "--entity", "agent"]) == 2
    assert cli.main(["op", "proximity", "--input", run_file, "--at", "1", "--radius", "-1"]) == 2
    _, err = said(capsys, "ingest", "--input", run_file)
    assert "events_received=183" in err and "[metric] rows=183" in err


def test_limits_and_percentiles(capsys):
    out, _ = said(capsys, "limits")
    assert out == cli.numbered_limits() == said(capsys, "non-claims")[0] and all(x.endswith(".") for x in out.splitlines())
    values = list(range(51))
    assert [benchmarks.percentile(values, q) for q in (0.5, 0.95, 0.99)] == [25, 48, 50]
    assert len(benchmarks.measure(lambda: None, 3)) == 3


def test_bench_and_figures(spark, tmp_path):
    report = benchmarks.run_all(spark, samples=1, small=True)
    rows = {(s["suite"], s["name"]): s["rows"] for s in report["scenarios"]}
    assert rows["ingest", "8x500"] == 4840 and rows["latest_at", "8x500"] == 8 and rows["range_scan", "8x500"] == 125
    assert rows["proximity", "50 nested"] == rows["proximity", "50 grid"] == 1225 and rows["speed", "200"] == 199
    report["scenarios"] += [s | {"n": s["n"] * 2} for s in report["scenarios"]]
    assert report["growth"] == {}
    made = [{"suite": "speed", "n": n, "p50_us": 3.0 * n} for n in (10, 40, 20)] + [{"suite": "proximity", "method": "nested", "n": n, "p50_us": n * n} for n in (5, 50)]
    assert {k: round(v, 6) for k, v in benchmarks.growth(made).items()} == {"speed": 1.0, "proximity nested": 2.0}
    paths = benchmarks.figures(report, f"{tmp_path}/figs")
    assert all(p.endswith(".svg") and 'class="p95"' in open(p).read() for p in paths)
    benchmarks.write_report(report, f"{tmp_path}/bench.json")
    assert cli.main(["figs", "--from", f"{tmp_path}/bench.json", "--out", f"{tmp_path}/more"]) == 0


def test_reporters():
    out = io.StringIO()
    for r in (NullReporter(), TerminalReporter(out), JsonReporter(out)):
        r.phase("p"), r.step("s"), r.counter("c", 1), r.info("i"), r.warn("w")
        r.summary(RunSummary("x", IngestSummary(events_received=2)))
        r.done()
    lines = out.getvalue().splitlines()
    assert "[tidemark] p" in lines and "[summary] events_received=2" in lines
    assert json.loads(lines[-2])["ingest"]["events_received"] == 2 and json.loads(lines[-1]) == {"event": "done"}
