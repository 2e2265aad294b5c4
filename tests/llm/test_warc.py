import gzip
import hashlib
import io
import zlib
from collections import defaultdict

import pytest

from tidemark.llm import warc

PAGES = [
    (5, "http://a/", "x" * 150), (2, "http://b/", "x" * 150), (9, None, "x" * 150), (3, "http://c/", "small"),
    (4, "http://d/", "small"), (7, "http://e/", None), (8, "http://f/\r\nX: y", "é" * 60), (6, "http://g/", "é" * 60),
    (10, "http://h/", "long " * 400_000), (-1, "http://i/", "y" * 99), (11, "http://j/", "a\r\n\r\nb" * 40),
]


def brute(pages):
    by = defaultdict(list)
    for i, _, h in pages:
        by[h or ""].append(i)
    out = []
    for h, ids in by.items():
        raw = h.encode()
        for i in ids:
            again = len(raw) >= 100 and i != min(ids)
            out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", min(ids) if again else None))
    return sorted(out)


def test_op9(spark, tmp_path):
    spark.createDataFrame(PAGES, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted(map(tuple, warc.op9_warc(spark, str(tmp_path)).collect())) == brute(PAGES)


def test_filters_are_taken_over(spark, tmp_path):
    warc.register(spark)
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    path = f"file://{tmp_path}/w"
    warc.page_records(pages).repartition(3).write.format("warc").mode("append").save(path)
    got = spark.read.format("warc").load(path).where("record_type = 'revisit' and refers_to is not null and target_uri like 'http://a%'")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan, plan
    assert [r["record_id"] for r in got.collect()] == ["<urn:page:5>"]
    assert spark.read.format("warc").load(path).where("payload_length > 1000000").count() == 1
    assert spark.read.format("warc").option("payload", "false").load(path).where("payload is not null").count() == 0
    files = [p for p in (tmp_path / "w").iterdir() if p.suffix == ".gz"]
    assert b"WARC/1.1" in gzip.decompress(files[0].read_bytes())  # an ordinary gzip file


def test_unwanted_payloads_are_not_inflated():
    good = warc.member(warc.record({"record_type": "response", "record_id": "a"}, b"p" * 100_000))
    broken = bytearray(warc.member(warc.record({"record_type": "other", "record_id": "b"}, bytes(range(256)) * 2000)))
    broken[-2000:-100] = b"\xff" * 1900  # would not inflate
    got = list(warc.read_records(io.BytesIO(good + bytes(broken) + good), lambda f: f["record_type"] == "response"))
    assert [f["record_id"] for f, *_ in got] == ["a", "a"] and got[0][1] == b"p" * 100_000


def test_members_of_other_writers():
    one = warc.record({"record_type": "response", "record_id": "a"}, b"q" * 3_000_000)
    data = b"".join(gzip.compress(one) for _ in range(3))
    got = list(warc.read_records(io.BytesIO(data), lambda f: True))
    assert [len(p) for _, p, _ in got] == [3_000_000] * 3
    assert len(list(warc.read_records(io.BytesIO(data), lambda f: True, with_payload=False))) == 3


def test_wrong_digest_is_found():
    fields = {"record_type": "response", "record_id": "a", "payload_digest": "sha256:" + "0" * 64}
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(warc.member(warc.record(fields, b"x"))), lambda f: True))
    assert zlib.decompress(warc.member(b"abc"), 31) == b"abc"


def test_no_pages(spark, tmp_path):
    warc.register(spark)
    none = spark.createDataFrame([], "page_id long, url string, html string")
    warc.page_records(none).write.format("warc").mode("append").save(f"{tmp_path}/none")
    assert spark.read.format("warc").load(f"{tmp_path}/none").count() == 0
