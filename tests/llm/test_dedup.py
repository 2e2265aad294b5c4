import hashlib
import random
import re
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import components as components_of
from tidemark.llm.common import split_join
from tidemark.llm.components import components
from tidemark.llm.exact_dedup import exact_dedup
from tidemark.llm.simhash import covering, simhash_groups
from tidemark.llm.warc import page_records


def brute_exact(rows):
    by = defaultdict(list)
    for i, t in rows:
        by[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    return sorted(
        (i, min(ids), len(ids), i == min(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in by.items() for i in ids
    )


ROWS = [(3, "a  b"), (1, "a\tb"), (2, "a b c"), (5, None), (4, ""), (9, "a b"), (7, "x" * 200_000), (8, "x" * 200_000)]


def test_exact_dedup(docs_of):
    assert sorted(map(tuple, exact_dedup(docs_of(ROWS)).collect())) == brute_exact(ROWS)


def test_exact_dedup_survives_collisions_of_the_hash(docs_of):
    weak = exact_dedup(docs_of(ROWS), hash_of=lambda t: F.lit(b"same"))
    assert sorted(map(tuple, weak.collect())) == brute_exact(ROWS)


def test_exact_dedup_empty_and_null_ids(docs_of):
    assert exact_dedup(docs_of([])).count() == 0
    got = {tuple(r)[:4] for r in exact_dedup(docs_of([(None, "q"), (6, "q"), (None, "z")])).collect()}
    assert got == {(None, 6, 2, False), (6, 6, 2, True), (None, None, 1, True)}


def brute_simhash(rows):
    fps = {}
    for i, t in rows:
        w = [x for x in re.split(rb"[\x20\x09-\x0D]+", (t or "").encode().lower()) if x]
        s = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] * bool(w)
        h = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    comp = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= 3 and comp[b] < comp[a]:
                    comp[a], changed = comp[b], True
    return sorted((i, f"{fps[i]:016x}", comp[i]) for i in fps)


def test_simhash_against_brute_force(docs_of):
    r = random.Random(5)
    base = [" ".join(r.choice("abcdefghij") * r.randint(1, 4) for _ in range(300)) for _ in range(6)]
    rows = [(0, None), (1, ""), (2, "one"), (3, "ONE"), (4, "one two")]
    for k in range(60):
        w = base[k % 6].split()
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = "zz"
        rows.append((10 + k, " ".join(w)))
    got = sorted(map(tuple, simhash_groups(docs_of(rows)).collect()))
    assert got == brute_simhash(rows)
    assert simhash_groups(docs_of([])).count() == 0


def test_simhash_large_postings_are_compared_whole(docs_of, monkeypatch):
    from tidemark.llm import simhash

    monkeypatch.setattr(simhash, "BLOCK", 3)
    rows = [(k, " ".join(f"w{j}" for j in range(400)) + f" tail{k}") for k in range(25)]
    assert sorted(map(tuple, simhash_groups(docs_of(rows)).collect())) == brute_simhash(rows)


def test_covering_meets_every_choice():
    from itertools import combinations

    for least in (3, 4, 5, 6, 7, 8):
        combos = [set(c) for c in covering(least)]
        assert all(any(c <= set(x) for c in combos) for x in combinations(range(8), least))
    assert len(covering(5)) == 14


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (5, 5), (20, 3), (None, 4)] + [(k, k + 1) for k in range(100, 140)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()))
    assert got == {1: 1, 2: 1, 3: 1, 20: 1, 8: 8, 9: 8} | dict.fromkeys(range(100, 141), 100)
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


@pytest.fixture
def sorted_joins(spark):
    """Plans that don't change while they run, without broadcast joins."""
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield lambda df: df._jdf.queryExecution().executedPlan().toString()
    for k, v in before.items():
        spark.conf.set(k, v)


def test_joins_with_an_aggregate_have_shuffles_that_can_be_split(spark, sorted_joins):
    """Both sides of the join are dealt out for it: three exchanges with the aggregate's own, where two would do unsplit."""
    rows = spark.range(100).selectExpr("id % 3 AS k", "concat('s', id % 3) AS s", "id AS v")
    for key in ("k", "s"):
        sums = rows.groupBy(key).agg(F.min("v").alias("m"))
        assert sorted_joins(rows.join(sums, key)).count("Exchange hashpartitioning") == 2
        got = split_join(rows, sums, key)
        assert sorted_joins(got).count("Exchange hashpartitioning") == 3
        assert sorted(map(tuple, got.select("v", "m").collect())) == [(v, v % 3) for v in range(100)]


def test_hot_keys_of_pages_and_stars_are_split(spark, sorted_joins):
    pages = spark.range(50).selectExpr("id AS page_id", "'u' AS url", "concat(id % 2, repeat('same page ', 20)) AS html")
    assert sorted_joins(page_records(pages)).count("Exchange hashpartitioning") == 3
    edges = spark.range(50).selectExpr("id + 1 AS u", "cast(0 as long) AS v")
    star = components_of._hook(edges, lambda d: d.select(F.col("v").alias("u"), F.col("m").alias("v")))
    joined = sorted_joins(star)
    assert joined.count("Exchange hashpartitioning") == 4  # the fourth is that of distinct
