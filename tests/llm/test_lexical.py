import math
import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k=20):
    """Rows (item, rank, doc, score) by scoring every document for every item."""
    own = [(i, Counter(words(t))) for i, t in docs]
    total = sum(c.total() for _, c in own)
    n = sum(c.total() > 0 for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in own:
            m = 75 + (25 * c.total() * n) // max(1, total)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in words(text) if c[t])
            if s > 0:
                scored.append((-s, 2**63 if i is None else i, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def random_docs(r, n):
    names = ["the", "of", "Über", "ÉCOLE", "x1", "naïve", "日本語", *(f"w{i}" for i in range(40))]
    p = 1 / np.arange(1, len(names) + 1)
    texts = [" ,.-\n"[i % 5].join(r.choice(names, r.integers(1, 60), p=p / p.sum())) for i in range(n)]
    return list(enumerate(texts)), names


@pytest.mark.parametrize("together", [1, 100, 1 << 15])
def test_equals_loops(spark, monkeypatch, together):
    monkeypatch.setattr(lexical, "TOGETHER", together)
    r = np.random.default_rng(3)
    docs, names = random_docs(r, 300)
    docs += [(1000, None), (1001, ""), (1002, "..."), (None, "the w1 x1"), (7, "w3 w3 w3"), (7, "w3 w3 w3"), (-5, "w3 w3 w3"), (2000, "w2 " * 40_000)]
    items = [(i, " ".join(r.choice(names, 12))) for i in range(9)] + [(90, None), (91, "unknownword"), (None, "w3"), (92, "W3 w3, w39!"), (92, "the"), (93, "w5 " * 5000)]
    a = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, score int").repartition(3)
    b = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, rank int")
    assert rows_of(lexical.search(lexical.build(a), b)) == plain(docs, items)


def test_passes_and_small_blocks_change_nothing(spark, monkeypatch):
    docs, names = random_docs(np.random.default_rng(4), 120)
    items = [(i, f"{names[i]} {names[i + 9]} w1") for i in range(7)]
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(lexical, "ITEMS", 3)
    monkeypatch.setattr(lexical, "BLOCK", 500)
    assert rows_of(lexical.search(lexical.build(a), b)) == plain(docs, items)
    assert rows_of(lexical.search(lexical.build(a), b, k=2)) == plain(docs, items, 2)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    some, one = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(lexical.build(docs), one).count() == lexical.search(lexical.build(some), items).count() == 0


def test_slices_add_like_integers():
    r = np.random.default_rng(5)
    total = np.zeros((40, 3, 4), np.uint64)
    plain_sum = np.zeros((3, 256), np.int64)
    for _ in range(50):
        at = np.sort(r.choice(256, r.integers(1, 200), replace=False))
        values = r.integers(1, 2**30, len(at))
        more = lexical.sliced(values, at, int(values.max()).bit_length())
        part = total[:, :, : more.shape[1]].copy()
        lexical.add(part, more)
        total[:, :, : more.shape[1]] = part
        plain_sum[:, at] += values
    assert all((lexical.read_out(np.ascontiguousarray(total[:, i]), np.arange(256)) == plain_sum[i]).all() for i in range(3))


@pytest.mark.parametrize("top", [2, 9, 2**20])
def test_best_breaks_ties_by_id(top):
    r = np.random.default_rng(top)
    for n in (1, 64, 300):
        values, ids = r.integers(0, top, n), r.permutation(n)
        values[0] = 1
        slices = lexical.sliced(values, np.arange(n), 21)
        want = sorted((-v, i, k) for k, (v, i) in enumerate(zip(values.tolist(), ids.tolist())) if v)[:20]
        got = lexical.best(slices, 20, np.append(ids, np.zeros(64, int)))
        assert sorted(got.tolist()) == sorted(k for *_, k in want)
