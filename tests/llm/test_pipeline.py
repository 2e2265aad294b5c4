import random
import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import near_documents as nd
from tidemark.llm import common, line_dedup, packing
from tests.llm.test_lines import brute as brute_lines

SF = "/root/testdata/sf0.01"


def groups_of(rows, words=5, least=0.8):
    sets = {i: set(nd.shingle_hashes(t, words).tolist()) for i, t in rows}
    of = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if of[b] < of[a] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                    of[a], changed = of[b], True
    return of


def test_shingle_sets_tell_texts_apart_as_shingles_do():
    import re

    r = random.Random(1)
    texts = [None, "", " \n", "a", "A", " a ", "a b", "a  B\t", "a b c d e", "a b c d e f", "b c d e f", "ÉA b c d e", "éa b c d e", "a\x1fb c", "a\u00a0b c"]
    texts += [" ".join(r.choices("abé", k=r.randint(0, 9))) + r.choice(["", " ", "\n"]) for _ in range(300)]

    def shingles(t, n):
        fold = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", fold) if x]
        return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1)))

    for n in (1, 3, 5):
        sets = nd.shingle_sets(nd.pa.array(texts, nd.pa.string()).slice(1), n)
        want = [shingles(t, n) for t in texts[1:]]
        assert [len(x) for x in sets] == [len(x) for x in want]
        of = dict(zip(want, (x.tobytes() for x in sets)))
        assert all(of[w] == x.tobytes() for w, x in zip(want, sets)) and len(set(of.values())) == len(of)
        assert all((np.diff(x.astype(object)) > 0).all() for x in sets)


def near_corpus(seed=3, bases=25, copies=6):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    rows = [(0, ""), (1, None), (2, "two words"), (3, "two words")]
    for _ in range(bases):
        base = [word() for _ in range(r.randint(60, 400))]
        for _ in range(copies):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 45))):
                w[r.randrange(len(w))] = word()
            rows.append((len(rows), " ".join(w)))
    return rows


def test_near_documents_against_brute_force(docs_of):
    rows = near_corpus()
    want = groups_of(rows)
    got = {r["doc"]: r["group_id"] for r in nd.near_documents(docs_of(rows)).collect()}
    assert set(got) == set(want)
    pairs = [(a, b) for a in want for b in want if a < b and want[a] == want[b]]
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.99 * len(pairs)
    assert all(want[a] == want[b] for a in got for b in got if got[a] == got[b])


def test_partners_beyond_the_nearest_are_met(docs_of, monkeypatch):
    rows = near_corpus(seed=5, bases=6, copies=14)
    split = lambda: {r["doc"]: r["group_id"] for r in nd.near_documents(docs_of(rows)).collect()}
    monkeypatch.setattr(nd, "NEAREST", 10_000)
    want = split()
    for nearest in (0, 1):
        monkeypatch.setattr(nd, "NEAREST", nearest)
        assert split() == want


def test_bytes_agree_as_often_as_shingles():
    r = np.random.default_rng(0)
    agree = []
    for _ in range(60):
        both, a, b = r.integers(0, 2**63, 400, dtype=np.uint64), *r.integers(0, 2**63, (2, 50), dtype=np.uint64)
        agree.append((nd.wide_fingerprint(np.concatenate([both, a])) == nd.wide_fingerprint(np.concatenate([both, b]))).mean())
    assert abs(np.mean(agree) - 0.8) < 0.03


def test_the_exact_way_loses_no_link(spark, monkeypatch):
    monkeypatch.setattr(nd, "SETS", 8)  # large postings are compared block by block
    r = np.random.default_rng(12)
    base = [[f"w{r.integers(0, 400)}" for _ in range(r.integers(5, 120))] for _ in range(12)]
    rows = []
    for i in range(150):
        words = list(base[r.integers(0, 12)])
        for _ in range(r.integers(0, 4)):
            words[r.integers(0, len(words))] = f"x{r.integers(0, 30)}"
        rows.append((i - 20, " ".join(words)))
    rows += [(500, None), (501, ""), (502, "a b"), (503, "A  b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = groups_of(rows)
    got = {x["doc"]: x["group_id"] for x in nd.near_documents(docs, exact=True).collect()}
    assert got == want and len(set(want.values())) < 120
    kept = {x["doc_id"] for x in nd.keep_first(docs, exact=True).collect()}
    assert kept == set(want.values())


def test_kept_documents_keep_their_columns(spark):
    docs = spark.createDataFrame([(4, "a b c", "x"), (2, "a b c", "y"), (None, "a b c", "z"), (None, None, "n")], "doc_id long, text string, doc string")
    got = {tuple(r) for r in nd.keep_first(docs).collect()}
    assert (2, "a b c", "y") in got and (4, "a b c", "x") not in got
    assert nd.keep_first(docs.where("false")).count() == 0


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    good = corpus_pipeline.good_documents(spark, docs, SF).cache()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    known = docs.join(labels, "doc_id")
    assert good.columns == columns
    kept = known.join(good.select("doc_id"), "doc_id", "left_semi").groupBy("quality").count().collect()
    total = dict(known.groupBy("quality").count().collect())
    kept = {r["quality"]: r["count"] for r in kept}
    assert kept[1] > 0.98 * total[1] and kept.get(0, 0) < 0.2 * total[0]

    part = good.where("doc_id < 300").cache()
    lines = corpus_pipeline.new_lines(spark, part, SF).cache()
    assert lines.columns == columns
    want = {r[0]: r for r in brute_lines([(r["doc_id"], r["text"]) for r in part.select("doc_id", "text").collect()])}
    import hashlib

    for r in lines.collect():
        assert hashlib.sha256((r["text"] or "").encode()).hexdigest() == want[r["doc_id"]][3]

    near = corpus_pipeline.first_of_near(spark, lines, SF).cache()
    rows = [(r["doc_id"], r["text"]) for r in lines.collect()]
    want = {i for i, g in groups_of(rows).items() if i == g}
    got = {r["doc_id"] for r in near.collect()}
    assert near.columns == columns and want <= got and len(got - want) <= 0.01 * len(rows)

    pieces = corpus_pipeline.packed(spark, near, SF)
    assert pieces.select("doc_id").distinct().count() == near.count()
    assert pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= packing.Limits().tokens


def test_run(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and got.count() > 50


def test_ids_link_no_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(5, a, 1), (9, b, 2), (None, a, 3), (None, b + " end", 4), (None, c, 5), (None, c + " end", 6), (None, None, 7), (7, c + " more", 8)]
    rows += [(3, "same id " + x, 9 + i) for i, x in enumerate(["one", "two", "two"])] + [(1, "alone", 12), (2, a + " end", 13), (2, "another", 14)]
    rows += [(None, "only null ids", 15), (None, "only null ids", 16)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long")
    got = sorted((r["doc_id"], r["text"]) for r in nd.keep_first(docs).collect() if r["doc_id"] is not None)
    null = sorted(r["text"] or "" for r in nd.keep_first(docs).collect() if r["doc_id"] is None)
    assert got == sorted([(9, b), (7, c + " more"), (3, "same id one"), (3, "same id two"), (1, "alone"), (2, a + " end"), (2, "another")])
    assert null == ["", "only null ids"]


def test_texts_are_merged_whatever_is_joined_with_them(spark, monkeypatch):
    """A broadcast of what is small yet would let shuffles grow by steps, faster than the input."""
    plans = {}

    def told(df, name, **options):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return common.stored(df, name, **options)

    words = [" ".join(f"w{(i * 7 + k) % 50}" for k in range(12)) for i in range(20)]
    docs = spark.createDataFrame([(i, f"{w}\nline {i}") for i, w in enumerate(words)], "doc_id long, text string")
    docs = common.stored(docs, "docs")
    monkeypatch.setattr(line_dedup, "stored", told)
    kept = line_dedup.dedup_lines(docs)._jdf.queryExecution().executedPlan().toString()
    joins = lambda plan: re.findall(r"\w+Join(?= \[)", plan)  # noqa: E731  from the top
    assert joins(plans["picked-lines"])[0] == joins(kept)[0] == "SortMergeJoin"
    texts = docs.select(F.col("doc_id").alias("doc"), "text")
    classes = nd._fingerprints(texts, 5).select("doc", "bytes")
    near = nd._probable_links(classes, texts, 5, 0.8)._jdf.queryExecution().executedPlan().toString()
    first = nd.keep_first(docs)._jdf.queryExecution().executedPlan().toString()
    assert joins(near)[:2] == ["SortMergeJoin"] * 2 and joins(first)[0] == "SortMergeJoin"
