import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import quality

SF = "/root/testdata/sf0.1"


def test_interactions_are_learnt():
    r = np.random.default_rng(0)
    x = r.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(int)
    m = quality.fit(x, y, bins=16, pairs=1)
    assert set(m.pairs[0]) == {0, 1}
    assert ((m.score(x) > 0.5) == y).mean() > 0.97
    flat = quality.fit(x, y, bins=16, pairs=0)
    assert ((flat.score(x) > 0.5) == y).mean() < 0.7


def test_score_is_the_sum_of_bins():
    r = np.random.default_rng(1)
    x = r.random((500, 2))
    m = quality.fit(x, (x[:, 0] > 0.3).astype(int), bins=8, pairs=1)
    b = m.bins(x)
    z = m.base + m.tables[0][b[0]] + m.tables[1][b[1]] + m.pair_tables[0][b[m.pairs[0][0]], b[m.pairs[0][1]]]
    assert np.allclose(m.score(x), 1 / (1 + np.exp(-z)))


def test_no_rows_and_one_label():
    assert quality.fit(np.zeros((0, 2)), np.zeros(0)).score(np.zeros((1, len(quality.FEATURES))))[0] == 0.5
    assert quality.fit(np.zeros((5, 2)), np.ones(5)).score(np.zeros((1, 2)))[0] > 0.9


def test_held_out_accuracy(spark):
    got = quality.op10_quality(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = got.where("held_out").join(labels, "doc_id").select("quality", "predicted", "score").toPandas()
    assert len(rows) > 300
    good = rows.quality == 1
    print("recall of good", rows.predicted[good].mean(), "junk found", 1 - rows.predicted[~good].mean())
    assert rows.predicted[good].mean() > 0.98
    assert (rows.predicted[~good] == 0).mean() > 0.8
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_nulls_and_clashing_columns(spark):
    docs = spark.createDataFrame([(None, None, 1.0), (1, "", 2.0), (2, "a b", None)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (None, 0), (2, None)], "doc_id long, quality int")
    m = quality.train(docs, labels)
    got = quality.score(docs, m, keep=["doc_id", "score"], name="q").collect()
    assert len(got) == 3 and all(0 <= r["q"] <= 1 for r in got)
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert quality.keep_good(docs.where("false"), labels.where("false")).count() == 0


def test_held_out_is_crc32_of_the_text_of_the_id(spark):
    import zlib

    got = spark.range(200).select("id", quality.remainder("id").alias("r")).collect()
    assert all(r["r"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in got)


def plain_score(model, text):
    """A score by loops: features counted one by one, bins found by comparing, tables added up."""
    raw = text.encode()
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x]
    share = lambda test: sum(test(b) for b in raw) / max(1, len(raw))
    k = max(1, len(words))
    x = [
        len(raw), len(words), sum(len(w) for w in words) / k, max((len(w) for w in words), default=0),
        share(lambda b: 65 <= b <= 90), share(lambda b: 48 <= b <= 57), share(lambda b: b == 33), share(lambda b: b in b",.;:?"),
        share(lambda b: b in b"#$%&*<>{}[]\\^~_=+@/"), share(lambda b: b == 124), share(lambda b: b > 127),
        len(set(words)) / k, max((words.count(w) for w in set(words)), default=0) / k, sum(a == b for a, b in zip(words, words[1:])) / k,
        len(words) / max(1, len(lines)), len(set(lines)) / max(1, len(lines)), sum(len(w) == 1 for w in words) / k,
    ]
    at = [sum(v >= e for e in edges.tolist()) for v, edges in zip(x, model.edges)]
    z = model.base + sum(t[i] for t, i in zip(model.tables, at)) + sum(t[at[i], at[j]] for t, (i, j) in zip(model.pair_tables, model.pairs))
    return 1 / (1 + np.exp(-z))


def test_op10_against_plain_loops(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(docs, labels)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    got = {r["doc_id"]: r for r in quality.op10_quality(spark, sf).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        if len(t) < 4000:
            want = plain_score(model, t)
            assert abs(got[i]["score"] - want) < 1e-9 and got[i]["predicted"] == (want >= 0.3)


def test_an_id_that_many_rows_share_keeps_the_fit_bounded(spark):
    docs = spark.createDataFrame([(7, f"text {i}") for i in range(50)] + [(8, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1), (8, 0)], "doc_id long, quality int")
    seen = []
    fit, quality.fit = quality.fit, lambda x, y, **k: seen.append(len(y)) or fit(x, y, **k)
    try:
        quality.train(docs, labels, max_rows=10)
    finally:
        quality.fit = fit
    assert seen == [10]


def test_a_last_bit_changes_no_bin(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    x = np.array(quality.feature_rows(docs.join(labels.where("doc_id is not null"), "doc_id"), ["doc_id"]).toPandas()["values"].tolist())
    model = quality.fit(x, np.arange(len(x)) % 2)
    assert sum(map(len, model.edges)) > 100
    for other in (np.nextafter(x, np.inf), np.nextafter(x, -np.inf)):
        assert (model.bins(other) == model.bins(x)).all()
