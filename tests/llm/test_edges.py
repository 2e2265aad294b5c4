"""Every query on null and repeated ids, null, empty and long texts, tables without rows, and columns of clashing names."""

from collections import Counter

import pytest

import corpus_pipeline
from tidemark.llm import queries

LINE = "one line that is here more than once"
TEXTS = [
    (1, None), (None, "a b c d e f g"), (None, "a b c d e f g"), (None, None), (None, "unlike the others by all its words"), (2, ""), (2, ""),
    (3, "same id and this text all rights reserved"), (3, "another text of that id"), (4, "word " * 9000), (5, f"{LINE}\n{LINE}\n\n x"), (6, LINE),
    (7, "x" * 30_000), (8, LINE + " end"),
]
CLASHES = (
    "hash ids norm key fp payload media label score wanted doc no sequence_id start length h1 h2 values id same bytes group a b row digest first part "
    "n blocks node component shard block keep_id __gone __doc __key __score __id __node __kept __lines_dropped __text pcm feature file offset u v m"
).split()


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """A folder of tables with odd rows, and one whose tables are empty."""
    odd, empty = (str(tmp_path_factory.mktemp(x)) for x in ("odd", "empty"))
    extra = ", ".join(f"'x' AS `{c}`" for c in CLASHES)
    spark.createDataFrame(TEXTS, "doc_id long, text string").createOrReplaceTempView("edge_docs")
    docs = spark.sql(f"SELECT doc_id, text, 'en' AS lang, 's' AS source, {extra} FROM edge_docs")
    labels = spark.createDataFrame(
        [(i, i % 2, 0) for i in range(1, 9)] + [(3, 1, 0), (3, None, 0), (None, 1, None), (99, 1, 1)], "doc_id long, quality int, toxic int"
    )
    html = "<p>" + "page " * 40
    pages = [(1, "u", html), (2, None, html), (None, "u", html), (None, None, None), (4, "u", "small"), (5, "u", "small"), (1, "u", html), (6, "v", "é" * 50_000)]
    spark.createDataFrame(pages, "page_id long, url string, html string").createOrReplaceTempView("edge_pages")
    pages = spark.sql(f"SELECT page_id, url, html, {extra} FROM edge_pages")
    spark.createDataFrame([(1, None), (None, LINE), (2, LINE), (2, "unlike, words"), (3, "")], "item_id long, text string").createOrReplaceTempView("edge_items")
    chats = [(1, 0, "user", None), (1, 1, None, LINE), (None, 0, "user", LINE), (None, None, "assistant", ""), (2, 0, "user", LINE), (2, 0, "user", LINE), (3, 0, "x", "word " * 9000)]
    spark.createDataFrame(chats, "conv_id long, turn long, role string, text string").createOrReplaceTempView("edge_chats")
    ones = [0.25] * 64
    vectors = [(1, ones), (1, ones), (None, ones), (2, None), (3, ones[1:]), (4, [None, *ones[1:]]), (5, [float("nan"), *ones[1:]]), (6, [1e30, *ones[1:]])]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").createOrReplaceTempView("edge_vectors")
    items = spark.sql(f"SELECT item_id, text, {extra} FROM edge_items")
    vectors = spark.sql(f"SELECT vec_id, embedding, 1 AS label, {extra.replace(', ' + chr(39) + 'x' + chr(39) + ' AS `label`', '')} FROM edge_vectors")
    chats = spark.sql(f"SELECT conv_id, turn, role, text, {extra} FROM edge_chats")
    tables = {"documents": docs, "labels": labels, "pages": pages, "benchmark": items, "embeddings": vectors, "conversations": chats}
    for name, df in tables.items():
        df.repartition(3).write.parquet(f"{odd}/{name}.parquet")
        df.where("false").write.parquet(f"{empty}/{name}.parquet")
    return odd, empty


@pytest.mark.parametrize("name", list(queries.queries()))
def test_queries(spark, folders, name):
    odd, empty = folders
    found = queries.queries()[name]
    assert found(spark, empty).count() == (name == "op11_chat")  # its probe
    rows = found(spark, odd).collect()
    if name == "op9_warc":
        kinds = Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in rows)
        assert kinds == {(1, "response", None): 2, (2, "revisit", 1): 1, (None, "revisit", 1): 1, (None, "response", None): 1,
                         (4, "response", None): 1, (5, "response", None): 1, (6, "response", None): 1}
        return
    if name == "op11_chat":
        assert {r["conv_id"]: r["n_turns"] for r in rows} == {-1: 2, None: 2, 1: 2, 2: 2, 3: 1}
        return
    if name == "op12_centroids":
        assert Counter((r["vec_id"], r["distance"]) for r in rows) == {(1, 0): 2, (None, 0): 1}
        return
    if name == "op13_lexical":
        found = {(r["item_id"], r["doc_id"]) for r in rows}
        assert {(None, 6), (2, 8), (2, None)} <= found and 1 not in {i for i, _ in found}
        return
    ids = Counter(i for i, _ in TEXTS)
    if name != "op8_packing":
        assert Counter(r["doc_id"] for r in rows) == ids
    else:
        assert Counter(r["doc_id"] for r in rows if r["start"] == 0) == ids
        whole = Counter()
        for r in rows:
            whole[r["doc_id"]] += r["length"]
        assert sum(whole.values()) == sum(r["doc_tokens"] for r in rows if r["start"] == 0)
    if name == "op5_token_files":
        ordered = sorted(rows, key=lambda r: r["start"])
        assert [r["doc_id"] is None for r in ordered] == sorted((i is None for i, _ in TEXTS), reverse=True)
        assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(ordered, ordered[1:]))
    if name == "op4_simhash":
        groups = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in rows}
        assert groups[1, "0" * 16] == groups[None, "0" * 16] == groups[2, "0" * 16] == 1


def test_pipeline(spark, folders):
    odd, empty = folders
    assert corpus_pipeline.run(spark, empty).count() == 0
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[1:3]:
        docs = stage(spark, docs, odd)
        assert docs.columns[:2] == ["doc_id", "text"] and len(docs.columns) == 4 + len(CLASHES), name
    kept = Counter((r["doc_id"], (r["text"] or "").strip()[:30]) for r in docs.collect())
    assert (None, "unlike the others by all its w") in kept and kept[None, "a b c d e f g"] == 1
    assert (3, "same id and this text all righ") in kept and (3, "another text of that id") in kept and (6, LINE[:30]) not in kept
    assert corpus_pipeline.STAGES[3][1](spark, docs, odd).select("doc_id").distinct().count() > 3
    corpus_pipeline.run(spark, odd).count()
