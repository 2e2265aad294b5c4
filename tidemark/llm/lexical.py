"""Ranked lexical search by a bit-sliced impact index.

The index is a table of blocks. A block has some thousand documents: their ids and lengths, its distinct terms, and for each
term the places and counts of the documents that hold it. Searching takes impacts: what a term adds to a document's
score, an integer. In a block a term's impacts become bitmaps, one for each bit, over the words of 64 documents in which the
term occurs; an item's score is their sum by full adders on whole words, and its best documents are found from the most
significant slice downwards.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stored, table
from tidemark.llm.tokens import distinct, slices, utf8
from tidemark.sources.scratch import scratch

TOP = 20
#: Items that are searched for in one pass over the index, and bytes of their texts; a longer text is a pass of its own.
ITEMS, ITEM_BYTES = 256, 4 << 20
#: Bytes of text that make a block.
BLOCK = 8 << 20
#: Documents whose blocks are searched together: so many, and what the last block has beyond.
TOGETHER = 32_768

#: Lower case of A-Z, and which bytes belong to terms: letters and digits of ASCII, and all of other characters.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TERM = np.zeros(256, bool)
_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

_INDEX = "block long, doc_ids binary, lengths binary, terms array<string>, dfs binary, places binary, counts binary"


def terms_of(column: pa.Array) -> tuple[np.ndarray, pa.StringArray, np.ndarray]:
    """Of the terms of a column of texts in order: which of the distinct ones each is, these, and where each text's end."""
    raw, offsets = utf8(column)
    inside = _TERM[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < len(raw)]
    begins[first] = inside[first]
    at = np.flatnonzero(begins)
    solid = _LOWER[raw[inside]]
    if not len(at):
        return np.zeros(0, np.int64), pa.array([], pa.string()), np.zeros(len(offsets) - 1, np.int64)
    which, names = distinct(solid, np.cumsum(inside)[at] - 1)
    return which, names, np.searchsorted(at, offsets[1:])


def _block(ids: np.ndarray, column: pa.Array) -> dict:
    which, names, ends = terms_of(column)
    doc = np.repeat(np.arange(len(ends)), np.diff(np.append(0, ends)))
    keys, counts = np.unique(which.astype(np.int64) * len(ends) + doc, return_counts=True)
    return {
        "doc_ids": ids.tobytes(),
        "lengths": np.diff(np.append(0, ends)).astype("<i4").tobytes(),
        "terms": names.to_pylist(),
        "dfs": np.bincount(keys // max(1, len(ends)), minlength=len(names)).astype("<i4").tobytes(),
        "places": (keys % max(1, len(ends))).astype("<i4").tobytes(),
        "counts": counts.astype("<i4").tobytes(),
    }


#: How a null id is kept.
_NO_ID = -(2**63)


def build(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of whole texts, stored: a row for each block, all within one task's slice of at most BLOCK bytes of text.

    Null texts have no terms; null and repeated ids are documents of their own (the smallest long stands for null).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for b in batches:
            ids = b.column(0).fill_null(_NO_ID).to_numpy(zero_copy_only=False).astype("<i8")
            for i, j in slices(b.column(1), BLOCK):
                yield pa.RecordBatch.from_pylist([{"block": number, **_block(ids[i:j], b.column(1).slice(i, j - i))}], schema)
                number += 1

    kinds = {"long": pa.int64(), "binary": pa.binary(), "array<string>": pa.list_(pa.string())}
    schema = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in _INDEX.split(", "))])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return stored(rows.mapInArrow(run, _INDEX), "lexical-index", compression="zstd")


def _sizes(index: DataFrame) -> tuple[int, int]:
    """Documents with at least one term, and terms of all documents with their repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for b in batches:
            for raw in b.column(0).to_pylist():
                lengths = np.frombuffer(raw, "<i4")
                n, total = n + int((lengths > 0).sum()), total + int(lengths.sum(dtype=np.int64))
        yield pa.record_batch([pa.array([n]), pa.array([total])], names=["n", "total"])

    row = index.select("lengths").mapInArrow(run, "n long, total long").agg(F.sum("n"), F.sum("total")).first()
    return row[0] or 0, row[1] or 0


def _frequencies(index: DataFrame, terms: list[str]) -> dict[str, int]:
    """In how many documents each of a pass's terms occurs; a task sends a row for each of them at most."""
    wanted = index.sparkSession.sparkContext.broadcast(frozenset(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, int] = defaultdict(int)
        for b in batches:
            for names, dfs in zip(b.column(0), b.column(1).to_pylist()):
                for t, n in zip(names.as_py(), np.frombuffer(dfs, "<i4").tolist()):
                    if t in wanted.value:
                        found[t] += n
        yield pa.record_batch([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["term", "df"])

    return dict(map(tuple, index.select("terms", "dfs").mapInArrow(run, "term string, df long").groupBy("term").agg(F.sum("df")).collect()))


def sliced(values: np.ndarray, at: np.ndarray, bits: int) -> np.ndarray:
    """Bitmaps (bits, words of 64) of integers that stand at places ``at``, 0 elsewhere; places count from the first word's."""
    words = int(at[-1]) // 64 + 1
    dense = np.zeros((bits, words * 64), bool)
    dense[:, at] = (values >> np.arange(bits)[:, None]) & 1
    return np.packbits(dense, axis=1, bitorder="little").view("<u8")


def add(total: np.ndarray, more: np.ndarray) -> None:
    """Add integers in slices to others in place: a full adder for each bit, over all words at once.

    ``total`` has (slices, ..., words) and enough slices for the sum; ``more`` (fewer slices, words).
    """
    carry = np.zeros(total.shape[1:], np.uint64)
    for s in range(len(total)):
        if s < len(more):
            half, both = total[s] ^ more[s], total[s] & more[s]
            total[s] = half ^ carry
            carry = both | (half & carry)
        else:
            if not carry.any():
                return
            total[s], carry = total[s] ^ carry, total[s] & carry


def _bits(words: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))


def best(scores: np.ndarray, k: int, ids: np.ndarray) -> np.ndarray:
    """Places of the k largest of integers in slices, 0 left out; of equal ones at the end those of smaller ``ids``.

    From the most significant slice downwards: ``sure`` are above the k-th largest, ``open`` equal it in the slices so far.
    """
    sure = np.zeros(scores.shape[1], np.uint64)
    open_ = np.bitwise_or.reduce(scores, axis=0)
    count = lambda x: int(np.bitwise_count(x).sum())
    if count(open_) <= k:
        return _bits(open_)
    for s in range(len(scores) - 1, -1, -1):
        more = open_ & scores[s]
        n = count(sure | more)
        if n > k:
            open_ = more
        else:
            sure, open_ = sure | more, open_ & ~scores[s]
            if n == k:
                return _bits(sure)
    ties = _bits(open_)
    ties = ties[np.argsort(ids[ties], kind="stable")]
    return np.append(_bits(sure), ties[: k - count(sure)])


def read_out(scores: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The integers at some places of slices."""
    bits = (scores[:, at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1)
    return (bits.astype(np.int64) << np.arange(len(scores))[:, None]).sum(0)


class Pass:
    """Items of one pass: for each term its weight and, by how often it stands in an item, the items."""

    def __init__(self, items: list[dict[str, int]], n: int, total: int, dfs: dict[str, int]):
        self.n, self.total, self.count = n, total, len(items)
        self.weights = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) for t, df in dfs.items()}
        self.items: dict[str, dict[int, list[int]]] = {}
        most = 0
        for i, terms in enumerate(items):
            most = max(most, sum(self.weights.get(t, 0) * q for t, q in terms.items()))
            for t, q in terms.items():
                if self.weights.get(t):
                    self.items.setdefault(t, {}).setdefault(q, []).append(i)
        self.slices = max(1, (most * 1_000_000).bit_length())

    def impacts(self, weight: int, counts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        tf, m = counts.astype(np.int64), 100 - 25 + (25 * lengths.astype(np.int64) * self.n) // self.total
        return weight * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))

    def search(self, ids: np.ndarray, lengths: np.ndarray, postings: dict[str, tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[int, int, int]]:
        """(item, place, score) of the k best documents of each item among those given."""
        scores = np.zeros((self.slices, self.count, -(-len(ids) // 64)), np.uint64)
        for t, (at, counts) in postings.items():
            impacts = self.impacts(self.weights[t], counts, lengths[at])
            words, number = np.unique(at // 64, return_inverse=True)
            for q, items in self.items[t].items():
                own = impacts * q
                more = sliced(own, number * 64 + at % 64, int(own.max()).bit_length())
                where = np.ix_(range(self.slices), items, words)
                part = scores[where]
                add(part, more)
                scores[where] = part
        out = []
        for i in range(self.count):
            own = np.ascontiguousarray(scores[:, i])
            at = best(own, k, ids)
            out += zip([i] * len(at), at.tolist(), read_out(own, at).tolist())
        return out


def _searched(index: DataFrame, found: Pass, names: list[int], k: int) -> DataFrame:
    """item (its number), doc_id, score: of each task the k best documents for each item."""
    shared = index.sparkSession.sparkContext.broadcast(found)

    def flushed(held: list[dict], top: dict[int, list]) -> None:
        q = shared.value
        sizes = [len(x["doc_ids"]) // 8 for x in held]
        starts = np.cumsum([0, *sizes])
        parts: dict[str, list] = defaultdict(list)
        for x, start in zip(held, starts.tolist()):
            ends = np.cumsum(np.frombuffer(x["dfs"], "<i4"), dtype=np.int64)
            at, counts = np.frombuffer(x["places"], "<i4"), np.frombuffer(x["counts"], "<i4")
            for j, t in enumerate(x["terms"]):
                if t in q.items:
                    a, b = (ends[j - 1] if j else 0), ends[j]
                    parts[t].append((at[a:b].astype(np.int64) + start, counts[a:b]))
        postings = {t: tuple(map(np.concatenate, zip(*p))) for t, p in parts.items()}
        ids, lengths = (np.concatenate([np.frombuffer(x[c], kind) for x in held]) for c, kind in (("doc_ids", "<i8"), ("lengths", "<i4")))
        order = np.where(ids == _NO_ID, 2**63 - 1, ids)
        for i, at, score in q.search(order, lengths, postings, k):
            top[i].append((-score, int(order[at]), int(ids[at])))
        for i in top:
            top[i] = sorted(top[i])[:k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, top = [], 0, defaultdict(list)
        for b in batches:
            for x in (b.slice(i, 1).to_pylist()[0] for i in range(len(b))):
                held.append(x)
                n += len(x["doc_ids"]) // 8
                if n >= TOGETHER:
                    flushed(held, top)
                    held, n = [], 0
        if held:
            flushed(held, top)
        rows = [(i, None if doc == _NO_ID else doc, -s) for i, found in top.items() for s, _, doc in found]
        cols = list(zip(*rows)) or [(), (), ()]
        yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=["item", "doc_id", "score"])

    told = index.select("doc_ids", "lengths", "terms", "dfs", "places", "counts").mapInArrow(run, "item long, doc_id long, score long")
    return told.withColumn("item_id", F.element_at(F.array(*(F.lit(x).cast("long") for x in names)), (F.col("item") + 1).cast("int")))


def _passes(items: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list[int], list[dict[str, int]]]]:
    """The items a pass at a time, ids and counts of terms; the driver holds one partition of them."""
    names, found, size = [], [], 0
    for r in items.select(F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))).toLocalIterator():
        if names and (len(names) == ITEMS or size + len(r[1]) > ITEM_BYTES):
            yield names, found
            names, found, size = [], [], 0
        which, terms, _ = terms_of(pa.array([r[1]]))
        counts = np.bincount(which, minlength=len(terms)).tolist()
        names.append(r[0])
        found.append(dict(zip(terms.to_pylist(), counts)))
        size += len(r[1])
    if names:
        yield names, found


def search(index: DataFrame, items: DataFrame, *, k: int = TOP, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of the index with the highest score above 0 for each item.

    Equal scores rank by ascending doc_id, null ids last. Null and repeated item ids are items of their own. Items are taken
    ITEMS (or ITEM_BYTES of text) at a time, which bounds what tasks get; each such pass reads the index once and appends
    its rows, k for each item and task, to a table from which the k best of all tasks are taken.
    """
    spark: SparkSession = index.sparkSession
    n, total = _sizes(index)
    path, schema = scratch(spark, "lexical-found"), "pass long, item long, doc_id long, score long, item_id long"
    spark.createDataFrame([], schema).write.parquet(path)
    for number, (names, found) in enumerate(_passes(items, id_col, text_col)):
        dfs = _frequencies(index, sorted({t for x in found for t in x}))
        told = _searched(index, Pass(found, n, total, dfs), names, k)
        told.select(F.lit(number).cast("long").alias("pass"), "item", "doc_id", "score", "item_id").write.mode("append").parquet(path)
    w = Window.partitionBy("pass", "item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = spark.read.schema(schema).parquet(path).withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op13_lexical(spark, sf_dir: str) -> DataFrame:
    """item_id, rank, doc_id, score: the 20 best of all ``documents`` for each ``benchmark`` item.

    Null texts have no terms and are in no result; an item without terms, or whose terms no document has, has no rows.
    """
    return search(build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


_SQL_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE = f"""
WITH d AS (SELECT doc_id, {_SQL_TERMS} AS w FROM documents),
s AS (SELECT count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
p AS (SELECT doc_id, any_value(len(w)) AS len, t, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS t FROM d) GROUP BY doc_id, t),
f AS (SELECT t, count(*) AS df FROM p GROUP BY t),
q AS (SELECT item_id, t, count(*) AS q FROM (SELECT item_id, unnest({_SQL_TERMS}) AS t FROM benchmark) GROUP BY ALL),
r AS (SELECT item_id, doc_id, CAST(sum(q * CAST(floor(1000 * ln((2 * n + 2) / (2 * df + 1))) AS BIGINT)
    * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * len * n) // l)))) AS BIGINT) AS score
  FROM q JOIN f USING (t) JOIN p USING (t) CROSS JOIN s GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r
WHERE score > 0 QUALIFY rank <= {TOP}"""
