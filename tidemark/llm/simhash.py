"""SimHash near-dedup on a byte-position inverted index with count filtering.

A fingerprint is a row of bytes. Fingerprints within ``bits`` differing bits share at least ``width - bits`` of their
``width`` positional bytes: that is the guaranteed minimum. Postings are kept for combinations of positional bytes, so
chosen that every pair with the guaranteed minimum meets in at least one; single bytes would put 1/256 of all rows into
each posting and make their pairs grow with the square of the input. Where a pair meets, its shared positional
bytes are tallied, pairs below the minimum go, and the rest are verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import split_join, stored, table
from tidemark.llm.components import components
from tidemark.llm.tokens import parts

#: Most fingerprints of a posting that are compared as one block; larger postings are compared block by block.
BLOCK = 1024

_BIT_OF_BYTE = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_LANES = np.arange(8) * 256


def shingles(text: str, words: int) -> list[bytes]:
    """Shingles of words split at ASCII white space, A-Z lower-cased; a shorter text is one shingle; no word, none."""
    w = text.encode().lower().split()
    if len(w) < words:
        return [b" ".join(w)] if w else []
    return list(map(b" ".join, zip(*(w[i:] for i in range(words)))))


def hashes(text: str, words: int) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    found = shingles(text, words)
    return np.fromiter((digest(s, 42) for s in found), np.uint64, len(found))


def fingerprint(h: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of the 64-bit hashes; no hash gives 0."""
    if not len(h):
        return 0
    lanes = (h.astype("<u8").view(np.uint8).reshape(-1, 8) + _LANES).ravel()
    ones = (np.bincount(lanes, minlength=2048).reshape(8, 256) @ _BIT_OF_BYTE).ravel()
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every whole text; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, 1):
            fp = np.array([fingerprint(hashes(x or "", words)) for x in b.column(1).to_pylist()], np.uint64)
            yield pa.record_batch([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, fp long"
    )


def covering(least: int) -> list[tuple[int, ...]]:
    """Combinations of positional bytes (of 8) of which any ``least`` positions hold at least one.

    From 5 on these are the 14 planes of the affine space of 3 bits, the positions whose numbers cancel out under
    exclusive or: the three positions outside five lie in one plane, whose complement is a plane too and lies in the five.
    Below 5 all combinations of ``least`` positions are taken.
    """
    if least < 5:
        return list(combinations(range(8), least))
    return [c for c in combinations(range(8), 4) if c[0] ^ c[1] ^ c[2] ^ c[3] == 0]


def postings(fps: DataFrame, combos: list[tuple[int, ...]]) -> DataFrame:
    """key, fp: a row for each combination of positional bytes (position 0 is the lowest byte)."""

    def key(no: int, c: tuple[int, ...]):
        byte = [F.shiftrightunsigned(F.col("fp"), 8 * p).bitwiseAND(F.lit(255)) for p in c]
        value = F.lit(no)
        for x in byte:
            value = F.shiftleft(value.cast("long"), 8).bitwiseOR(x)
        return value

    return fps.select(F.explode(F.array(*(key(i, c) for i, c in enumerate(combos)))).alias("key"), "fp")


def blocks(posts: DataFrame, key: str, member: str, most: int | None = None) -> DataFrame:
    """The rows of keys that have two at least, with ``part``: within a (key, part) all rows may be compared.

    A key of up to ``most`` (BLOCK) rows has one part. The rows of a larger key are dealt into blocks, and each pair of blocks is a
    part, so every pair still meets and no part holds more than about two blocks. Counts are summed before the
    shuffle; the join with them is one that adaptive execution splits.
    """
    sizes = posts.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    n_blocks = F.ceil(F.col("n") / (most or BLOCK))
    own = F.pmod(F.xxhash64(member), F.col("blocks"))
    other = F.col("other")
    return (
        split_join(posts, sizes, key)
        .withColumn("blocks", n_blocks)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .withColumn("part", F.least("own", other) * F.col("blocks") + F.greatest("own", other))
        .drop("n", "blocks", "own", "other")
    )


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole runs of equal keys from sorted batches, each as a table; only the open run is held."""
    held: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b])
        if held is not None:
            t = pa.concat_tables([held, t]).combine_chunks()
        if not t.num_rows:
            continue
        k = [t.column(c).to_numpy() for c in keys]
        cut = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in k])) + 1
        ends = [0, *cut.tolist()]
        for start, end in zip(ends, ends[1:]):
            yield t.slice(start, end - start)
        held = t.slice(ends[-1])
    if held is not None and held.num_rows:
        yield held


def linked(fp: np.ndarray, bits: int, least: int) -> list[tuple[int, int]]:
    """Index pairs that connect all fingerprints within ``bits`` of each other: at most one pair a fingerprint."""
    rest, found = np.arange(1, len(fp)), []
    open_ = [0]
    while len(rest):
        if not open_:
            open_, rest = [int(rest[0])], rest[1:]
            continue
        at = open_.pop()
        x = fp[rest] ^ fp[at]
        tally = (x.view(np.uint8).reshape(-1, 8) == 0).sum(1)
        near = (tally >= least) & (np.bitwise_count(x) <= bits)
        if near.any():
            found += [(at, int(j)) for j in rest[near]]
            open_ += rest[near].tolist()
            rest = rest[~near]
    return found


def near_fingerprints(fps: DataFrame, bits: int = 3) -> DataFrame:
    """a, b: links between fingerprints (column fp, each once) that connect all pairs within ``bits`` differing bits."""
    least = 8 - bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for t in runs(batches, ["key", "part"]):
            fp = t.column("fp").to_numpy().view(np.uint64)
            for i, j in linked(fp, bits, least):
                a.append(fp[i])
                b.append(fp[j])
            if len(a) > 50_000:
                yield _pairs(a, b)
                a, b = [], []
        yield _pairs(a, b)

    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    posts = postings(fps.select("fp").repartition(parts, "fp"), covering(least))
    return (
        blocks(posts, "key", "fp")
        .repartition("key", "part")
        .sortWithinPartitions("key", "part", "fp")
        .mapInArrow(run, "a long, b long")
    )


def _pairs(a: list, b: list) -> pa.RecordBatch:
    return pa.record_batch(
        [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, b)], names=["a", "b"]
    )


def simhash_groups(
    docs: DataFrame, *, words: int = 3, bits: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, fingerprint, component_id for every document.

    Documents link where their fingerprints differ in at most ``bits`` (0 to 4) bits; component_id is the smallest
    doc_id reachable. Documents without a word have fingerprint zero and link like any other. Null text counts as
    empty. A null doc_id gets a component but is never its smallest unless it has no other member. Repeated rows stay
    repeated. An empty table gives an empty result. Other columns are not read.

    Equal fingerprints are grouped before anything is compared, so copies cost one row.
    """
    fps = stored(fingerprints(docs, words, id_col, text_col), "fingerprints")
    classes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    comps = components(near_fingerprints(classes, bits), "a", "b")
    first = (
        classes.join(comps, classes["fp"] == comps["node"], "left")
        .select("fp", "first", F.coalesce("component", "fp").alias("root"))
    )
    least = first.groupBy("root").agg(F.min("first").alias("component_id"))
    of_class = split_join(first, least, "root").select("fp", "component_id")
    return fps.join(of_class, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every document.

    Null and empty texts have the fingerprint zero and are linked like others; null ids are kept, repeated rows stay repeated, an
    empty table has no rows. Other columns aren't read.
    """
    return simhash_groups(table(spark, sf_dir, "documents"))
