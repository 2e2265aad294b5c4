"""Line dedup by a deletion-neighbourhood join.

Two lines are near if one edit of a unit (replace, insert or delete) makes them equal. The units of a line of ten words and more
are its words, those of a shorter one its characters, of which it must have twenty; so an edit is a tenth of a line at most,
and still shorter lines are compared for equality only. A line's variants, itself and the line without each one of its
units, are joined as hashed keys; near lines share a variant. Of each set of lines that share one, every line meets the
earliest only, so a set costs as many rows as it has lines. The edit distance of what meets is verified on the units, and
lines with an earlier equal or near line go.

Lines that share neither their first nor their last units with another can't be near to any (an edit touches one half
only), so variants are made just for lines that share such an anchor.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from struct import unpack

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import split_join, stored, table
from tidemark.llm.tokens import parts

#: Fewest words of a line that is compared at all, of one for which an edit of a word is allowed, and fewest characters of one
#: with fewer words for which an edit of a character is allowed, unless told otherwise.
LEAST_WORDS, EDIT_WORDS, EDIT_CHARACTERS = 1, 10, 20
#: Added to the sizes of lines of characters, so that their keys and anchors aren't those of lines of words.
_CHARACTERS = 1 << 31
#: From here on are the places of rows without an id in the order of documents.
_NO_ID = 1 << 62
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def split_lines(text: str | None) -> list[tuple[str, list[bytes]]]:
    return [(line, line.encode().split()) for line in (text or "").split("\n")]


def line_hash(words: list[bytes]) -> tuple[int, int]:
    """128 bits of a line's words as two signed longs; white space between words doesn't count."""
    return unpack("<qq", xxhash.xxh3_128_digest(b" ".join(words)))


def units(words: list[bytes], bounds: tuple[int, int] = (EDIT_WORDS, EDIT_CHARACTERS)) -> tuple[list[bytes], int]:
    """What an edit replaces, inserts or deletes in a line, words or characters, and their salt; nothing if the line allows
    no edit. ``bounds``: the fewest words, and of lines with less the fewest characters, that allow one."""
    if len(words) >= bounds[0]:
        return words, 0
    line = b" ".join(words).decode()
    return ([c.encode() for c in line] if len(line) >= bounds[1] else []), _CHARACTERS


@functools.lru_cache(maxsize=4096)
def anchor_sizes(n: int, salt: int = 0) -> list[int]:
    """How many units the anchors of a line of n have; a line of n or n + 1 units has one size in common.

    A line of one or two characters may share no character with a near one; its anchor is empty.
    """
    half = lambda k: 1 << (k // 2).bit_length() >> 1
    return sorted({half(n), half(n - 1)} - (set() if salt else {0}))


def anchors(words: list[bytes], salt: int = 0) -> list[int]:
    """Hashes of a line's first units, then of its last ones; near lines have one in common, of the same side."""
    sizes, n = anchor_sizes(len(words), salt), len(words)
    parts = [(k, words[:k]) for k in sizes] + [(-k, words[n - k :]) for k in sizes]
    return [xxhash.xxh3_64_intdigest(b" ".join(w), (k & 0xFFFFFFFF) + (salt << 2)) - (1 << 63) for k, w in parts]


def variants(words: list[bytes], salt: int = 0) -> np.ndarray:
    """Keys of the line, then of the line without each unit; equal units in equal order have equal keys."""
    n = len(words)
    h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, n)
    terms = h * np.cumprod(np.full(n, _BASE))
    sums = np.cumsum(terms)
    shorter = sums - terms + (sums[-1] - sums) * _BACK
    keys = np.concatenate([sums[-1:], shorter])
    size = np.full(n + 1, n - 1 + salt, np.uint64)
    size[0] = n + salt
    return (keys * _BASE ^ size * _BACK).view(np.int64)


def within_one_edit(a: list[bytes], b: list[bytes]) -> bool:
    """Whether the edit distance between two lists of words is at most 1."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def _signed(values) -> pa.Array:
    return pa.array(values, pa.int64())


_LINES = "doc long, h1 long, h2 long, a0 long, a1 long, z0 long, z1 long"


def _lines(docs: DataFrame, least_words: int, bounds: tuple[int, int]) -> DataFrame:
    """doc, h1, h2 of each distinct line of each document, and its anchors: a of its start, z of its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, 1):
            rows: dict[tuple, list] = {}
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for _, w in split_lines(text):
                    if len(w) >= least_words and (k := (doc, *line_hash(w))) not in rows:
                        own, salt = units(w, bounds)
                        found = anchors(own, salt) if own else []  # else equality only
                        half = len(found) // 2
                        rows[k] = [x for side in (found[:half], found[half:]) for x in (*side, None, None)[:2]]
            columns = list(zip(*((*k, *v) for k, v in rows.items()))) if rows else [()] * 7
            yield pa.record_batch(list(map(_signed, columns)), names=[c.split()[0] for c in _LINES.split(", ")])

    return docs.mapInArrow(run, _LINES)


def _pick(docs: DataFrame, least_words: int) -> DataFrame:
    """doc, no, h1, h2, sides, line: of documents with a list ``__tm_wanted``, the first of each line of it.

    All columns of ``docs`` come in, though few are read, so that this and the last step share one shuffle of the texts.
    """
    names = docs.columns
    doc_at, text_at, wanted_at = (names.index(c) for c in ("__tm_doc", "__tm_text", "__tm_wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, text_at):
            rows: list[tuple] = []
            for doc, text, wanted in zip(*(b.column(i).to_pylist() for i in (doc_at, text_at, wanted_at))):
                sides: dict[int, int] = {}
                for x in wanted:
                    sides[x["h1"]] = sides.get(x["h1"], 0) | x["side"]
                for no, (_, w) in enumerate(split_lines(text)):
                    if len(w) >= least_words and sides:
                        h1, h2 = line_hash(w)
                        if side := sides.pop(h1, 0):
                            rows.append((doc, no, h1, h2, side, b" ".join(w).decode()))
            columns = list(zip(*rows)) if rows else [()] * 6
            yield pa.record_batch(
                [*map(_signed, columns[:5]), pa.array(columns[5], pa.string())],
                names=["doc", "no", "h1", "h2", "sides", "line"],
            )

    return docs.mapInArrow(run, "doc long, no long, h1 long, h2 long, sides long, line string")


def gaps(n: int, sides: int, salt: int = 0) -> np.ndarray:
    """Which units of a line of n an edit can touch: not those of an anchor shared with another line.

    1: an anchor at the start is shared, 2: one at the end. -1 stands for the whole line.
    """
    size = anchor_sizes(n, salt)[0]
    first, last = (size if sides == 1 else 0), (n - size if sides == 2 else n)
    return np.concatenate([[-1], np.arange(first, last)])


def _neighbourhood(lines: DataFrame, bounds: tuple[int, int]) -> DataFrame:
    """key, gap (the place of the unit left out; -1: none), doc, no."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, nos, sides = (b.column(i).to_numpy() for i in range(3))
            for i in range(0, b.num_rows, 500):
                keys, places = [], []
                for x, side in zip(b.column(3).slice(i, 500).to_pylist(), sides[i : i + 500].tolist()):
                    own, salt = units(x.encode().split(), bounds)
                    all_keys = variants(own, salt)
                    places.append(gaps(len(own), side, salt))
                    keys.append(all_keys[places[-1] + 1])
                sizes = [len(k) for k in keys]
                yield pa.record_batch(
                    [
                        pa.array(np.concatenate(keys)),
                        pa.array(np.concatenate(places).astype(np.int32)),
                        pa.array(np.repeat(docs[i : i + 500], sizes)),
                        pa.array(np.repeat(nos[i : i + 500], sizes).astype(np.int32)),
                    ],
                    names=["key", "gap", "doc", "no"],
                )

    return lines.select("doc", "no", "sides", "line").mapInArrow(run, "key long, gap int, doc long, no int")


def _verified(pairs: DataFrame, bounds: tuple[int, int]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                (x, kind), (y, other) = (units(line.encode().split(), bounds) for line in (x, y))
                near.append(kind == other and within_one_edit(x, y))
            keep = pa.array(near, pa.bool_())
            yield pa.record_batch([b.column(0).filter(keep), b.column(1).filter(keep)], names=["h1", "h2"])

    return pairs.mapInArrow(run, "h1 long, h2 long")


def _wanted(distinct: DataFrame) -> DataFrame:
    """__tm_doc, wanted: of each document the lines that share an anchor with another line, with the anchor's side."""
    side = lambda c, n: F.struct(F.col(c).alias("anchor"), F.lit(n).alias("side"))
    posts = (
        distinct.where("a0 is not null")
        .select("h1", "doc", F.explode(F.array(side("a0", 1), side("a1", 1), side("z0", 2), side("z1", 2))).alias("x"))
        .select("h1", "doc", "x.anchor", "x.side")
        .where("anchor is not null")
    )
    shared = posts.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    found = split_join(posts, shared, "anchor").groupBy("doc").agg(F.collect_set(F.struct("h1", "side")).alias("__tm_wanted"))
    return found.withColumnRenamed("doc", "__tm_doc")


def near_lines(lines: DataFrame, bounds: tuple[int, int] = (EDIT_WORDS, EDIT_CHARACTERS)) -> DataFrame:
    """h1, h2 of the distinct lines (doc, no, h1, h2, sides, line) that have an earlier near line.

    Lines that differ in one unit share the variant that leaves it out at the same place; any two in such a set are
    near. A line with a unit more shares the variant that leaves it out with the shorter line itself. So the earliest
    line with the same gap, the whole line, and the earliest line with any gap are all that a line has to meet.
    """
    rows = _neighbourhood(lines, bounds)
    at = F.struct("doc", "no")
    by_gap = rows.groupBy("key", "gap").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n"))
    whole = F.col("gap") == -1
    by_key = (
        by_gap.groupBy("key")
        .agg(
            F.min(F.when(whole, F.col("first"))).alias("whole"),
            F.min(F.when(~whole, F.col("first"))).alias("cut"),
            F.collect_list(F.when(F.col("n") > 1, F.struct("gap", "first"))).alias("gaps"),
        )
        .where("size(gaps) > 0 or (whole is not null and cut is not null)")
    )
    met = split_join(rows, by_key, "key").withColumn("at", at)
    partners = F.concat(
        F.transform(F.filter("gaps", lambda x: x["gap"] == F.col("gap")), lambda x: x["first"]),
        F.array(F.when(whole, F.col("cut")).otherwise(F.col("whole"))),
    )
    pairs = met.select("at", F.explode(partners).alias("first")).where("first < at").distinct()
    own = lines.select(at.alias("at"), "h1", "h2", F.col("line").alias("a"))
    early = lines.select(at.alias("first"), F.col("line").alias("b"))
    typed = pairs.select(*(F.struct(F.col(c)["doc"].alias("doc"), F.col(c)["no"].cast("long").alias("no")).alias(c) for c in ("at", "first")))
    return _verified(typed.join(own, "at").join(early, "first").select("h1", "h2", "a", "b"), bounds).distinct()


def _key(column: str = "__tm_doc") -> Column:
    """A document's place in another spelling: joins on it have shuffles of their own on both sides, which may be split, and
    the texts' shuffle serves both joins."""
    return F.col(column).bitwiseXOR(F.lit(0x5DEECE66D))


def dedup_lines(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    kept: str = "__kept",
    dropped: str = "__lines_dropped",
    least_words: int = LEAST_WORDS,
    edit_words: int = EDIT_WORDS,
    edit_characters: int = EDIT_CHARACTERS,
) -> DataFrame:
    """The rows of ``docs`` with two more columns, ``kept`` (text of the lines that stay) and the number ``dropped``.

    A line goes if an equal one stands earlier in the order of (id, line), or if its first occurrence has an
    earlier near line. Equal means the same words, white space aside. Near lines differ by one edit: both of ``edit_words``
    words or more by one word, both of less, but at least ``edit_characters`` characters, by one character; shorter ones are
    compared for equality only, and lines of under ``least_words`` (1: blank ones) always stay. The line that makes
    another go may itself have gone for a still earlier one. Null text is empty and stays null if nothing goes. Rows with a null id come last, in
    the order of a hash of their texts. Rows that share an id, or a null id and the text, count as one document: their equal
    lines stay in each of them. No rows give no rows. Extra columns come back; one whose name begins
    with __tm_ raises.
    Lines of any length are compared whole; the work for a line grows in proportion to its units.
    """
    if own := [c for c in docs.columns if c.startswith("__tm_")]:
        raise ValueError(f"columns {', '.join(own)} have names of this operator")
    bounds = edit_words, edit_characters
    place = F.lit(_NO_ID).bitwiseOR(F.shiftrightunsigned(F.xxhash64(text_col), 2))  # rows without an id: by their text
    base = docs.withColumns({"__tm_doc": F.coalesce(F.col(id_col).cast("long"), place), "__tm_text": F.col(text_col)})
    base = base.drop(text_col).withColumn("__tm_key", _key())
    lines = stored(_lines(base.select("__tm_doc", "__tm_text"), least_words, bounds), "lines")
    distinct = lines.groupBy("h1", "h2", "a0", "a1", "z0", "z1").agg(F.min("doc").alias("doc"), F.count(F.lit(1)).alias("n"))
    distinct = stored(distinct, "distinct-lines")
    wanted = stored(_wanted(distinct), "wanted-lines").select(_key().alias("__tm_key"), "__tm_wanted")
    # merged whatever the size: with a few lines less this would be a broadcast, and what is written would grow faster than the input
    picked = stored(_pick(base.join(wanted.hint("merge"), "__tm_key"), least_words), "picked-lines", compression="zstd")
    near = near_lines(picked, bounds)
    again = distinct.where("n > 1").select("h1", "h2", F.col("doc").alias("first"))
    marked = again.union(near.select("h1", "h2", F.lit(None).cast("long")))
    gone = (
        lines.select("doc", "h1", "h2")
        .join(marked, ["h1", "h2"])  # a frequent line's key is one that adaptive execution splits
        .where("first is null or doc <> first")
        .groupBy("doc")
        .agg(F.collect_set(F.struct("h1", "h2")).alias("__tm_gone"))
        .select(_key("doc").alias("__tm_key"), "__tm_gone")
    )
    return _without(base.join(gone.hint("merge"), "__tm_key", "left"), text_col, docs.columns, kept, dropped, least_words)


def _without(
    rows: DataFrame, text_col: str, columns: list[str], kept_name: str, dropped_name: str, least_words: int
) -> DataFrame:
    names, kinds = rows.columns, dict(rows.dtypes)
    read = [names.index("__tm_text" if c == text_col else c) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last = names.index("__tm_text"), names.index("__tm_gone")
        for b in parts(batches, at):
            kept, dropped = [], []
            for text, gone in zip(b.column(at).to_pylist(), b.column(last).to_pylist()):
                gone, seen, out = {(x["h1"], x["h2"]) for x in gone or ()}, set(), []
                found = split_lines(text)
                for line, w in found:
                    if len(w) >= least_words:
                        h = line_hash(w)
                        if h in gone or h in seen:
                            continue
                        seen.add(h)
                    out.append(line)
                dropped.append(len(found) - len(out))
                kept.append(text if not dropped[-1] else "\n".join(out))
            yield pa.record_batch(
                [*(b.column(i) for i in read), pa.array(kept, pa.string()), _signed(dropped)],
                names=[*columns, kept_name, dropped_name],
            )

    schema = ", ".join(f"`{c}` {kinds['__tm_text' if c == text_col else c]}" for c in columns)
    return rows.mapInArrow(run, f"{schema}, `{kept_name}` string, `{dropped_name}` long")


def keep_new_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with what stays of their texts; those of which nothing but white space stays go."""
    names = docs.columns
    done = dedup_lines(docs, id_col=id_col, text_col=text_col, kept="__tm_kept", dropped="__tm_dropped")
    left = done.where("__tm_dropped = 0 or length(trim(BOTH ' \t\r\n' FROM __tm_kept)) > 0")
    return left.select(*(F.col("__tm_kept").alias(c) if c == text_col else F.col(c) for c in names))


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 (of the lines that stay) of every document.

    Null text is one empty line; null and repeated ids are as dedup_lines has them; an empty table has no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = F.coalesce("__kept", F.lit(""))
    return dedup_lines(docs).select(
        "doc_id",
        F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long").alias("n_lines"),
        F.col("__lines_dropped").alias("n_dropped"),
        F.sha2(kept, 256).alias("kept_sha256"),
    )
