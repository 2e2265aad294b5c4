"""Token ids in files of static range asymmetric numeral system (rANS) blocks.

One frequency table, counted over all ids of the corpus, serves every block. A block holds whole documents and codes
their ids on interleaved lanes that share one stream of 32-bit words; all lanes advance together, so a step is a few
numpy operations. Blocks decode independently, and checkpoints inside a block (the lanes' states and the place in the
stream) let parts of it decode in parallel. Payload and ids carry CRC-32 checksums.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import scratch, stored, table
from tidemark.llm.tokens import default_tokenizer, encoder, parts, squeeze, unsqueeze

#: Frequencies of a table sum to 2 ** PRECISION.
PRECISION = 18
LANES, BLOCK_IDS, CHECKPOINT_STEPS = 1024, 1 << 18, 128
#: How columns of compressed bytes are written.
_PLAIN = {"compression": "none", "parquet.enable.dictionary": "false"}
_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)


@dataclass
class Frequencies:
    """The shared table: symbols in ascending order, their frequencies, and where each one's range starts."""

    symbols: np.ndarray
    freq: np.ndarray

    @classmethod
    def of_counts(cls, symbols: np.ndarray, counts: np.ndarray) -> Frequencies:
        """Scale counts to the fixed sum, every symbol at least 1."""
        order = np.argsort(symbols)
        symbols, counts = symbols[order].astype(np.int64), counts[order].astype(float)
        if len(symbols) > 1 << PRECISION:
            raise ValueError(f"more than {1 << PRECISION} symbols")
        freq = np.maximum(1, np.floor(counts / max(counts.sum(), 1) * (1 << PRECISION))).astype(np.int64)
        over = int(freq.sum()) - (1 << PRECISION)
        for i in np.argsort(-freq, kind="stable"):
            if over <= 0:
                break
            take = min(over, int(freq[i]) - 1)
            freq[i] -= take
            over -= take
        if len(freq):
            freq[np.argmax(freq)] -= over
        return cls(symbols, freq)

    def __post_init__(self):
        self.start = np.cumsum(self.freq) - self.freq
        self.slot = np.repeat(np.arange(len(self.freq)), self.freq)
        self.f, self.c = self.freq.astype(np.uint64), self.start.astype(np.uint64)
        self.filler = int(np.argmax(self.freq)) if len(self.freq) else 0
        top = int(self.symbols[-1]) if len(self.symbols) else -1
        self.places = np.full(top + 1, -1, np.int32) if top < 1 << 22 else None  # of each id, where ids are small
        if self.places is not None:
            self.places[self.symbols] = np.arange(len(self.symbols))

    def place_of(self, ids: np.ndarray) -> np.ndarray:
        """The place of each id in the table; one that it doesn't have raises ValueError."""
        if self.places is not None and len(ids) and ids.max() < len(self.places):
            place = self.places[ids]
        else:
            place = np.searchsorted(self.symbols, ids)
            place[(place >= len(self.symbols)) | (self.symbols[np.minimum(place, len(self.symbols) - 1)] != ids)] = -1
        if (place < 0).any():
            raise ValueError("an id is not in the frequency table")
        return place


def encode_block(ids: np.ndarray, table_: Frequencies, lanes: int = LANES, every: int = CHECKPOINT_STEPS) -> dict:
    """payload, states, checkpoints and checksums of one block of at least one id."""
    n = len(ids)
    lanes = int(min(lanes, max(1, n // 64)))
    steps = -(-n // lanes)
    place = table_.place_of(ids)
    grid = np.full(steps * lanes, table_.filler)
    grid[:n] = place
    grid = grid.reshape(steps, lanes)
    x = np.full(lanes, _LOW)
    bits = np.uint64(PRECISION)
    words: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []
    for t in range(steps - 1, -1, -1):
        f, c = table_.f[grid[t]], table_.c[grid[t]]
        out = x >= f << np.uint64(63 - PRECISION)
        words.append(x[out].astype("<u4"))
        x = np.where(out, x >> _WORD, x)
        q = x // f
        x = (q << bits) + (x - q * f) + c
        if t and t % every == 0:
            marks.append((t, x.copy()))
    words.reverse()
    sizes = np.cumsum([0, *map(len, words)])
    marks.reverse()
    payload = np.concatenate(words).tobytes()
    return {
        "n": n,
        "lanes": lanes,
        "payload": payload,
        "states": x.astype("<u8").tobytes(),
        "marks": b"".join(
            np.array([t, sizes[t]], "<u8").tobytes() + s.astype("<u8").tobytes() for t, s in marks
        ),
        "payload_crc": zlib.crc32(payload),
        "ids_crc": zlib.crc32(ids.astype("<u4").tobytes()),
    }


def _decode_steps(words: np.ndarray, at: int, x: np.ndarray, steps: int, table_: Frequencies) -> np.ndarray:
    out = np.empty((steps, len(x)), np.int64)
    mask, bits = np.uint64((1 << PRECISION) - 1), np.uint64(PRECISION)
    for t in range(steps):
        low = x & mask
        s = table_.slot[low.astype(np.int64)]
        out[t] = s
        x = table_.f[s] * (x >> bits) + low - table_.c[s]
        need = np.flatnonzero(x < _LOW)
        if len(need):
            x[need] = x[need] << _WORD | words[at : at + len(need)]
            at += len(need)
    return out


def checkpoints(block: dict) -> list[tuple[int, int, np.ndarray]]:
    """(step, place in the stream, states) at which decoding can begin, the start of the block included."""
    lanes = block["lanes"]
    marks = np.frombuffer(block["marks"], "<u8").reshape(-1, 2 + lanes)
    first = (0, 0, np.frombuffer(block["states"], "<u8"))
    return [first, *((int(m[0]), int(m[1]), m[2:]) for m in marks)]


def decode_part(block: dict, part: int, table_: Frequencies) -> np.ndarray:
    """The ids between a checkpoint and the next one, without what lies before it."""
    points = checkpoints(block)
    lanes, n = block["lanes"], block["n"]
    step, at, states = points[part]
    end = points[part + 1][0] if part + 1 < len(points) else -(-n // lanes)
    words = np.frombuffer(block["payload"], "<u4").astype(np.uint64)
    places = _decode_steps(words, at, states.astype(np.uint64), end - step, table_).ravel()
    return table_.symbols[places[: max(0, n - step * lanes)]].astype("<u4")


def decode_block(block: dict, table_: Frequencies) -> np.ndarray:
    """All ids of a block; a damaged payload or wrong ids raise ValueError."""
    if zlib.crc32(block["payload"]) != block["payload_crc"]:
        raise ValueError("the checksum of a block's payload is wrong")
    words = np.frombuffer(block["payload"], "<u4").astype(np.uint64)
    states = np.frombuffer(block["states"], "<u8").astype(np.uint64)
    places = _decode_steps(words, 0, states, -(-block["n"] // block["lanes"]), table_).ravel()[: block["n"]]
    ids = table_.symbols[places].astype("<u4")
    if zlib.crc32(ids.tobytes()) != block["ids_crc"]:
        raise ValueError("the checksum of a block's ids is wrong")
    return ids


def _arrow(**columns) -> pa.RecordBatch:
    return pa.record_batch(list(columns.values()), names=list(columns))


def _encoded(docs: DataFrame, end_id: int, path: str, id_col: str, text_col: str) -> DataFrame:
    """doc_id, ids (squeezed), counts: a row per document, and one per task that says how often it met each id."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in parts(batches, 1):
            ids = [x + end for x in encoder(path).encode_rows(b.column(1))]
            got = np.bincount(np.frombuffer(b"".join(ids), "<u4"), minlength=len(total))
            got[: len(total)] += total
            total = got
            yield _arrow(doc_id=b.column(0), ids=pa.array(map(squeeze, ids), pa.binary()), counts=pa.nulls(len(ids), pa.binary()))
        seen = np.flatnonzero(total)
        told = np.stack([seen, total[seen]]).astype("<i8").tobytes()
        yield _arrow(doc_id=pa.nulls(1, pa.int64()), ids=pa.nulls(1, pa.binary()), counts=pa.array([told], pa.binary()))

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, "doc_id long, ids binary, counts binary")


def _counted(encoded: DataFrame) -> DataFrame:
    """id, n over all tasks; only the column of counts is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for told in b.column(0).to_pylist():
                ids, n = np.frombuffer(told, "<i8").reshape(2, -1)
                yield _arrow(id=pa.array(ids), n=pa.array(n))

    counts = encoded.where("counts is not null").select("counts")
    return counts.mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


BLOCK_SCHEMA = (
    "shard int, block int, at long, n long, lanes int, payload binary, states binary, marks binary, payload_crc long, "
    "ids_crc long, doc_ids array<long>, doc_lengths array<long>"
)


def write_token_files(
    docs: DataFrame, path: str, *, end_id: int = 2, tokenizer: str | None = None, id_col="doc_id", text_col="text"
) -> None:
    """Encode every whole text, append ``end_id``, and write path/blocks and path/frequencies.

    Documents are range-partitioned and sorted by id: a shard is a range, and shards follow each other in id order.
    The table of frequencies covers all ids; it has a row per distinct id, which the vocabulary bounds, so it is sent
    to all tasks. Null text is empty and still has its end id; null ids come first; rows with equal ids follow each
    other. No rows write no blocks.
    """
    spark = docs.sparkSession
    encoded = stored(_encoded(docs, end_id, tokenizer or default_tokenizer(), id_col, text_col), "token-ids", **_PLAIN)
    _counted(encoded).write.parquet(f"{path}/frequencies")
    ids = encoded.where("ids is not null").select("doc_id", "ids")
    freq = read_frequencies(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, no, at = TaskContext.get().partitionId(), 0, 0
        held: list[np.ndarray] = []
        doc_ids: list[int | None] = []

        def block() -> pa.RecordBatch:
            nonlocal no, at, held, doc_ids
            b = encode_block(np.concatenate(held).astype(np.int64), freq.value)
            row = {"shard": shard, "block": no, "at": at, **b, "doc_ids": doc_ids, "doc_lengths": [len(x) for x in held]}
            kinds = {"shard": pa.int32(), "block": pa.int32(), "lanes": pa.int32(), "doc_ids": pa.list_(pa.int64()), "doc_lengths": pa.list_(pa.int64())}
            kinds |= dict.fromkeys(("payload", "states", "marks"), pa.binary())
            no, at, held, doc_ids = no + 1, at + b["n"], [], []
            names = [c.split()[0] for c in BLOCK_SCHEMA.split(", ")]
            return _arrow(**{c: pa.array([row[c]], kinds.get(c, pa.int64())) for c in names})

        size = 0
        for b in batches:
            for d, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held.append(unsqueeze(x))
                doc_ids.append(d)
                size += len(held[-1])
                if size >= BLOCK_IDS:
                    yield block()
                    size = 0
        if held:
            yield block()

    freq = spark.sparkContext.broadcast(freq)
    order = ["doc_id", "row"]  # the row's number in the stored table parts the rows of an id that many have
    (
        ids.withColumn("row", F.monotonically_increasing_id())
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .drop("row")
        .mapInArrow(run, BLOCK_SCHEMA)
        .write.options(**_PLAIN)
        .parquet(f"{path}/blocks")
    )


def read_frequencies(spark: SparkSession, path: str) -> Frequencies:
    rows = spark.read.schema("id long, n long").parquet(f"{path}/frequencies").toArrow()
    return Frequencies.of_counts(rows.column("id").to_numpy(), rows.column("n").to_numpy())


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids (little-endian unsigned 32-bit), from the files."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    first, at = [], 0
    for r in blocks.groupBy("shard").agg(F.sum("n").alias("n")).orderBy("shard").collect():  # a row per partition
        first.append((r["shard"], at))
        at += r["n"]
    starts = F.broadcast(spark.createDataFrame(first, "shard int, first long"))
    freq = spark.sparkContext.broadcast(read_frequencies(spark, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                ids = decode_block(row, freq.value)
                sizes = np.array(row["doc_lengths"], np.int64)
                ends = np.cumsum(sizes)
                begins = ends - sizes
                pieces = [ids[s:e].tobytes() for s, e in zip(begins, ends)]
                yield _arrow(
                    doc_id=pa.array(row["doc_ids"], pa.int64()),
                    start=pa.array(row["first"] + row["at"] + begins, pa.int64()),
                    ids=pa.array(pieces, pa.binary()),
                )

    return blocks.join(starts, "shard").mapInArrow(run, "doc_id long, start long, ids binary")


def op5_token_files(spark, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from token files written and read back.

    Null text is empty and has its end id; null ids come first, rows of equal ids follow each other; no rows give none.
    """
    path = scratch(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path, end_id=2)
    return read_token_files(spark, path).select(
        "doc_id",
        "start",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )
