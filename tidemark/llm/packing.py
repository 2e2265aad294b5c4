"""Packing of examples into fixed-length sequences: vector bin packing by the dot-product heuristic.

An example demands tokens, one segment, and loss-bearing tokens (the last ones of it, as in a prompt with its answer). A
sequence limits all three at once. One sequence is open at a time; of the examples that fit, the one whose
demand has the largest dot product with what the sequence has left goes in, each dimension weighted by its mean demand.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import table
from tidemark.llm.tokens import default_tokenizer, encoder, parts

#: Examples, and tokens, that a task packs together.
POOL_EXAMPLES, POOL_TOKENS = 1024, 2_000_000


@dataclass(frozen=True)
class Limits:
    tokens: int = 1024
    segments: int = 64
    loss: int = 1024


def _most(length: int, loss: int, tokens: int, loss_left: int) -> int:
    """The longest start of an example, of whose tokens the last ``loss`` bear loss, that both limits admit."""
    return min(length, tokens, length - loss + loss_left)


def pack(lengths: np.ndarray, losses: np.ndarray, limits: Limits, cut: bool = True) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (example, start, length). With ``cut`` examples may be cut anywhere.

    Without it an example beyond a limit raises ValueError. Every token lies in exactly one piece.
    """
    full: list[list[tuple[int, int, int]]] = []
    start = np.zeros(len(lengths), np.int64)
    left, bear = lengths.astype(np.int64).copy(), losses.astype(np.int64).copy()
    for i in np.flatnonzero((left > limits.tokens) | (bear > limits.loss)):
        if not cut:
            raise ValueError(f"example {i} is beyond the limits and may not be cut")
        while left[i] > limits.tokens or bear[i] > limits.loss:
            n = _most(int(left[i]), int(bear[i]), limits.tokens, limits.loss)
            full.append([(int(i), int(start[i]), n)])
            start[i] += n
            left[i] -= n
            bear[i] = min(bear[i], left[i])
    most = np.array([limits.tokens, limits.segments, limits.loss], float)
    need = np.stack([left, np.ones_like(left), bear]) / most[:, None]
    weight = need.mean(axis=1) if need.size else np.ones(3)
    alive = left > 0
    count = int(alive.sum())
    while count:
        room, here = most.copy(), []
        while count and room[0] >= 1 and room[1] >= 1:
            fits = alive & (left <= room[0]) & (bear <= room[2])
            last = cut and room[1] == 1
            if last:
                fits &= left == room[0]
            if fits.any():
                score = np.where(fits, (weight * room / most) @ need, -1.0)
                i = int(score.argmax())
                n = int(left[i])
            elif cut:
                i = int(np.where(alive, left, 0).argmax())
                n = _most(int(left[i]), int(bear[i]), int(room[0]), int(room[2]))
                if n < 1:
                    break
            else:
                break
            here.append((i, int(start[i]), n))
            after = min(int(bear[i]), int(left[i]) - n)
            room -= (n, 1, int(bear[i]) - after)
            start[i] += n
            left[i] -= n
            bear[i] = after
            need[:, i] = np.array([left[i], 1, after]) / most
            if not left[i]:
                alive[i] = False
                count -= 1
        full.append(here)
    return full


def by_powers(sequence: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """A sequence cut into sequences whose lengths are powers of two, largest first: they need no padding."""
    total, out, queue = sum(n for *_, n in sequence), [], list(sequence)
    for bit in reversed(range(total.bit_length())):
        if not total >> bit & 1:
            continue
        room, here = 1 << bit, []
        while room:
            i, s, n = queue.pop(0)
            take = min(n, room)
            here.append((i, s, take))
            room -= take
            if take < n:
                queue.insert(0, (i, s + take, n - take))
        out.append(here)
    return out


def pack_documents(
    docs: DataFrame,
    *,
    limits: Limits = Limits(),
    end_id: int = 0,
    tokenizer: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    prompt_col: str | None = None,
) -> DataFrame:
    """A row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    Each whole text becomes its ids and ``end_id``. ``prompt_col`` names a text before it whose ids bear no
    loss; without it all ids bear loss. Each task packs its own partition in pools of POOL_EXAMPLES examples, with
    no shuffle. A sequence that stays short of the token limit, as the last of a pool or one that another limit closes, is
    cut into powers of two, which need no padding. sequence_id is the task's partition and a running number. Null text is empty and still gives
    its end id. Null and repeated doc_ids are packed like others, each row on its own. No rows give no rows.
    """
    path = tokenizer or default_tokenizer()
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def rows(pool: list[tuple[object, bytes, int]], first: int) -> tuple[pa.RecordBatch, int]:
        lengths = np.array([len(x) // 4 for _, x, _ in pool])
        sequences = pack(lengths, lengths - np.array([p for *_, p in pool]), limits)
        sequences = [y for x in sequences for y in ([x] if sum(n for *_, n in x) == limits.tokens else by_powers(x))]
        columns: list[list] = [[] for _ in names]
        for no, seq in enumerate(sequences, first):
            at = 0
            for i, s, n in seq:
                doc_id, ids, _ = pool[i]
                for c, v in zip(columns, (doc_id, s, n, ids[4 * s : 4 * (s + n)], len(ids) // 4, no, at)):
                    c.append(v)
                at += n
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=names), first + len(sequences)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no, pool, tokens = TaskContext.get().partitionId() << 36, [], 0
        for b in parts(batches, 1):
            prompts = encoder(path).encode_rows(b.column(2)) if prompt_col else repeat(b"")
            for d, p, x in zip(b.column(0).to_pylist(), prompts, encoder(path).encode_rows(b.column(1))):
                pool.append((d, p + x + end, len(p) // 4))
                tokens += len(pool[-1][1]) // 4
                if len(pool) >= POOL_EXAMPLES or tokens >= POOL_TOKENS:
                    out, no = rows(pool, no)
                    yield out
                    pool, tokens = [], 0
        if pool:
            yield rows(pool, no)[0]

    columns = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")]
    if prompt_col:
        columns.append(F.col(prompt_col).alias("prompt"))
    return docs.select(*columns).mapInArrow(
        run,
        "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long",
    )


def op8_packing(spark, sf_dir: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece of every document.

    Null text is its end id only; null and repeated ids are packed like others; an empty table has no pieces.
    """
    return pack_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
