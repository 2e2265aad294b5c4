"""Chat formatting as a prefix tree of turns.

Conversations that share initial turns share nodes: a node is a turn after certain turns before it, known by a 128-bit hash
of all of them. Each node is formatted and encoded once. Nodes are laid out in one sequence, depth first, with the position at
which a node's tokens begin in its conversations and the intervals of its ancestors, which are what its tokens attend to
beside those before them in the node.

A conversation is a unit of work (its digest is sequential), so its turns must fit a task; a node, a tree and copies of a
conversation may be as frequent as they like.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import split_join, stored, table
from tidemark.llm.tokens import byte_alphabet, default_tokenizer, encoder, gather, parts

ASSISTANT = "assistant"
#: Control strings before and after a text, by role; turns of other roles name theirs between the first two of OTHER.
MARKS = {"user": ("[INST]", "[/INST]"), "system": ("[SYS]", "[/SYS]"), ASSISTANT: ("<s>", "</s>")}
OTHER = ("[ROLE]", "[TEXT]", "[/ROLE]")

#: A control string's first character stands nowhere else in one, so none can begin within another or across a text's end. In
#: texts a backslash more follows that character wherever only backslashes stand between it and the rest.
_CONTROLS = [c for pair in MARKS.values() for c in pair] + list(OTHER)
_RESTS = "|".join(re.escape(c[1:]) for c in _CONTROLS)
_PLAIN = re.compile(rf"([\[<])(\\*(?:{_RESTS}))")
_ESCAPED = re.compile(rf"([\[<])\\(\\*(?:{_RESTS}))")
_TURN = re.compile(
    "|".join(f"{re.escape(a)}(?P<{role}>.*?){re.escape(b)}" for role, (a, b) in MARKS.items())
    + f"|{re.escape(OTHER[0])}(?P<name>.*?){re.escape(OTHER[1])}(?P<other>.*?){re.escape(OTHER[2])}",
    re.DOTALL,
)
#: Bytes of a node's hash.
_WIDTH = 16


def escape(text: str) -> str:
    return _PLAIN.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def marked(role: str, text: str) -> tuple[str, str, str]:
    """A turn's formatted form in three parts: what stands before the text, the text, what stands after it."""
    if role in MARKS:
        return MARKS[role][0], escape(text), MARKS[role][1]
    return OTHER[0] + escape(role) + OTHER[1], escape(text), OTHER[2]


def turns_of(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) pairs of formatted turns; raises where anything else stands."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn begins at character {at}")
        at = m.end()
        role = m.lastgroup if m.lastgroup != "other" else unescape(m["name"])
        out.append((role, unescape(m[m.lastgroup])))
    return out


@dataclass
class Forest:
    """``nodes``: start (place of a node's first token in the sequence), ids (little-endian unsigned 32-bit tokens), position (of
    the first token in its conversations), ancestors (intervals [from, to) of the sequence, from the root on), loss_from and
    loss_to (the tokens of the node that count for the loss). ``conversations``: conv_id and the start of its last turn."""

    nodes: DataFrame
    conversations: DataFrame


def _chained(turns: DataFrame) -> DataFrame:
    """conv_id, node, role, text of each turn, and a row with path (the nodes' hashes joined) for each conversation.

    Partitions are read in order of conversation and turn, so a task holds the path of one conversation.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, path = None, None
        for b in parts(batches, 2):
            out = []
            for i, role, text in zip(*(c.to_pylist() for c in b.columns)):
                if path is None or i != conv:
                    if path is not None:
                        out.append((conv, None, None, None, bytes(path)))
                    conv, path = i, bytearray()
                key = role.encode()
                node = hashlib.blake2b(bytes(path[-_WIDTH:]) + len(key).to_bytes(8, "little") + key + text.encode(), digest_size=_WIDTH)
                path += node.digest()
                out.append((i, node.digest(), role, text, None))
            yield _rows(out, names, kinds)
        if path is not None:
            yield _rows([(conv, None, None, None, bytes(path))], names, kinds)

    names, kinds = ["conv_id", "node", "role", "text", "path"], [pa.int64(), pa.binary(), pa.string(), pa.string(), pa.binary()]
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return ordered.mapInArrow(run, "conv_id long, node binary, role string, text string, path binary")


def _rows(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def _encoded(nodes: DataFrame, tokenizer: str) -> DataFrame:
    """node, ids, n, loss_from, loss_to: before, text and after are encoded apart, so that the loss covers whole tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, 2):
            turns = list(zip(b.column(1).to_pylist(), b.column(2).to_pylist()))
            pieces = list(encoder(tokenizer).encode([p for role, text in turns for p in marked(role, text)]))
            out = []
            for k, (node, (role, _)) in enumerate(zip(b.column(0).to_pylist(), turns)):
                before, text, after = pieces[3 * k : 3 * k + 3]
                begin = len(before) // 4
                n = (len(before) + len(text) + len(after)) // 4
                out.append((node, before + text + after, n, begin, begin + (len(text) // 4 if role == ASSISTANT else 0)))
            yield _rows(out, ["node", "ids", "n", "loss_from", "loss_to"], [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()])

    return nodes.select("node", "role", "text").mapInArrow(run, "node binary, ids binary, n long, loss_from long, loss_to long")


def _placed(owners: DataFrame, sizes: DataFrame) -> DataFrame:
    """node, owner, start, n: where each node's tokens stand when nodes are ordered by (owner, depth).

    Sums run within the range partitions that the owners' numbers tell; a row for each of these carries over.
    """
    rows = owners.join(sizes, "node").withColumn("__part", F.shiftright("owner", 33))
    before = Window.partitionBy("__part").orderBy("owner", "depth").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("__part").agg(F.sum("n").alias("n"))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range partition
    shifts = totals.select("__part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__shift"))
    return rows.withColumn("__at", F.coalesce(F.sum("n").over(before), F.lit(0))).join(shifts, "__part").select(
        "node", "owner", (F.col("__at") + F.col("__shift")).alias("start"), "n"
    )


def format_chats(conversations: DataFrame, *, tokenizer: str | None = None) -> Forest:
    """The forest of a table of turns (conv_id, turn, role, text), stored.

    Turns are ordered by turn, equal ones by role and text; repeated rows are repeated turns. Null roles and texts are
    empty, rows with a null conv_id are one conversation. No rows give empty tables. Other columns aren't read.

    Conversations are sorted by the hashes of their nodes, a copy once; a node belongs to the first one that has it, and what
    a conversation owns follows what it shares. So the sequence is depth first, and no tree is gathered in a task.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    turns = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), text("role"), text("text"))
    chained = stored(_chained(turns), "chat-turns")
    texts = chained.where("node is not null").groupBy("node").agg(F.first("role").alias("role"), F.first("text").alias("text"))
    encoded = stored(_encoded(texts, tokenizer or default_tokenizer()), "chat-nodes")
    paths = chained.where("path is not null").select("conv_id", "path")
    ordered = paths.groupBy("path").agg(F.count(F.lit(1)).alias("copies")).repartitionByRange("path").sortWithinPartitions("path")
    ordered = stored(ordered.select(F.monotonically_increasing_id().alias("rank"), "path"), "chat-paths")
    steps = F.sequence(F.lit(0), (F.length("path") / _WIDTH - 1).cast("int"))
    on_path = ordered.select("rank", F.posexplode(F.transform(steps, lambda j: F.expr("path").substr(j * _WIDTH + 1, F.lit(_WIDTH)))).alias("depth", "node"))
    owners = on_path.groupBy("node").agg(F.min("rank").alias("owner"), F.min("depth").alias("depth"))
    placed = stored(_placed(owners.select("node", "owner", "depth"), encoded.select("node", "n")), "chat-places")
    spans = split_join(on_path, placed, "node").groupBy("rank").agg(F.sort_array(F.collect_list(F.struct("depth", "node", "owner", "start", "n"))).alias("spans"))
    own = spans.select("rank", F.posexplode("spans").alias("depth", "s"), "spans").where("s.owner = rank").select(
        F.col("s.node").alias("node"),
        F.col("s.start").alias("start"),
        F.transform(F.slice("spans", F.lit(1), F.col("depth")), lambda s: F.struct(s["start"].alias("from"), (s["start"] + s["n"]).alias("to"))).alias("ancestors"),
    )
    position = F.aggregate("ancestors", F.lit(0).cast("long"), lambda s, x: s + x["to"] - x["from"])
    nodes = encoded.join(own, "node").select("start", "ids", position.alias("position"), "ancestors", "loss_from", "loss_to")
    leaf = F.expr(f"substring(path, -{_WIDTH}, {_WIDTH})").alias("node")
    last = split_join(paths.select("conv_id", leaf), placed, "node")
    return Forest(
        stored(nodes.repartitionByRange("start").sortWithinPartitions("start"), "chat-sequence"),
        stored(last.select("conv_id", F.col("start").alias("last")), "chat-ends"),
    )


class Decoder:
    """Bytes of token ids."""

    def __init__(self, tokenizer: str):
        library = encoder(tokenizer).library
        back = {c: b for b, c in byte_alphabet().items()}
        special = {i: t.content.encode() for i, t in library.get_added_tokens_decoder().items()}
        names = [library.id_to_token(i) or "" for i in range(library.get_vocab_size())]
        found = [special[i] if i in special else bytes(back[c] for c in name) for i, name in enumerate(names)]
        self.bytes = np.frombuffer(b"".join(found), np.uint8)
        self.sizes = np.fromiter(map(len, found), np.int64, len(found))

    def text(self, ids: np.ndarray) -> str:
        return gather(self.bytes, self.sizes, ids)[0].tobytes().decode()


@functools.lru_cache(maxsize=1)
def decoder(tokenizer: str) -> Decoder:
    return Decoder(tokenizer)


def read_chats(forest: Forest, *, tokenizer: str | None = None) -> DataFrame:
    """last, formatted, loss: the formatted text of each distinct conversation, and what of it is under the loss mask,
    unescaped, read by the intervals of its last turn."""
    path = tokenizer or default_tokenizer()
    ends = forest.conversations.select("last").distinct()
    begins = F.concat(F.transform("ancestors", lambda x: x["from"]), F.array("start"))
    wanted = ends.join(forest.nodes.select(F.col("start").alias("last"), begins.alias("begins")), "last").select("last", F.posexplode("begins").alias("depth", "start"))
    pieces = split_join(wanted, forest.nodes.select("start", "ids", "loss_from", "loss_to"), "start")
    whole = pieces.groupBy("last").agg(F.sort_array(F.collect_list(F.struct("depth", "ids", "loss_from", "loss_to"))).alias("pieces"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(len(b)):
                texts, loss = [], []
                for p in b.column(1)[k].as_py():
                    ids = np.frombuffer(p["ids"], "<u4")
                    texts.append(decoder(path).text(ids))
                    if p["loss_to"] > p["loss_from"]:
                        loss.append(unescape(decoder(path).text(ids[p["loss_from"] : p["loss_to"]])))
                yield _rows([(b.column(0)[k].as_py(), "".join(texts), "".join(loss))], ["last", "formatted", "loss"], [pa.int64(), pa.string(), pa.string()])

    return whole.mapInArrow(run, "last long, formatted string, loss string")


def _told(read: DataFrame) -> DataFrame:
    """last, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of what was read."""
    names = ["last", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, 1):
            out = []
            for last, formatted, loss in zip(*(c.to_pylist() for c in b.columns)):
                turns = turns_of(formatted)
                digest = hashlib.sha256("".join(f"{role}\n{text}\n" for role, text in turns).encode()).hexdigest()
                out.append((last, len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted)))
            yield _rows(out, names, kinds)

    return read.mapInArrow(run, "last long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: A conversation of control strings, which the query adds to the table's.
PROBE_ID, PROBE = -1, "</s>[INST] ok [/INST]"


def op11_chat(spark, sf_dir: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of every conversation and of the probe, read back.

    Null roles and texts are empty; rows with a null conv_id are one conversation; an empty table gives the probe alone.
    """
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(PROBE_ID, 0, "user", PROBE), (PROBE_ID, 1, ASSISTANT, PROBE)], "conv_id long, turn long, role string, text string")
    forest = format_chats(turns.union(probe))
    told = stored(_told(read_chats(forest)), "chat-digests")
    return split_join(forest.conversations, told, "last").drop("last")


def _oracle() -> str:
    count = "len(regexp_extract_all({}, '[\\[<]\\\\*(?:" + _RESTS + ")'))"
    marks = " ".join(f"WHEN '{r}' THEN {len(a) + len(b)}" for r, (a, b) in MARKS.items())
    other = f"{sum(map(len, OTHER))} + length(role) + {count.format('role')}"
    order = "ORDER BY turn, role, text"
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES ({PROBE_ID}, 0, 'user', '{PROBE}'), ({PROBE_ID}, 1, '{ASSISTANT}', '{PROBE}'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = '{ASSISTANT}'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' {order}) FILTER (role = '{ASSISTANT}'), '')) AS loss_sha256,
  CAST(sum(length(text) + {count.format('text')} + CASE role {marks} ELSE {other} END) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""


ORACLE = _oracle()
