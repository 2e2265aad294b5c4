import hashlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from tidemark.llm import chat

pieces = st.sampled_from(["[INST]", "[/INST]", "<s>", "</s>", "\\", "[", "<", "INST]", "[\\INST]", "<\\\\/s>", "[ROLE]", "[TEXT]", "a", "é", "\n", ""])
texts = st.lists(pieces, max_size=8).map("".join)


@given(texts)
def test_escape_is_reversible_and_hides_controls(text):
    hidden = chat.escape(text)
    assert chat.unescape(hidden) == text
    assert not any(c in hidden for c in chat._CONTROLS)


@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system"]), texts), texts), max_size=5))
def test_turns_are_read_back(turns):
    assert chat.turns_of("".join("".join(chat.marked(r, t)) for r, t in turns)) == turns


def test_other_text_is_refused():
    with pytest.raises(ValueError):
        chat.turns_of("[INST]a[/INST] b")


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, node string, start int").repartition(3)


def ordered(rows):
    """conv -> its (role, text) pairs in order."""
    found = defaultdict(list)
    for i, n, role, text in rows:
        found[i].append((n is not None, n or 0, role or "", text or ""))
    return {i: [t[2:] for t in sorted(v)] for i, v in found.items()}


def random_chats(n):
    r = np.random.default_rng(n)
    return [(i, k, ["system", "user", "assistant"][min(k, 2) if k < 3 else 1 + k % 2], f"turn {r.integers(0, 2)} of {k}") for i in range(n) for k in range(r.integers(1, 7))]


ODD = [(-9, 0, None, None), (-9, 1, "tool", "[INST]"), (None, 0, "user", "no id"), (None, 1, "assistant", "</s>"), (500, 1, "user", "same turn"), (500, 1, "user", "same turn"),
       (500, None, "assistant", "no turn"), (501, 0, "user", "long " * 30_000), (502, 0, "[ROLE]", "日本語 <|endoftext|> é"), (503, 0, "user", "")]


def test_forest_is_depth_first_and_shares_turns(spark):
    rows = random_chats(200) + ODD
    forest = chat.format_chats(frame(spark, rows))
    chats = ordered(rows)
    prefixes = {tuple(c[: k + 1]) for c in chats.values() for k in range(len(c))}
    nodes = sorted(forest.nodes.collect(), key=lambda r: r["start"])
    assert len(nodes) == len(prefixes)
    at, stack = 0, []
    for r in nodes:
        n = len(r["ids"]) // 4
        assert r["start"] == at  # without gaps
        spans = [(a["from"], a["to"]) for a in r["ancestors"]]
        while stack and stack[-1] not in spans:
            stack.pop()
        assert spans == stack  # a node follows its parent or the subtree of an earlier child
        assert r["position"] == sum(b - a for a, b in spans)
        stack.append((at, at + n))
        at += n
    own = {r["start"]: r for r in nodes}
    text = lambda r: chat.decoder(chat.default_tokenizer()).text(np.frombuffer(r["ids"], "<u4"))
    for r in forest.conversations.collect():
        last = own[r["last"]]
        whole = "".join(text(own[a["from"]]) for a in last["ancestors"]) + text(last)
        assert chat.turns_of(whole) == chats[r["conv_id"]]
    assert forest.conversations.count() == len(chats)


def test_loss_covers_assistant_texts(spark):
    rows = random_chats(60) + ODD
    forest = chat.format_chats(frame(spark, rows))
    got = {r["last"]: r for r in chat.read_chats(forest).collect()}
    ends = {r["conv_id"]: r["last"] for r in forest.conversations.collect()}
    for i, turns in ordered(rows).items():
        assert got[ends[i]]["loss"] == "".join(t for role, t in turns if role == "assistant")
        assert got[ends[i]]["formatted"] == "".join("".join(chat.marked(*t)) for t in turns)


def test_copies_share_all_their_nodes(spark):
    rows = [(i, k, "user", f"text {k}") for i in range(50) for k in range(3)]
    forest = chat.format_chats(frame(spark, rows))
    assert forest.nodes.count() == 3 and forest.conversations.select("last").distinct().count() == 1


def test_empty_table(spark, tmp_path):
    none = frame(spark, [(1, 0, "user", "x")]).where("false")
    forest = chat.format_chats(none)
    assert forest.nodes.count() == forest.conversations.count() == chat.read_chats(forest).count() == 0
    none.write.parquet(f"{tmp_path}/conversations.parquet")
    (probe,) = chat.op11_chat(spark, str(tmp_path)).collect()
    said = f"user\n{chat.PROBE}\nassistant\n{chat.PROBE}\n"
    assert (probe["conv_id"], probe["n_turns"], probe["turns_sha256"]) == (-1, 2, hashlib.sha256(said.encode()).hexdigest())
    assert probe["loss_sha256"] == hashlib.sha256(chat.PROBE.encode()).hexdigest() and probe["loss_chars"] == len(chat.PROBE)
