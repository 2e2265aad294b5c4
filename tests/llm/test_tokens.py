import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import packing, tokens
from tidemark.llm.tokens import default_tokenizer, encoder

TEXTS = [
    "", " ", "a", " a b", "a  b", "a\nb c\n", "x\n\ny", "\n", "one two, three.\nFour five", "tab\there now", "é ü z  q",
    "it's we'll 12 345 ab12", "　wide 　 space", "a <|endoftext|> b", "Ünï çode\nlïne two", "😀 smile 😀", "a\r\nb",
    " lead", "trail ", "x" * 5000, "a b " * 3000,
]


def library(texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_chunks_give_the_ids_of_the_library():
    r = random.Random(3)
    alphabet = ["a", "the", "Zu", "é", " ", " ", " ", "\n", "\t", ".", ",", "'s", "1", "😀", " ", "ß"]
    texts = TEXTS + ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(600)]
    got = [np.frombuffer(x, "<u4").tolist() for x in encoder(default_tokenizer()).encode(texts)]
    assert got == library(texts)


def test_cuts_near_odd_characters():
    """White space beyond ASCII, contractions, marks, digits and letters of other scripts, at every seam of two or three."""
    r = random.Random(4)
    odd = ["a", "é", "×", "ß", "ŉ", "日", "e\u0301", "5", "²", "'", "'s", "'ll", ".", "$", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x1f", "\x85", "\xa0",
           "\u1680", "\u2003", "\u2028", "\u202f", "\u205f", "\u3000", "\u200b", "\ufeff", "\x00", "À", "¢"]
    texts = [a + b + c for a in odd for b in odd for c in ("", "x", " ", "'s")] + ["".join(r.choices(odd, k=40)) for _ in range(2000)]
    got = [np.frombuffer(x, "<u4").tolist() for x in encoder(default_tokenizer()).encode(texts)]
    assert [t for t, g, w in zip(texts, got, library(texts)) if g != w] == []


def test_long_texts_and_a_small_cache(monkeypatch):
    r = random.Random(6)
    texts = [" ".join("".join(r.choices("abcdeé,.5", k=r.randint(1, 9))) for _ in range(n)) for n in (2000, 1, 0, 30, 900)] + ["y" * 3000, None]
    want = library([t or "" for t in texts])
    monkeypatch.setattr(tokens, "SLICE", 512)
    own = tokens.Encoder(default_tokenizer())
    own.kept = tokens.Kept(4000)
    for size in (512, 100_000):
        got = [x for i, j in tokens.slices(pa.array(texts), size) for x in own.encode_rows(pa.array(texts).slice(i, j - i))]
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == want
    assert len(own.kept.young) + len(own.kept.old) < 400


def test_token_ids(spark):
    docs = spark.createDataFrame([(1, "a b", b"x"), (None, None, b"y"), (1, "a b", b"z")], "doc_id long, text string, ids binary")
    got = [(r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in tokens.token_ids(docs, end_id=9).collect()]
    (want,) = library(["a b"])
    assert sorted(got, key=repr) == sorted([(1, [*want, 9]), (None, [9]), (1, [*want, 9])], key=repr)
    assert tokens.token_ids(docs.where("false"), end_id=9).count() == 0


def check_pieces(rows, texts, limit=1024):
    ids = {i: np.array(x + [0], "<u4") for i, x in zip(texts, library([t or "" for t in texts.values()]))}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r["doc_tokens"] == len(ids[r["doc_id"]])
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(piece.tobytes()) == r["ids_crc32"] and r["length"] > 0
        by_doc[r["doc_id"]].append((r["start"], r["length"]))
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by_doc) == set(ids)
    for d, pieces in by_doc.items():
        assert sum(n for _, n in pieces) == len(ids[d])
        assert all(s + n == t for (s, n), (t, _) in zip(sorted(pieces), sorted(pieces)[1:]))
    padding = 0
    for pieces in by_seq.values():
        pieces.sort()
        assert pieces[0][0] == 0 and all(s + n == t for (s, n), (t, _) in zip(pieces, pieces[1:]))
        total = sum(n for _, n in pieces)
        assert total <= limit
        padding += 0 if total & (total - 1) == 0 else limit - total
    return padding


def test_op8_pieces(spark, tmp_path):
    texts = dict(enumerate(TEXTS[:1] + [None] + TEXTS[2:]))
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = packing.op8_packing(spark, str(tmp_path)).collect()
    assert check_pieces(rows, texts) == 0


def test_pack_keeps_all_limits():
    r = np.random.default_rng(1)
    lengths = r.integers(1, 300, 500)
    losses = np.minimum(lengths, r.integers(0, 200, 500))
    limits = packing.Limits(256, 4, 150)
    for cut in (True, False):
        keep = np.ones(500, bool) if cut else (lengths <= 256) & (losses <= 150)
        a, b = lengths[keep], losses[keep]
        seen = np.zeros(len(a), int)
        sequences = packing.pack(a, b, limits, cut)
        for seq in sequences:
            assert 0 < sum(n for *_, n in seq) <= 256 and len(seq) <= 4
            assert sum(max(0, s + n - max(s, a[i] - b[i])) for i, s, n in seq) <= 150
            for i, _, n in seq:
                seen[i] += n
        assert (seen == a).all()
        if cut:
            assert len(sequences) < 1.1 * max(a.sum() / 256, b.sum() / 150, len(a) / 4)


def test_pack_refuses_what_may_not_be_cut():
    with pytest.raises(ValueError):
        packing.pack(np.array([2000]), np.array([0]), packing.Limits(), cut=False)
    assert packing.pack(np.array([], int), np.array([], int), packing.Limits()) == []
