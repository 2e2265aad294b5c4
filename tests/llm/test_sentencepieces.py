import hashlib
import random
import zlib

import numpy as np
import pytest
import sentencepiece

from tidemark.llm import sentencepieces as sp
from tests.llm.test_tokens import TEXTS


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=sp.default_model())


def samples(n=400):
    r = random.Random(7)
    words = "the of and Zu über l'été ción queçon ing tion THE!! 日本 😀 x.y 12,345 ### | a b c ie s".split()
    for _ in range(n):
        yield r.choice([" ", "", "\n"]).join(r.choice(words) + r.choice(["", "", " ", "  ", "\n", "\t", "   "]) for _ in range(r.randint(1, 30)))
    for _ in range(n):
        yield "".join(r.choice("aeinorst  hld.\n▁") for _ in range(r.randint(1, 80)))


def corpus_texts():
    import duckdb

    return [x for (x,) in duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet'").fetchall()]


def test_ids_of_the_library(library):
    texts = TEXTS + list(samples()) + corpus_texts()
    texts = [t for t in texts if "▁" not in t] + [t for t in texts if "▁" in t]
    got = [np.frombuffer(x, "<u4").tolist() for x in sp.transducer(sp.default_model()).encode(texts)]
    bad = [(t, g, w) for t, g, w in zip(texts, got, library.encode(texts)) if g != w]
    assert not bad, (len(bad), bad[:2])


def test_unigram_paths_are_those_of_the_library(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(open(sp.default_model(), "rb").read())
    m.trainer_spec.model_type = 1
    r = random.Random(5)
    for p in m.pieces:
        if p.type == 1:
            p.score = -r.uniform(3, 15)
    path = tmp_path / "unigram.model"
    path.write_bytes(m.SerializeToString())
    own = sp.transducer(str(path))
    lib = sentencepiece.SentencePieceProcessor(model_file=str(path))
    texts = [t for t in list(samples(60)) + corpus_texts()[:10] if "▁" not in t]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == lib.encode(texts)


@pytest.mark.parametrize("squeeze", [False, True])
@pytest.mark.parametrize("prefix", [False, True])
@pytest.mark.parametrize("fallback", [False, True])
@pytest.mark.parametrize("kind", [1, 2])
def test_other_normalisers_and_unknown_characters(tmp_path, squeeze, prefix, fallback, kind):
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(open(sp.default_model(), "rb").read())
    m.normalizer_spec.remove_extra_whitespaces, m.normalizer_spec.add_dummy_prefix = squeeze, prefix
    m.trainer_spec.byte_fallback, m.trainer_spec.model_type = fallback, kind
    r = random.Random(5)
    for p in m.pieces:
        if p.type == 6 and not fallback:
            p.type = 3
        if p.type == 1 and kind == 1:
            p.score = -r.uniform(3, 15)
    path = tmp_path / "other.model"
    path.write_bytes(m.SerializeToString())
    lib = sentencepiece.SentencePieceProcessor(model_file=str(path))
    texts = [t for t in list(samples(80)) + TEXTS if "▁" not in t] + ["  日本 ☃☃ ☃", "☃", "x☃☃y ☃"]
    assert [np.frombuffer(x, "<u4").tolist() for x in sp.Transducer(sp.read_model(str(path))).encode(texts)] == lib.encode(texts)


def test_long_stretches_small_slices_and_a_small_cache(library, monkeypatch):
    r = random.Random(9)
    texts = ["".join(r.choices("abcdehinorst", k=n)) for n in (3000, 700, 257, 256, 5)] + ["a" * 2000, "the" * 300, " " * 900, " ".join(corpus_texts()[:3])]
    monkeypatch.setattr(sp, "CHARACTERS", 300)
    monkeypatch.setattr(sp, "SLICE", 2000)
    own = sp.Transducer(sp.read_model(sp.default_model()))
    own.kept = sp.Kept(3000)
    for long in (sp.LONG, 4):
        monkeypatch.setattr(sp, "LONG", long)
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == library.encode(texts)


def test_no_rows_nulls_and_clashing_columns(spark):
    docs = spark.createDataFrame([(None, None, b"x"), (3, "a b", b"y"), (3, "a b", b"y")], "doc_id long, text string, ids binary")
    got = sp.decode_pieces(sp.encode_pieces(docs)).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == [(0, ""), (3, "a b"), (3, "a b")]
    assert sp.decode_pieces(sp.encode_pieces(docs.where("false"))).count() == 0


def test_round_trip_on_spark(spark, tmp_path, library):
    texts = [(i, t) for i, t in enumerate([None, *TEXTS, *samples(20)]) if not t or "▁" not in t] + [(None, "z")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, t in texts:
        ids = np.array(library.encode(t or ""), "<u4")
        raw = (t or "").encode()
        want.append((i, len(ids), zlib.crc32(ids.tobytes()), len(raw), hashlib.sha256(raw).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0)
    got = sp.op2_sentencepiece(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
