import zlib

import numpy as np
import pytest

from tidemark.llm import rans
from tests.llm.test_tokens import TEXTS, library


def test_block_round_trip_and_checkpoints():
    r = np.random.default_rng(0)
    for n, top in ((1, 1), (3, 2), (1000, 50), (70_000, 40_000)):
        ids = np.minimum(r.zipf(1.3, n) - 1, top - 1).astype(np.int64) * 3
        t = rans.Frequencies.of_counts(*np.unique(ids, return_counts=True))
        assert t.freq.sum() == 1 << rans.PRECISION and t.freq.min() >= 1
        b = rans.encode_block(ids, t, lanes=64, every=16)
        assert (rans.decode_block(b, t) == ids).all()
        parts = [rans.decode_part(b, k, t) for k in range(len(rans.checkpoints(b)))]
        assert (np.concatenate(parts) == ids).all()
    assert len(parts) > 10


def test_damage_is_found():
    ids = np.arange(500) % 7
    t = rans.Frequencies.of_counts(*np.unique(ids, return_counts=True))
    b = rans.encode_block(ids, t)
    with pytest.raises(ValueError):
        rans.decode_block(b | {"payload": bytes([b["payload"][0] ^ 1]) + b["payload"][1:]}, t)
    with pytest.raises(ValueError):
        rans.encode_block(np.array([99]), t)


def test_compresses_near_the_entropy():
    r = np.random.default_rng(2)
    ids = np.minimum(r.zipf(1.5, 200_000) - 1, 5000).astype(np.int64)
    _, n = np.unique(ids, return_counts=True)
    entropy = -(n * np.log2(n / n.sum())).sum() / 8
    b = rans.encode_block(ids, rans.Frequencies.of_counts(*np.unique(ids, return_counts=True)))
    assert len(b["payload"]) < 1.02 * entropy + 8 * 512


def test_op5_against_the_library(spark, tmp_path):
    texts = dict(enumerate([None, *TEXTS]))
    spark.createDataFrame(list(texts.items())[::-1], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want, at = [], 0
    for i, ids in zip(texts, library([t or "" for t in texts.values()])):
        ids = np.array([*ids, 2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, rans.op5_token_files(spark, str(tmp_path)).collect())) == want


def test_no_documents(spark, tmp_path):
    rans.write_token_files(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "x"))
    assert rans.read_token_files(spark, str(tmp_path / "x")).count() == 0
