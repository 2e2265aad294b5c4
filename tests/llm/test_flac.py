import hashlib
import random
import zlib

import numpy as np
import pytest

from tidemark.llm import flac

R = random.Random(4)
PAYLOADS = [
    b"", b"a", b"x" * 576, b"x" * 577, bytes(range(256)) * 9, R.randbytes(5000), ("The of and. " * 300).encode(),
    bytes(128 + int(90 * np.sin(i / 9)) for i in range(576 * 4 + 5)), b"\xff" * 1152, b"\0\xff" * 700,
]


@pytest.mark.parametrize("lpc", [0, 1, 8, 12])
@pytest.mark.parametrize("orders", [(), (0,), (0, 1, 2, 3, 4)])
def test_round_trip(orders, lpc):
    for p, (pcm, info) in zip(PAYLOADS, flac.decode(flac.encode(PAYLOADS, orders, lpc))):
        assert (pcm[:, 0] + 128).astype(np.uint8).tobytes() == p and info.samples == len(p)


def test_without_a_seek_table():
    s = flac.encode([PAYLOADS[6]])[0]
    n = int.from_bytes(s[43:46], "big")
    bare = s[:4] + bytes([0x80]) + s[5:42] + s[46 + n :]
    assert (flac.decode([bare])[0][0] == flac.decode([s])[0][0]).all()


def test_smaller_where_prediction_helps():
    sine = PAYLOADS[7]
    sizes = [len(flac.encode([sine], o, l)[0]) for o, l in (((), 0), ((0,), 0), ((0, 1, 2), 0), ((0, 1, 2), 8))]
    assert sizes[2] < sizes[1] <= sizes[0] and sizes[3] < 0.9 * sizes[0]


def test_damage_is_found():
    s = bytearray(flac.encode([PAYLOADS[6]])[0])
    for at in (len(s) - 40, len(s) - 1, 43 + 3 + 18 * 7 + 2):
        bad = bytearray(s)
        bad[at] ^= 4
        with pytest.raises((ValueError, IndexError)):
            flac.decode([bytes(bad)])


def bits_to_bytes(text):
    text = text.replace(" ", "")
    return int(text.ljust(-(-len(text) // 8) * 8, "0"), 2).to_bytes(-(-len(text) // 8), "big")


def test_partitions_raw_codes_wasted_bits_and_stereo():
    """A frame made by hand: left is fixed order 1 with 2 partitions, one raw; side has a wasted bit, verbatim."""
    left = [3, 5, 4, 4, -2, -1, 0, 1] * 2
    side = [2, 4, 0, -2, 6, 8, 2, 0] * 2
    n, diffs = 16, np.diff(left).tolist()
    rice = lambda v, k: "0" * ((u := 2 * v if v >= 0 else -2 * v - 1) >> k) + "1" + (format(u & (1 << k) - 1, f"0{k}b") if k else "")
    two = lambda v, w: format(v & (1 << w) - 1, f"0{w}b")
    body = "0 001001 0" + two(left[0], 8) + "00 0001" + "0001" + "".join(rice(v, 1) for v in diffs[:7])
    body += "1111 00101" + "".join(two(v, 5) for v in diffs[7:])
    body += "0 000001 1 1" + "".join(two(v >> 1, 8) for v in side)
    head = bytes([0xFF, 0xF8, 0x60, 8 << 4 | 1 << 1, 0, n - 1])
    frame = head + bytes([flac.crc8(head)]) + bits_to_bytes(body)
    c = flac.crc16_of(np.frombuffer(frame, np.uint8), np.array([0]), np.array([len(frame)]))[0]
    info = b"\0\x10" * 2 + bytes(6) + (8000 << 44 | 1 << 41 | 7 << 36 | n).to_bytes(8, "big") + bytes(16)
    (pcm, got), = flac.decode([b"fLaC\x80\0\0\x22" + info + frame + int(c).to_bytes(2, "big")])
    assert got.channels == 2 and pcm[:, 0].tolist() == left and (pcm[:, 0] - pcm[:, 1]).tolist() == side


def test_frame_numbers():
    for n in (0, 127, 128, 2047, 2048, 65535, 65536, 1 << 20):
        want = chr(n).encode() if not 0xD800 <= n < 0xE000 else None
        assert want is None or flac.coded_number(n) == want


def test_op7(spark, tmp_path):
    texts = [(1, None), (2, ""), (3, "a" * 575), (4, "b" * 576), (5, "é ü" * 1000), (None, "z"), (5, "é ü" * 1000), (9, "long text, " * 20000)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = flac.op7_flac(spark, str(tmp_path)).collect()
    want = []
    for i, t in texts:
        raw = (t or "").encode()
        p = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        want.append((i, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), hashlib.sha256(flac.encode([p])[0]).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(((r[0], r[1], r[2], r[3], r[4], r["media_sha256"]) for r in got), key=key) == sorted(want, key=key)


def test_blocks_have_sample_offsets(spark):
    df = spark.createDataFrame([(1, b"abc" * 1000), (2, None), (3, b"")], "id long, p binary")
    media = flac.encode_column(df, "p", keep=["id"])
    rows = sorted(flac.pcm_blocks(media, "media", keep=["id"], samples=1000).collect())
    assert [(r["block"], r["sample_offset"], r["n_samples"]) for r in rows] == [(0, 0, 1000), (1, 1000, 1000), (2, 2000, 1000)]
    assert b"".join(bytes(r["pcm"]) for r in rows) == b"abc" * 1000


def slow_decode(stream):
    """A decoder of mono 8-bit streams with one partition a frame, a bit at a time, straight from the format."""
    at = 4
    while True:
        last, n = stream[at] >> 7, int.from_bytes(stream[at + 1 : at + 4], "big")
        if stream[at] & 127 == 0:
            total = int.from_bytes(stream[at + 14 : at + 22], "big") & (1 << 36) - 1
        at += 4 + n
        if last:
            break
    bits = "".join(format(b, "08b") for b in stream[at:])
    out, p = [], 0

    def take(n, signed=False):
        nonlocal p
        v = int(bits[p : p + n] or "0", 2)
        p += n
        return v - (v >> n - 1 << n) if signed and n else v

    while len(out) < total:
        assert take(14) == 0b11111111111110 and take(2) == 0
        size, _ = take(4), take(12)
        more = 0
        while take(1):
            more += 1
        take(7 - more + 8 * (more - 1) if more else 7)
        n = {2: 576, 7: None}[size] or take(16) + 1
        take(8 + 1)
        kind, _ = take(6), take(1)
        if kind == 0:
            x = [take(8, True)] * n
        elif kind == 1:
            x = [take(8, True) for _ in range(n)]
        else:
            o = kind - 8 if kind < 32 else kind - 31
            x = [take(8, True) for _ in range(o)]
            c, shift = {0: [], 1: [1], 2: [2, -1], 3: [3, -3, 1], 4: [4, -6, 4, -1]}.get(o, []), 0
            if kind >= 32:
                width = take(4) + 1
                shift = take(5, True)
                c = [take(width, True) for _ in range(o)]
            assert take(2) == 0 and take(4) == 0
            k = take(4)
            for _ in range(n - o):
                q = bits.index("1", p) - p
                p += q + 1
                u = q << k | take(k)
                x.append((u >> 1 if u % 2 == 0 else -(u + 1 >> 1)) + (sum(a * b for a, b in zip(c, x[::-1])) >> shift))
        p = -(-p // 8) * 8 + 16
        out += x
    return bytes(v + 128 for v in out)


def test_streams_are_read_by_a_slow_decoder():
    for p in PAYLOADS:
        for orders, lpc in (((0, 1, 2), 4), ((), 3), ((3, 4), 0)):
            assert slow_decode(flac.encode([p], orders, lpc)[0]) == p
    x = np.frombuffer(PAYLOADS[6] + PAYLOADS[7], np.uint8)
    assert sum(len(flac.encode([x.tobytes()], (0, 1, 2), k)[0]) for k in (4,)) < len(flac.encode([x.tobytes()], (0, 1, 2), 0)[0])


def test_feature_against_plain_sums():
    for p in (b"", b"\x80", bytes(range(256)), R.randbytes(999)):
        x = [b - 128 for b in p]
        want = "rms=0.000;peak=0;mean=0.000;crossings=0"
        if x:
            rms, mean = (sum(v * v for v in x) / len(x)) ** 0.5, sum(x) / len(x)
            want = f"rms={rms:.3f};peak={max(map(abs, x))};mean={mean:.3f};crossings={sum((a < 0) != (b < 0) for a, b in zip(x, x[1:]))}"
        assert flac.feature(np.array(x, np.int64).reshape(-1, 1)) == want
