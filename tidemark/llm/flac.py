"""FLAC media columns: encode samples, decode Rice residuals and linear predictors, and give PCM with seek offsets.

Frames are independent, so all frames of a batch of streams advance together: step i codes sample i of every frame in a
few numpy operations. A seek table with a point for each frame tells where they start. Streams without one (other
writers') are decoded frame after frame.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import table

BLOCK = 576
#: Samples that a task codes together.
TOGETHER = 2_000_000
FIXED = {0: [], 1: [1], 2: [2, -1], 3: [3, -3, 1], 4: [4, -6, 4, -1]}


def _crc_table(poly: int, bits: int) -> np.ndarray:
    out = []
    for i in range(256):
        c = i << (bits - 8)
        for _ in range(8):
            c = (c << 1 ^ poly if c >> (bits - 1) else c << 1) & (1 << bits) - 1
        out.append(c)
    return np.array(out, np.int64)


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = int(CRC8[c ^ b])
    return c


def crc16_of(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-16 of many stretches of a buffer, all stretches a byte at a time."""
    order = np.argsort(-sizes, kind="stable")
    s, n = starts[order], sizes[order]
    c = np.zeros(len(s), np.int64)
    live = len(s)
    for j in range(int(n[0]) if len(n) else 0):
        while n[live - 1] <= j:
            live -= 1
        x = c[:live]
        c[:live] = (x << 8 & 0xFFFF) ^ CRC16[(x >> 8) ^ buf[s[:live] + j]]
    out = np.empty_like(c)
    out[order] = c
    return out


def coded_number(n: int) -> bytes:
    """A frame's number in the extended UTF-8 of the format."""
    if n < 128:
        return bytes([n])
    more = next(k for k in range(1, 7) if n < 1 << (6 - k + 6 * k))
    return bytes([(0xFF00 >> more + 1 & 0xFF) | n >> 6 * more, *(0x80 | n >> 6 * (more - 1 - i) & 63 for i in range(more))])


@functools.lru_cache(maxsize=100_000)
def frame_head(number: int, size: int) -> bytes:
    """Header of a frame of one channel of 8-bit samples, with its CRC-8."""
    code, tail = (2, b"") if size == BLOCK else (7, (size - 1).to_bytes(2, "big"))
    head = bytes([0xFF, 0xF8, code << 4, 1 << 1]) + coded_number(number) + tail
    return head + bytes([crc8(head)])


# ---- encoder ----


def _residual(x: np.ndarray, coefs: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """What linear prediction leaves of each row; the first samples stay as they are."""
    order = coefs.shape[1]
    e = x.copy()
    if order:
        guess = sum(coefs[:, j : j + 1] * x[:, order - 1 - j : x.shape[1] - 1 - j] for j in range(order))
        e[:, order:] -= guess >> shift[:, None]
    return e


def lpc(x: np.ndarray, order: int, precision: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients of each row, by the Levinson-Durbin recursion, and their shifts."""
    w = x * np.hanning(x.shape[1] + 2)[1:-1]
    r = np.stack([(w[:, : x.shape[1] - k] * w[:, k:]).sum(1) for k in range(order + 1)], 1)
    a, err = np.zeros((len(x), order)), r[:, 0] * 1.0001 + 1e-9
    for i in range(order):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(1)) / err
        before = a[:, :i].copy()
        a[:, i] = k
        a[:, :i] = before - k[:, None] * before[:, ::-1]
        err *= 1 - k * k
    top = np.maximum(np.abs(a).max(1), 1e-9)
    shift = np.clip(precision - 2 - np.ceil(np.log2(top)).astype(int), 0, 15)
    limit = (1 << precision - 1) - 1
    return np.clip(np.rint(a * (1 << shift)[:, None]), -limit - 1, limit).astype(np.int32), shift.astype(np.int32)


def _fold(e: np.ndarray) -> np.ndarray:
    return (e << 1) ^ (e >> 8 * e.itemsize - 1)


def _bits_for(total: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """About the fewest bits of n Rice codes with the sum ``total``, and their parameter."""
    k = np.arange(15)
    cost = n * (1 + k) + np.maximum(0, total[:, None].astype(float) - n * ((1 << k) - 1) / 2) / (1 << k)
    best = cost.argmin(1)
    return cost[np.arange(len(total)), best], best


def encode(payloads: list[bytes], orders: tuple[int, ...] = (0, 1, 2), lpc_order: int = 4) -> list[bytes]:
    """A FLAC stream of one channel of 8-bit samples (byte - 128) for each payload; any length, also none.

    Each frame takes what is shortest by estimate: samples as they are, a fixed predictor of ``orders``, or a general one
    of ``lpc_order`` (0: none) fitted to the frame.
    """
    out: list[bytes] = []
    for group in _groups([len(p) for p in payloads]):
        out += _encode([payloads[i] for i in group], orders, lpc_order)
    return out


def _groups(sizes: list[int]) -> Iterator[list[int]]:
    held, total = [], 0
    for i, n in enumerate(sizes):
        held.append(i)
        total += n
        if total >= TOGETHER:
            yield held
            held, total = [], 0
    if held:
        yield held


def _encode(payloads: list[bytes], orders: tuple[int, ...], lpc_order: int) -> list[bytes]:
    full = [len(p) // BLOCK for p in payloads]
    x = np.frombuffer(b"".join(p[: n * BLOCK] for p, n in zip(payloads, full)), np.uint8).astype(np.int32).reshape(-1, BLOCK) - 128
    frames = _frames(x, [i for n in full for i in range(n)], orders, lpc_order) if len(x) else []
    out, at = [], 0
    for p, n in zip(payloads, full):
        own, sizes = frames[at : at + n], [BLOCK] * n
        at += n
        rest = p[n * BLOCK :]
        if rest:
            body = frame_head(n, len(rest)) + b"\x02" + bytes(b ^ 128 for b in rest)
            c = int(crc16_of(np.frombuffer(body, np.uint8), np.array([0]), np.array([len(body)]))[0])
            own, sizes = [*own, body + c.to_bytes(2, "big")], [*sizes, len(rest)]
        out.append(_stream(p, own, sizes))
    return out


def _stream(payload: bytes, frames: list[bytes], sizes: list[int]) -> bytes:
    lengths = [len(f) for f in frames]
    pcm = np.frombuffer(payload, np.uint8) ^ 128
    rate, bits = 8000, 8
    info = (
        BLOCK.to_bytes(2, "big") * 2
        + min(lengths, default=0).to_bytes(3, "big")
        + max(lengths, default=0).to_bytes(3, "big")
        + (rate << 44 | (bits - 1) << 36 | len(payload)).to_bytes(8, "big")
        + hashlib.md5(pcm.tobytes()).digest()
    )
    points = np.zeros(len(frames), [("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")])
    points["sample"] = np.cumsum([0, *sizes])[:-1]
    points["offset"] = np.cumsum([0, *lengths])[:-1]
    points["n"] = sizes
    seek = points.tobytes()
    block = lambda kind, data: bytes([kind]) + len(data).to_bytes(3, "big") + data
    if len(seek) >= 1 << 24:  # a metadata block is no longer; such a stream has none and is decoded in order
        return b"".join([b"fLaC", block(0x80, info), *frames])
    return b"".join([b"fLaC", block(0, info), block(0x83, seek), *frames])


def _frames(x: np.ndarray, numbers: list[int], orders: tuple[int, ...], lpc_order: int) -> list[bytes]:
    """The bytes of each row's frame."""
    count, n = x.shape
    best = np.full(count, 8.0 * n)
    order, param, kind = np.zeros(count, int), np.zeros(count, int), np.full(count, 1)
    res = x.copy()
    coefs, shift = np.zeros((count, 0), np.int32), np.zeros(count, int)
    e = x
    for o in range(max(orders, default=-1) + 1):
        if o:
            e = np.concatenate([x[:, :o], np.diff(e[:, o - 1 :], axis=1)], 1)
        if o in orders:
            bits, k = _bits_for(_fold(e[:, o:]).sum(1), n - o)
            better = bits + 8 * o + 10 < best
            best[better], order[better], param[better], kind[better] = bits[better] + 8 * o + 10, o, k[better], 8 + o
            res[better] = e[better]
    if lpc_order:
        coefs, shift = lpc(x, lpc_order)
        e = _residual(x, coefs, shift)
        bits, k = _bits_for(_fold(e[:, lpc_order:]).sum(1), n - lpc_order)
        bits += 8 * lpc_order + 19 + 12 * lpc_order
        better = bits < best
        best[better], order[better], param[better], kind[better] = bits[better], lpc_order, k[better], 31 + lpc_order
        res[better] = e[better]
    flat = (x == x[:, :1]).all(1)
    kind[flat] = 0
    heads = [frame_head(i, n) for i in numbers]
    size = np.array([8 * len(h) for h in heads])
    body = np.where(kind == 1, 8 * n, 8)
    u = _fold(res)
    rice = kind >= 8
    head_bits = np.where(rice, 8 * order + np.where(kind >= 32, 9 + 12 * order, 0) + 10, 0)
    code_bits = (u >> param[:, None].astype(np.int32)) + (1 + param[:, None]).astype(np.int32)
    code_bits[np.arange(n)[None, :] < order[:, None]] = 0
    code_bits[~rice] = 0
    body = np.where(rice, head_bits + code_bits.sum(1), body)
    total = size + 8 + body
    length = (total + 7) // 8 + 2
    start = np.cumsum(length) - length
    bits = np.zeros(8 * int(length.sum()), np.uint8)

    def put(at: np.ndarray, value: np.ndarray, width: int) -> None:
        for j in range(width):
            bits[at + j] = value >> (width - 1 - j) & 1

    at = 8 * start + size
    put(at, kind << 1, 8)
    at = at + 8
    rows = np.flatnonzero(kind == 0)
    put(at[rows], x[rows, 0] & 255, 8)
    rows = np.flatnonzero(kind == 1)
    put((at[rows, None] + 8 * np.arange(n)).ravel(), (x[rows] & 255).ravel(), 8)
    for k in np.unique(kind[rice]):
        rows = np.flatnonzero(kind == k)
        o, p = int(order[rows[0]]), at[rows]
        put((p[:, None] + 8 * np.arange(o)).ravel(), (x[rows, :o] & 255).ravel(), 8)
        p = p + 8 * o
        if k >= 32:
            put(p, np.full(len(rows), 11), 4)
            put(p + 4, shift[rows], 5)
            put((p[:, None] + 9 + 12 * np.arange(o)).ravel(), (coefs[rows] & 4095).ravel(), 12)
            p = p + 9 + 12 * o
        put(p + 6, param[rows], 4)
    first = at + head_bits
    for k in np.unique(param[rice]):
        rows = np.flatnonzero(rice & (param == k))
        ends = np.cumsum(code_bits[rows], 1)
        p = first[rows, None] + ends - k - 1  # of the stop bits
        used = code_bits[rows] > 0
        p, v = p[used], u[rows][used]
        bits[p] = 1
        for j in range(k):
            bits[p + 1 + j] = v >> (k - 1 - j) & 1
    buf = np.packbits(bits)
    for h, s in zip(heads, start.tolist()):
        buf[s : s + len(h)] = np.frombuffer(h, np.uint8)
    crc = crc16_of(buf, start, length - 2)
    buf[start + length - 2], buf[start + length - 1] = crc >> 8, crc & 255
    data = buf.tobytes()
    return [data[s : s + n_] for s, n_ in zip(start.tolist(), length.tolist())]


# ---- decoder ----


@dataclass
class Info:
    block: int
    rate: int
    channels: int
    bits: int
    samples: int
    md5: bytes
    points: np.ndarray | None
    first: int


def read_info(data: bytes) -> Info:
    """The metadata of a stream, and where its frames begin."""
    if data[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, info, points = 4, None, None
    while True:
        last, kind, n = data[at] >> 7, data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
        body = data[at + 4 : at + 4 + n]
        if kind == 0:
            v = int.from_bytes(body[10:18], "big")
            info = [int.from_bytes(body[2:4], "big"), v >> 44, (v >> 41 & 7) + 1, (v >> 36 & 31) + 1, v & (1 << 36) - 1, body[18:34]]
        elif kind == 3:
            points = np.frombuffer(body, [("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")])
            points = points[points["sample"] != 2**64 - 1]
        at += 4 + n
        if last:
            break
    if info is None:
        raise ValueError("no stream information")
    covered = points is not None and int(points["n"].sum()) == info[4]
    return Info(*info, points if covered else None, at)


def _head(data: bytes, at: int, info_bits: int) -> tuple[int, int, int, int]:
    """Of the frame at ``at``: length of its header, samples, channel code, bits a sample. A wrong CRC-8 raises."""
    if data[at] != 0xFF or data[at + 1] & 0xFE != 0xF8:
        raise ValueError(f"no frame at {at}")
    size, rate, channels, bits = data[at + 2] >> 4, data[at + 2] & 15, data[at + 3] >> 4, data[at + 3] >> 1 & 7
    p = at + 4
    more = 0
    while data[p] & 0x80 >> more:
        more += 1
    p += max(1, more)
    if size in (6, 7):
        n = int.from_bytes(data[p : p + size - 5], "big") + 1
        p += size - 5
    else:
        n = 192 if size == 1 else BLOCK << size - 2 if size < 6 else 256 << size - 8
    p += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if crc8(data[at:p]) != data[p]:
        raise ValueError(f"wrong header checksum at {at}")
    return p + 1 - at, n, channels, {0: info_bits, 1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}[bits]


class Bits:
    """Reads bit fields at many places of a buffer at once."""

    def __init__(self, buf: np.ndarray):
        b = np.concatenate([buf, np.zeros(8, np.uint8)]).astype(np.int64)
        self.word = b[:-4] << 32 | b[1:-3] << 24 | b[2:-2] << 16 | b[3:-1] << 8 | b[4:]

    def get(self, p: np.ndarray, n) -> np.ndarray:
        """n (0 to 32) bits at bit p."""
        return self.word[p >> 3] >> (40 - (p & 7) - n) & ((1 << n) - 1 if isinstance(n, int) else (np.int64(1) << n) - 1)

    def signed(self, p: np.ndarray, n) -> np.ndarray:
        v = self.get(p, n)
        return v - (v >> (n - 1) << n)

    def unary(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Zeros before the next 1, and the place after that 1."""
        q = np.zeros_like(p)
        while True:
            room = 40 - (p & 7)
            w = self.word[p >> 3] & (np.int64(1) << room) - 1
            none = w == 0
            if not none.any():
                break
            step = np.where(none, room, 0)
            p, q = p + step, q + step
            if (p >> 3 >= len(self.word)).any():
                raise ValueError("a Rice code has no end")
        zeros = room - 1 - ((w.astype(np.float64).view(np.int64) >> 52) - 1023)
        return q + zeros, p + zeros + 1


def _subframes(r: Bits, p: np.ndarray, n: int, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples of one channel of frames of n samples, from bit p on, and the bit after them."""
    kind = r.get(p, 7)
    wasted = r.get(p + 7, 1)
    p = p + 8
    if wasted.any():
        rows = np.flatnonzero(wasted)
        zeros, end = r.unary(p[rows])
        wasted[rows], p[rows] = zeros + 1, end
    bits = bits - wasted
    x = np.zeros((len(p), n), np.int64)
    rows = np.flatnonzero(kind == 0)
    x[rows] = r.signed(p[rows], bits[rows])[:, None]
    p[rows] += bits[rows]
    rows = np.flatnonzero(kind == 1)
    if len(rows):
        x[rows] = r.signed(p[rows, None] + bits[rows, None] * np.arange(n), bits[rows, None])
        p[rows] += n * bits[rows]
    if ((kind > 1) & (kind < 8) | (kind > 12) & (kind < 32)).any():
        raise ValueError("a reserved kind of subframe")
    for k in np.unique(kind[kind >= 8]).tolist():
        rows = np.flatnonzero(kind == k)
        o = k - 8 if k < 32 else k - 31
        q, b = p[rows], bits[rows]
        own = np.zeros((n, len(rows)), np.int64)  # a row per sample, so that a step reads and writes whole rows
        for i in range(o):
            own[i] = r.signed(q, b)
            q = q + b
        if k >= 32:
            precision, shift = r.get(q, 4) + 1, r.signed(q + 4, 5)
            q = q + 9
            coefs = np.zeros((o, len(rows)), np.int64)
            for i in range(o):
                coefs[i] = r.signed(q, precision)
                q = q + precision
        else:
            shift, coefs = 0, FIXED[o]
        e, q = _rice(r, q, n, o)
        own[o:] = e[o:]
        for i in range(o, n) if o else ():
            own[i] += sum(c * own[i - 1 - j] for j, c in enumerate(coefs)) >> shift
        x[rows] = own.T
        p[rows] = q
    return x << wasted[:, None], p


def _rice(r: Bits, p: np.ndarray, n: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Residuals from bit p on, a row per sample: Rice codes in partitions, each with its parameter or raw."""
    wide = r.get(p, 2)
    if (wide > 1).any():
        raise ValueError("a reserved coding of residuals")
    part = n >> r.get(p + 2, 4)
    p = p + 6
    width = 4 + wide
    u = np.zeros((n, len(p)), np.int64)
    k, raw = np.zeros_like(p), np.zeros(len(p), bool)
    smallest = np.unique(part)
    for i in range(order, n):
        if i == order or (i % smallest == 0).any():
            new = np.flatnonzero(i % part == 0) if i != order else np.arange(len(p))
            k[new] = r.get(p[new], width[new])
            p[new] += width[new]
            raw[new] = k[new] == (1 << width[new]) - 1
            if raw[new].any():
                rows = new[raw[new]]
                k[rows] = r.get(p[rows], 5)
                p[rows] += 5
        if raw.any():
            rows = np.flatnonzero(raw)
            v = np.where(k[rows] > 0, r.signed(p[rows], np.maximum(k[rows], 1)), 0)
            u[i, rows] = _fold(v)
            p[rows] += k[rows]
            rows = np.flatnonzero(~raw)
            q, at = r.unary(p[rows])
            u[i, rows] = q << k[rows] | r.get(at, k[rows])
            p[rows] = at + k[rows]
        else:
            q, at = r.unary(p)
            u[i] = q << k | r.get(at, k)
            p = at + k
    return u >> 1 ^ -(u & 1), p


def decode_frames(data: bytes, starts: list[int], info_bits: list[int], bits: Bits | None = None) -> tuple[list[np.ndarray], list[int]]:
    """Samples (a column per channel) of the frames at ``starts``, and where each ends. Wrong checksums raise.

    ``bits`` are those of ``data``, for whoever reads it more than once.
    """
    buf = np.frombuffer(data, np.uint8)
    r = bits or Bits(buf)
    heads = [_head(data, s, b) for s, b in zip(starts, info_bits)]
    out: list = [None] * len(starts)
    ends = np.zeros(len(starts), np.int64)
    for n, code in dict.fromkeys(h[1:3] for h in heads):
        rows = [i for i, h in enumerate(heads) if h[1:3] == (n, code)]
        p = np.array([8 * (starts[i] + heads[i][0]) for i in rows])
        depth = np.array([heads[i][3] for i in rows])
        count = 2 if code >= 8 else code + 1
        channels = []
        for c in range(count):
            side = code == 9 and c == 0 or code in (8, 10) and c == 1
            x, p = _subframes(r, p, n, depth + side)
            channels.append(x)
        if code == 8:
            channels[1] = channels[0] - channels[1]
        elif code == 9:
            channels[0] = channels[0] + channels[1]
        elif code == 10:
            mid = channels[0] << 1 | channels[1] & 1
            channels = [mid + channels[1] >> 1, mid - channels[1] >> 1]
        end = (p + 7) // 8
        begin = np.array([starts[i] for i in rows])
        crc = crc16_of(buf, begin, end - begin)
        if (crc != (buf[end].astype(np.int64) << 8 | buf[end + 1])).any():
            raise ValueError("wrong frame checksum")
        ends[rows] = end + 2
        whole = np.stack(channels, 2)
        for i, x in zip(rows, whole):
            out[i] = x
    return out, ends.tolist()


def decode(streams: list[bytes]) -> list[tuple[np.ndarray, Info]]:
    """Samples (rows) by channels (columns) of each stream. Checksums of headers, frames and streams are verified."""
    out: list = []
    for group in _groups([len(s) for s in streams]):
        out += _decode([streams[i] for i in group])
    return out


def _decode(streams: list[bytes]) -> list[tuple[np.ndarray, Info]]:
    infos = [read_info(s) for s in streams]
    bases = np.cumsum([0, *map(len, streams)]).tolist()
    starts, bits, counts = [], [], []
    for info, base in zip(infos, bases):
        own = [] if info.points is None else (base + info.first + info.points["offset"].astype(np.int64)).tolist()
        starts += own
        bits += [info.bits] * len(own)
        counts.append(len(own))
    frames, _ = decode_frames(b"".join(streams), starts, bits) if starts else ([], [])
    out, at = [], 0
    for s, info, n in zip(streams, infos, counts):
        own = frames[at : at + n]
        at += n
        if info.points is None and info.samples:
            own, p, got, r = [], info.first, 0, Bits(np.frombuffer(s, np.uint8))
            while got < info.samples:
                (x,), (p,) = decode_frames(s, [p], [info.bits], r)
                own.append(x)
                got += len(x)
        pcm = np.concatenate(own) if own else np.zeros((0, info.channels), np.int64)
        if info.bits == 8 and any(info.md5) and hashlib.md5(pcm.astype(np.int8).tobytes()).digest() != info.md5:
            raise ValueError("wrong checksum of the samples")
        out.append((pcm, info))
    return out


# ---- DataFrames ----


def padded(raw: bytes) -> bytes:
    """Bytes 255 appended, up to a positive multiple of BLOCK."""
    return raw + b"\xff" * (max(BLOCK, -(-len(raw) // BLOCK) * BLOCK) - len(raw))


def encode_column(df: DataFrame, payload: str, *, keep: list[str], name: str = "media") -> DataFrame:
    """The columns ``keep`` and the FLAC stream of the binary column ``payload``; null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _parts(b, len(keep)):
                raw = part.column(len(keep)).to_pylist()
                got = iter(encode([x for x in raw if x is not None]))
                media = [None if x is None else next(got) for x in raw]
                yield pa.record_batch([*part.columns[: len(keep)], pa.array(media, pa.binary())], names=[*keep, name])

    return _map(df, keep, payload, run, f"`{name}` binary")


def _parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch of about TOGETHER bytes, so that what is held doesn't depend on the batch's rows."""
    at, held = 0, 0
    for i, x in enumerate(batch.column(column)):
        held += len(x.as_buffer()) if x.is_valid else 0
        if held >= TOGETHER:
            yield batch.slice(at, i + 1 - at)
            at, held = i + 1, 0
    if at < batch.num_rows:
        yield batch.slice(at)


def _map(df: DataFrame, keep: list[str], column: str, run, added: str) -> DataFrame:
    picked = df.select(*keep, F.col(column).alias("__tm_in"))
    schema = ", ".join(f"`{c}` {t}" for c, t in picked.dtypes[:-1])
    return picked.mapInArrow(run, ", ".join(x for x in (schema, added) if x))


def feature(pcm: np.ndarray) -> str:
    """Level, peak, mean and zero crossings of one channel, in a fixed notation."""
    if not len(pcm):
        return "rms=0.000;peak=0;mean=0.000;crossings=0"
    x = pcm[:, 0]
    rms = float(np.sqrt((x * x).mean()))
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    return f"rms={rms:.3f};peak={int(np.abs(x).max())};mean={float(x.mean()):.3f};crossings={crossings}"


#: Samples of a block of PCM.
PCM_SAMPLES = 1 << 16
_PCM = pa.list_(pa.struct([("block", pa.int64()), ("sample_offset", pa.int64()), ("n_samples", pa.int64()), ("pcm", pa.binary())]))


def decode_blocks(df: DataFrame, media: str, *, keep: list[str], samples: int = PCM_SAMPLES) -> DataFrame:
    """``keep``, blocks and feature of a column of FLAC streams; null stays null.

    blocks are the stream's PCM (unsigned 8-bit samples) in blocks of ``samples``: block, sample_offset, n_samples, pcm. So
    a sample is found by its number, in the block of that number divided by ``samples``. No samples give no blocks.
    """

    def told(pcm: np.ndarray) -> list[dict]:
        raw = (pcm + 128).astype(np.uint8).tobytes()
        cut = ((i, raw[i : i + samples]) for i in range(0, len(raw), samples))
        return [{"block": i // samples, "sample_offset": i, "n_samples": len(x), "pcm": x} for i, x in cut]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _parts(b, len(keep)):
                raw = part.column(len(keep)).to_pylist()
                got = iter(decode([x for x in raw if x is not None]))
                found = [None if x is None else next(got)[0] for x in raw]
                yield pa.record_batch(
                    [
                        *part.columns[: len(keep)],
                        pa.array([None if x is None else told(x) for x in found], _PCM),
                        pa.array([None if x is None else feature(x) for x in found], pa.string()),
                    ],
                    names=[*keep, "blocks", "feature"],
                )

    kind = "array<struct<block:bigint,sample_offset:bigint,n_samples:bigint,pcm:binary>>"
    return _map(df, keep, media, run, f"blocks {kind}, feature string")


def whole_pcm(blocks: str = "blocks") -> Column:
    """The samples of a column of blocks, joined."""
    return F.unhex(F.array_join(F.transform(blocks, lambda b: F.hex(b["pcm"])), ""))


def decode_column(df: DataFrame, media: str, *, keep: list[str]) -> DataFrame:
    """``keep``, pcm (unsigned 8-bit samples of 8-bit streams) and feature of a column of FLAC streams; null stays null."""
    return decode_blocks(df, media, keep=keep).select(*keep, whole_pcm().alias("pcm"), "feature")


def pcm_blocks(df: DataFrame, media: str, *, keep: list[str], samples: int = PCM_SAMPLES) -> DataFrame:
    """Decoded streams with a row per block: ``keep``, block, sample_offset, n_samples, pcm."""
    rows = decode_blocks(df, media, keep=keep, samples=samples).select(*keep, F.explode("blocks").alias("__tm_block"))
    return rows.select(*keep, "__tm_block.*")


def text_payloads(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, payload: UTF-8 of the whole text (null: empty), padded with bytes 255."""
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    n = F.octet_length(raw)
    fill = F.greatest(F.lit(BLOCK), F.ceil(n / BLOCK) * BLOCK).cast("int") - n
    pad = F.unhex(F.repeat(F.lit("ff"), fill))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), n.cast("long").alias("n_bytes"), F.concat(raw, pad).alias("payload")
    )


def op7_flac(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of every document.

    payload and feature come from the blocks of PCM that the stored stream decodes to. Null text is empty; null ids are
    kept, repeated rows stay repeated, an empty table has no rows.
    """
    keep = ["doc_id", "n_bytes", "media_bytes", "media_sha256"]
    media = encode_column(text_payloads(table(spark, sf_dir, "documents")), "payload", keep=keep[:2])
    told = media.select(
        *keep[:2], F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media"
    )
    blocks = decode_blocks(told, "media", keep=keep)
    last = F.element_at("blocks", -1)["pcm"]  # a payload is a multiple of 576 bytes, a block of 65536: at least 64 are left
    return blocks.select(
        "doc_id",
        "n_bytes",
        F.aggregate("blocks", F.lit(0).cast("long"), lambda n, b: n + b["n_samples"]).alias("payload_bytes"),
        F.sha2(whole_pcm(), 256).alias("payload_sha256"),
        F.crc32(F.substring(last, -32, 32)).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        "feature",
    )
