"""Token ids of whole texts by the tokenizers library.

Texts are handled a slice of a batch at a time, as Arrow buffers: numpy finds where a text may be cut, Arrow's dictionary
encoding finds the distinct units between the cuts, only these meet the library, and numpy gathers the ids back.
"""

from __future__ import annotations

import ctypes
import functools
import json
import os
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one Spark task, one core

#: Bytes of units and their ids that a process keeps, Python's own included.
KEPT_BYTES = 64 << 20
#: Bytes of text that are handled at a time; what numpy and Arrow hold is about twelve times that.
SLICE = 4 << 20
#: Letters below this are letters to every version of the library's tables.
LATIN_END = "ɐ"

_OTHER, SPACE, _MARK, _DIGIT, _LETTER = range(5)
CLASS = np.zeros(256, np.uint8)
CLASS[33:127] = _MARK
CLASS[list(b"0123456789")] = _DIGIT
CLASS[[c for c in range(128) if chr(c).isalpha()]] = _LETTER
CLASS[list(b"\t\n\v\f\r ")] = SPACE
#: White space beyond ASCII, by its last bytes.
_WIDE = [c.encode() for c in map(chr, range(128, 0x3001)) if c.isspace()]


def byte_alphabet() -> dict[int, str]:
    """What byte-level models write for each byte: itself if printable Latin-1, else the next character from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings and where each string starts and ends in them; null counts as empty."""
    column = column.cast(pa.string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], (offsets - offsets[0]).astype(np.int64)


def slices(column: pa.Array, most: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``most`` (SLICE) bytes of text; a longer text is a range of its own."""
    most = most or SLICE
    ends = utf8(column)[1][1:]
    at = 0
    while at < len(ends):
        begun = int(ends[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(ends, begun + most, side="right")))
        yield at, end
        at = end


def parts(batches: Iterator[pa.RecordBatch], text: int | str, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batches of a task in pieces of at most ``most`` (SLICE) bytes of the column ``text``, so that what a task holds
    doesn't depend on how long texts are on average. At the end memory that isn't in use goes back to the system, as the
    process waits for other tasks."""
    for b in batches:
        for i, j in slices(b.column(text), most):
            yield b.slice(i, j - i)
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def cuts(raw: np.ndarray) -> np.ndarray:
    """Where a byte-level BPE with the usual pattern never merges across: true for a byte that begins a unit.

    Before white space that follows something else, and where letters, or digits, end before another ASCII character.
    White space beyond ASCII counts as such: no cut comes after it.
    """
    kind = CLASS[raw]
    lead = (raw >= 0xC3) & (raw <= 0xC5)  # U+00C0 to U+017F are letters but for two signs
    if lead.any():
        at = np.flatnonzero(lead[:-1])
        kind[at[(raw[at] != 0xC3) | ((raw[at + 1] != 0x97) & (raw[at + 1] != 0xB7))] + 1] = _LETTER
    a, b = kind[:-1], kind[1:]
    out = np.zeros(len(raw), bool)
    out[1:] = ((b == SPACE) & (a != SPACE)) | ((a >= _DIGIT) & (b >= _MARK) & (a != b))
    doubt = np.flatnonzero(out[1:] & (b == SPACE) & (a == _OTHER))
    if len(doubt):
        wide = (raw[doubt] >= 0x1C) & (raw[doubt] <= 0x1F)
        for w in _WIDE:
            same = doubt >= len(w) - 1
            for k, byte in enumerate(reversed(w)):
                same &= raw[np.maximum(doubt - k, 0)] == byte
            wide |= same
        out[doubt[wide] + 1] = False
    return out


def distinct(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, pa.StringArray]:
    """For the units of a buffer, which of the distinct ones each is, and these."""
    offsets = np.append(starts, len(raw)).astype(np.int32)
    units = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw)))
    coded = units.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary


def word_places(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a buffer of texts: which bytes aren't ASCII white space, and where words (runs of these in a text) start, and how
    long they are."""
    solid = CLASS[raw] != SPACE
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    first = offsets[:-1][offsets[:-1] < len(raw)]
    begins[first] = solid[first]
    last = first[first > 0] - 1
    ends[last] = solid[last]
    at = np.flatnonzero(begins)
    return solid, at, np.flatnonzero(ends) + 1 - at


def gather(values: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of stretches of ``values`` that have ``sizes``, those named by ``which``, joined; and where each of them ends."""
    starts = np.cumsum(sizes) - sizes
    n = sizes[which]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts[which] - (ends - n), n) + np.arange(total)], ends


class Kept:
    """Values by unit within a bound of bytes and those of one slice, in two generations: what is met again outlives what isn't."""

    def __init__(self, most: int = KEPT_BYTES):
        self.most, self.size, self.young, self.old = most, 0, {}, {}

    def find(self, units: list[str], make) -> list[bytes]:
        """The value of each of distinct units; ``make`` gives those of a list of units that aren't kept."""
        found = list(map(self.young.get, units))
        gaps = [i for i, v in enumerate(found) if v is None]
        names = [units[i] for i in gaps]
        got = list(map(self.old.get, names))
        made = iter(make([u for u, v in zip(names, got) if v is None]))
        got = [next(made) if v is None else v for v in got]
        for i, v in zip(gaps, got):
            found[i] = v
        if self.size > self.most // 2:
            self.young, self.old, self.size = {}, self.young, 0
        self.young.update(zip(names, got))
        self.size += 200 * len(names) + sum(map(len, names)) + sum(map(len, got))
        return found


class Encoder:
    """Ids of texts, each distinct unit of a slice given to the library at most once.

    The ids of a text are those of its units joined. A text with the string of a special token goes to the library in one
    piece, as does every text if the tokenizer isn't a byte-level BPE with the usual pattern.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.library = Tokenizer.from_file(path)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.by_unit = (
            pre.get("type") == "ByteLevel"
            and not pre.get("add_prefix_space")
            and pre.get("use_regex", True)
            and not spec.get("normalizer")
            and spec["model"]["type"] == "BPE"
        )
        self.alphabet = byte_alphabet()
        self.kept = Kept()

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def _make(self, units: list[str]) -> list[bytes]:
        """Ids of units. One of Latin letters, with or without a space before it, is one word to the pattern and goes to
        the library's model without the other steps."""
        out: list = [None] * len(units)
        tokenize, rest = self.library.model.tokenize, []
        for k, unit in enumerate(units):
            word = unit[1:] if unit[0] == " " else unit
            if not word.isalpha() or not (word.isascii() or max(word) < LATIN_END):
                rest.append(k)
                continue
            shown = unit.encode().decode("latin-1").translate(self.alphabet)
            ids = [t.id for t in tokenize(shown)]
            out[k] = pack(f"<{len(ids)}I", *ids)
        for k, ids in zip(rest, self._whole([units[k] for k in rest])):
            out[k] = ids
        return out

    def _units(self, raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a buffer's units, joined, and where each unit's ids end."""
        which, units = distinct(raw, starts)
        found = self.kept.find(units.to_pylist(), self._make)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        return gather(np.frombuffer(b"".join(found), "<u4"), sizes, which)

    def _long(self, raw: np.ndarray) -> np.ndarray:
        """The ids of one text, a window at a time, each begun where the last whole unit of the one before ended."""
        at, size, parts = 0, SLICE, []
        while at < len(raw):
            window = raw[at : at + size]
            starts = np.flatnonzero(np.append(True, cuts(window)[1:]))
            if at + size < len(raw):
                if len(starts) == 1:
                    size *= 2
                    continue
                window, starts = window[: starts[-1]], starts[:-1]
            parts.append(self._units(window, starts)[0])
            at, size = at + len(window), SLICE
        return np.concatenate(parts)

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Unsigned 32-bit ids of the texts of a slice, joined, and where each text's ids start and end."""
        raw, offsets = utf8(column)
        if not self.by_unit:
            return self._joined(self._whole(column.fill_null("").to_pylist()))
        if len(column) == 1 and len(raw) > SLICE and not self._has_special(raw):
            ids = self._long(raw)
            return ids, np.array([0, len(ids)])
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        begins = cuts(raw)
        begins[offsets[:-1][offsets[:-1] < len(raw)]] = True
        starts = np.flatnonzero(begins)
        ids, ends = self._units(raw, starts)
        bounds = np.append(0, ends)[np.searchsorted(starts, offsets)]
        if self._has_special(raw):
            texts = column.fill_null("").to_pylist()
            odd = {i for i, t in enumerate(texts) if any(s in t for s in self.special)}
            whole = dict(zip(odd, self._whole([texts[i] for i in odd])))
            return self._joined([whole.get(i) or ids[a:b].tobytes() for i, (a, b) in enumerate(zip(bounds, bounds[1:]))])
        return ids, bounds

    def _has_special(self, raw: np.ndarray) -> bool:
        data = raw.tobytes() if self.special else b""
        return any(s.encode() in data for s in self.special)

    @staticmethod
    def _joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        bounds = np.cumsum([0, *map(len, parts)]) // 4
        return np.frombuffer(b"".join(parts), "<u4"), bounds

    def encode_rows(self, column: pa.Array) -> Iterator[bytes]:
        """The ids of each text of a column as little-endian unsigned 32-bit integers."""
        for a, b in slices(column):
            ids, bounds = self.encode_column(column.slice(a, b - a))
            raw = ids.astype("<u4").tobytes()
            yield from (raw[4 * s : 4 * e] for s, e in zip(bounds.tolist(), bounds[1:].tolist()))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The same of a list."""
        return self.encode_rows(pa.array(texts, pa.string()))


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def squeeze(ids: bytes) -> bytes:
    """32-bit ids as zstandard of 16-bit ones if all fit, else of themselves; the first byte is the width."""
    a = np.frombuffer(ids, "<u4")
    width = 2 if not len(a) or a.max() < 1 << 16 else 4
    return bytes([width]) + _zstd()[0].compress(a.astype(f"<u{width}").tobytes())


def unsqueeze(data: bytes) -> np.ndarray:
    return np.frombuffer(_zstd()[1].decompress(data[1:]), f"<u{data[0]}")


@functools.cache
def _zstd() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(1), zstandard.ZstdDecompressor()


def token_ids(
    docs: DataFrame, *, end_id: int, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers): the ids of each whole text and then ``end_id``.

    Null text is empty; null ids stay null, repeated rows stay repeated, no rows give no rows; other columns aren't read.
    """
    path = tokenizer or default_tokenizer()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, 1):
            ids = [x + end for x in encoder(path).encode_rows(b.column(1))]
            yield pa.record_batch([b.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, ids binary"
    )
