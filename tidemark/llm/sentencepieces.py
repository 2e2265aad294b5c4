"""SentencePiece encoding and decoding by weighted finite-state transducers.

Three transducers are compiled from a model into arc tables: the normaliser (a text's characters to the marked ones that the
pieces are made of), the pieces (a trie whose accepting states put out a piece and its weight), and the byte fallback
(a character that is in no piece, to the pieces of its bytes). Composed with an input they give a lattice of arcs between
the input's positions; the encoding is its least path in the tropical semiring, where weights add along a path.

For a unigram model a piece weighs its negative score. The encoding of a BPE model isn't the path of the best sum; but a
sequence of pieces is that encoding just if the merges leave each pair of neighbours as it is. That rule is a machine of its
own, whose states are the last pieces: an arc weighs 0 if its piece may follow the last one, else infinity, and then
one state stays finite at each position.

The distinct units of a slice of texts are composed and relaxed together, in numpy, position by position.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import table
from tidemark.llm.tokens import Kept, distinct, gather, parts, slices, utf8

MARK = "▁"
#: A character without a piece costs that much more than the worst piece, as in the published library.
UNKNOWN_COST = 10.0
#: Bytes of text that are handled at a time, and characters of distinct units whose lattices are held at a time.
SLICE, CHARACTERS = 4 << 20, 100_000
#: Bytes of units and their ids that a process keeps, Python's own included.
KEPT_BYTES = 32 << 20
#: Characters from which a stretch without a cut is relaxed on its own instead of beside others.
LONG = 256
_NEVER = 1 << 40


@dataclass(frozen=True)
class Spec:
    """What of a model file the transducers need."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: tuple[int, ...]  # 1 normal, 2 unknown, 3 control, 4 user-defined, 5 unused, 6 byte
    bpe: bool
    dummy_prefix: bool
    squeeze: bool
    byte_fallback: bool


def read_model(path: str) -> Spec:
    """Model types unigram (1) and BPE (2) without a table of replaced characters; others raise ValueError."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    n, t = m.normalizer_spec, m.trainer_spec
    if t.model_type not in (1, 2) or n.precompiled_charsmap or not n.escape_whitespaces or t.treat_whitespace_as_suffix:
        raise ValueError("the model's type or normaliser isn't one of those that are compiled here")
    if any(p.type in (4, 5) for p in m.pieces):
        raise ValueError("user-defined and unused pieces aren't compiled here")
    return Spec(
        tuple(p.piece for p in m.pieces), tuple(p.score for p in m.pieces), tuple(p.type for p in m.pieces),
        t.model_type == 2, n.add_dummy_prefix, n.remove_extra_whitespaces, t.byte_fallback,
    )


class Arcs:
    """An arc table sorted by (state, input symbol): the state that each arc leads to."""

    def __init__(self, arcs: dict[tuple[int, int], int]):
        keys = np.array([s << 21 | c for s, c in arcs], np.int64)
        order = np.argsort(keys)
        self.keys, self.to = keys[order], np.array(list(arcs.values()), np.int64)[order]

    def follow(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Where each state goes with its symbol; -1 where it has no such arc."""
        if not len(self.keys):
            return np.full(len(states), -1)
        wanted = states << 21 | symbols
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.to[at], -1)


class Normaliser:
    """Arcs over the classes of a byte (0: space, 1: other): what is put out, and the next state.

    States: 0 at a text's start, 1 after another byte, 2 after a space. Spaces stand for the mark until the pieces are
    read. A state is decided by the byte before, so all positions are composed at once.
    """

    def __init__(self, dummy_prefix: bool, squeeze: bool):
        before = b" " if dummy_prefix else b""
        if squeeze:  # a run of spaces inside is one, which the next word puts out; others are none
            self.arcs = {(0, 0): (b"", 0), (0, 1): (before, 1), (1, 0): (b"", 2), (1, 1): (b"", 1), (2, 0): (b"", 2), (2, 1): (b" ", 1)}
        else:
            self.arcs = {(0, 0): (before, 2), (0, 1): (before, 1)} | {(s, c): (b"", 2 - c) for s in (1, 2) for c in (0, 1)}
        self.copied = {(s, c): c == 1 or not squeeze for s, c in self.arcs}

    def apply(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes put out for a buffer of texts, and the texts' offsets in them."""
        n = len(raw)
        kind = (raw != 32).view(np.uint8)
        state = np.zeros(n, np.uint8)
        state[1:] = 2 - kind[:-1]
        begins = offsets[:-1][offsets[:-1] < offsets[1:]]
        state[begins] = 0
        if self.arcs[0, 0][1] == 0 and n:  # spaces at the start lead back to it
            full = np.append(0, np.cumsum(kind))
            text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
            state[(full[:-1] - full[offsets[text]] == 0)] = 0
        at = 2 * state + kind
        extra = np.array([len(self.arcs[s, c][0]) for s in range(3) for c in range(2)], np.uint8)[at]
        own = np.array([self.copied[s, c] for s in range(3) for c in range(2)])[at]
        if own.all() and not extra.any():
            return raw, offsets
        ends = np.cumsum(extra + own.view(np.uint8), dtype=np.int64)
        out = np.full(int(ends[-1]) if n else 0, 32, np.uint8)
        out[ends[own] - 1] = raw[own]
        return out, np.append(0, ends)[offsets]


class Pieces:
    """The trie of the pieces, and for BPE the machine that says which piece may follow which.

    Symbols are the piece ids, then ids of characters that occur in pieces without being one. A piece's rank is its place
    among the scores, as merges of a higher score come first, of equal scores the left one; parts rank no later than wholes.
    """

    def __init__(self, spec: Spec):
        self.bpe = spec.bpe
        ids = {p: i for i, (p, k) in enumerate(zip(spec.pieces, spec.kinds)) if k == 1}
        self.weights = -np.array(spec.scores, np.float32)  # as the library adds them
        self.worst = np.float32(max((self.weights[i] for i in ids.values()), default=0.0) + np.float32(UNKNOWN_COST))
        self.alone = sorted({c for p in ids for c in p} - set(ids)) if spec.bpe else []
        symbols = ids | {c: len(spec.pieces) + k for k, c in enumerate(self.alone)}
        self.count = len(spec.pieces) + len(self.alone)
        usable = self._merges(symbols, spec) if spec.bpe else np.ones(self.count, bool)
        arcs: dict[tuple[int, int], int] = {}
        accept = [-1]
        for p, i in symbols.items():
            state = 0
            for c in map(ord, p):
                nxt = arcs.setdefault((state, c), len(accept))
                if nxt == len(accept):
                    accept.append(-1)
                state = nxt
            if usable[i]:
                accept[state] = i
        self.trie, self.accept = Arcs(arcs), np.array(accept)
        first = {c: to for (s, c), to in arcs.items() if s == 0}
        self.first = np.full(0x110000, -1, np.int32)
        self.first[list(first)] = list(first.values())
        self.pairs = np.unique(np.array([ord(a) << 21 | ord(b) for p in ids for a, b in zip(p, p[1:])], np.int64))

    # ---- the machine of neighbours ----

    def _merges(self, symbols: dict[str, int], spec: Spec) -> np.ndarray:
        """Fill rank, left, right and the unions; which symbols merges can make at all."""
        scores = np.array([*spec.scores, *[0.0] * len(self.alone)])
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int64)
        for p, i in symbols.items():
            if len(p) == 1:
                self.rank[i] = -1
        self.left, self.right = np.zeros((2, self.count + 1), np.int64)
        rows = [(symbols[p[:k]], symbols[p[k:]], i, len(p)) for p, i in symbols.items() for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols]
        a, b, whole, size = np.array(rows, np.int64).reshape(-1, 4).T
        keys = a << 32 | b
        order = np.argsort(keys)
        self.joins, self.join_rank = keys[order], 2 * self.rank[whole[order]]
        usable = np.zeros(self.count, bool)
        usable[[i for p, i in symbols.items() if len(p) == 1]] = True
        for n in np.unique(size):
            own = np.flatnonzero(size == n)
            own = own[usable[a[own]] & usable[b[own]] & (np.maximum(self.rank[a[own]], self.rank[b[own]]) <= self.rank[whole[own]])]
            own = own[self.fits(a[own], b[own], 2 * self.rank[whole[own]])]
            self.left[whole[own]], self.right[whole[own]] = a[own], b[own]
            usable[whole[own]] = True
        return usable

    def _union(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Twice the rank of the piece that two symbols make together; _NEVER if they make none."""
        wanted = a << 32 | b
        at = np.minimum(np.searchsorted(self.joins, wanted), len(self.joins) - 1)
        return np.where(self.joins[at] == wanted, self.join_rank[at], _NEVER)

    def fits(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether merges leave neighbours a and b as they are, or do so before ``limit`` (twice a rank).

        Their merges are undone from the last to the first; what touches the border then must not have a union that comes
        before the merge just undone. Of equal ranks the left merge comes first, so the right one is undone first.
        """
        out = np.ones(len(a), bool)
        live, x, y = np.arange(len(a)), a, b
        limit = np.full(len(a), _NEVER) if limit is None else limit
        while len(live):
            bad = self._union(x, y) < limit
            out[live[bad]] = False
            rx, ry = self.rank[np.minimum(x, self.count - 1)], self.rank[np.minimum(y, self.count - 1)]
            rx, ry = np.where(x < self.count, rx, -1), np.where(y < self.count, ry, -1)
            on = ~bad & ((rx >= 0) | (ry >= 0))
            live, x, y, rx, ry = live[on], x[on], y[on], rx[on], ry[on]
            back = rx > ry
            limit = np.where(back, 2 * rx, 2 * ry + 1)
            x, y = np.where(back, self.right[np.minimum(x, self.count)], x), np.where(back, y, self.left[np.minimum(y, self.count)])
        return out

    # ---- composition ----

    def stretches(self, text: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Where stretches begin that no piece goes beyond; ``begins`` marks those that are known."""
        cut = begins.copy()
        if len(self.pairs) and len(text) > 1:
            wanted = text[:-1] << 21 | text[1:]
            at = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
            cut[1:] |= self.pairs[at] != wanted
        elif len(text):
            cut[:] = True
        return np.flatnonzero(cut)

    def lattice(self, text: np.ndarray, ends: np.ndarray, unknown: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The arcs of all positions: start, end, symbol. ``ends``: where each position's stretch ends. ``unknown``: the
        symbol of a character that has no piece of its own."""
        found = []
        at, state = np.arange(len(text)), self.first[text].astype(np.int64)
        lone = (state < 0) | (self.accept[state] < 0)
        found.append((at[lone], at[lone] + 1, unknown[lone]))
        size = 1
        while True:
            on = state >= 0
            at, state = at[on], state[on]
            piece = self.accept[state]
            has = piece >= 0
            found.append((at[has], at[has] + size, piece[has]))
            on = at + size < ends[at]
            at, state = at[on], state[on]
            if not len(at):
                return tuple(np.concatenate(x) for x in zip(*found))
            state = self.trie.follow(state, text[at + size])
            size += 1

    def least(self, text: np.ndarray, starts: np.ndarray, unknown: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols on the least paths of all stretches, in order, and the positions at which they end."""
        sizes = np.diff(np.append(starts, len(text)))
        begin, ends = np.repeat(starts, sizes), np.repeat(starts + sizes, sizes)
        s, e, piece = self.lattice(text, ends, unknown)
        order = np.lexsort((s, e, e - begin[s]))
        s, e, piece = s[order], e[order], piece[order]
        first = s == begin[s]
        weight = np.where(piece < len(self.weights), self.weights[np.minimum(piece, len(self.weights) - 1)], self.worst)
        symbol, came, cost = np.full(len(text), -1), np.zeros(len(text), np.int64), np.full(len(text), np.inf, np.float32)
        long = (ends - begin)[s] > LONG
        short = [x[~long] for x in (s, e, piece, first, weight)] if long.any() else [s, e, piece, first, weight]
        for a, b in self._blocks(short[1] - begin[short[0]]):
            self._relax(*(x[a:b] for x in short), symbol, came, cost)
        for start, n in zip(starts[sizes > LONG].tolist(), sizes[sizes > LONG].tolist()):
            own = np.flatnonzero(long & (begin[s] == start))
            self._relax_alone(*(x[own] for x in (s, e, piece, weight)), start, n, symbol, came, cost)
        if (symbol < 0).any():
            raise ValueError("the pieces of the model aren't such as merges make")
        on, at = np.zeros(len(text), bool), starts + sizes
        while len(at):
            on[at - 1] = True
            at = came[at - 1]
            at = at[at > begin[np.minimum(at, len(text) - 1)]]
        return symbol[on], np.flatnonzero(on) + 1

    @staticmethod
    def _blocks(offset: np.ndarray) -> Iterator[tuple[int, int]]:
        edges = [0, *(np.flatnonzero(np.diff(offset)) + 1).tolist(), len(offset)]
        return zip(edges, edges[1:]) if len(offset) else iter(())

    def _relax(self, s, e, piece, first, weight, symbol, came, cost) -> None:
        """Relax all arcs that end at the same distance from the start of their stretch, longest first."""
        new = np.append(True, e[1:] != e[:-1])
        if not self.bpe:
            w = np.where(first, np.float32(0), cost[s - 1]) + weight
            order = np.lexsort((np.arange(len(e)), w, e))
            best = order[new]  # sorted by end, so a group's first place is that of its least weight
            symbol[e[best] - 1], came[e[best] - 1], cost[e[best] - 1] = piece[best], s[best], w[best]
            return
        turn = np.arange(len(e)) - np.flatnonzero(new)[np.cumsum(new) - 1]
        for t in range(int(turn.max()) + 1):
            own = np.flatnonzero((turn == t) & (symbol[e - 1] < 0))
            ok = first[own].copy()
            rest = np.flatnonzero(~ok)
            ok[rest] = self.fits(symbol[s[own[rest]] - 1], piece[own[rest]])
            own = own[ok]
            symbol[e[own] - 1], came[e[own] - 1] = piece[own], s[own]

    def _relax_alone(self, s, e, piece, weight, start, n, symbol, came, cost) -> None:
        """Relax a long stretch; s, e and piece are sorted by end. For BPE the arcs that meet are compared beforehand, a
        window of positions at a time."""
        count = np.bincount(e - start, minlength=n + 1)
        head = np.cumsum(count) - count
        chosen = [-1] * (n + 1)
        for a in range(0, len(s), 20_000):
            part = slice(a, a + 20_000)
            before = s[part] - start
            size = np.where(before > 0, count[before], 0)
            base = np.cumsum(size) - size
            if self.bpe:
                mine = np.repeat(np.arange(len(before)), size)
                other = head[before[mine]] + np.arange(len(mine)) - base[mine]
                ok = self.fits(piece[other], piece[part][mine]).tolist()
            rows = zip(before.tolist(), (e[part] - start).tolist(), base.tolist(), weight[part].tolist())
            for k, (i, j, at, w) in enumerate(rows, a):
                if self.bpe:
                    if chosen[j] < 0 and (i == 0 or ok[at + chosen[i] - head[i]]):
                        chosen[j] = k
                    continue
                w += cost[start + i - 1] if i else 0.0
                if w < cost[start + j - 1]:
                    cost[start + j - 1], chosen[j] = w, k
        picked = np.array(chosen[1:])
        symbol[start : start + n], came[start : start + n] = np.where(picked < 0, -1, piece[picked]), s[picked]


class Transducer:
    """The composition of a model's three transducers with texts, and its inverse."""

    def __init__(self, spec: Spec):
        self.spec = spec
        self.normaliser, self.pieces = Normaliser(spec.dummy_prefix, spec.squeeze), Pieces(spec)
        self.unknown = spec.kinds.index(2)
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(spec.pieces, spec.kinds)) if k == 6}
        normal = [p for p, k in zip(spec.pieces, spec.kinds) if k == 1]
        self.joined = np.zeros((256, 256), bool)  # bytes that stand side by side in a piece; a mark may be a space
        forms = lambda c: [c.encode(), b" "] if c == MARK else [c.encode()]
        for a, b in {(a, b) for p in normal for a, b in zip(p, p[1:])}:
            for x in forms(a):
                for y in forms(b):
                    self.joined[x[-1], y[0]] = True
        self.joined[:, 0x80:0xC0] = True  # inside a character
        self.kept = Kept(KEPT_BYTES)

    # ---- byte fallback ----

    def _emit(self, symbol: str) -> list[int]:
        return [self.bytes[b] for b in symbol.encode()] if self.spec.byte_fallback else [self.unknown]

    # ---- texts ----

    def _ids_of(self, units: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of units, joined, and how many each has."""
        raw, offsets = utf8(units)
        text = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), "<u4").astype(np.int64)
        text[text == 32] = ord(MARK)
        letters = np.append(0, np.cumsum((raw & 0xC0) != 0x80))[offsets]
        begins = np.zeros(len(text), bool)
        begins[letters[:-1][letters[:-1] < letters[1:]]] = True
        fresh, no = np.unique(text, return_inverse=True)
        starts = self.pieces.stretches(text, begins)
        symbols, at, done = [], [], 0
        while done < len(starts):  # whole stretches, about CHARACTERS at a time
            k = max(done + 1, int(np.searchsorted(starts, starts[done] + CHARACTERS)))
            a, b = int(starts[done]), int(starts[k]) if k < len(starts) else len(text)
            got, where = self.pieces.least(text[a:b], starts[done:k] - a, self.pieces.count + no[a:b])
            symbols.append(got)
            at.append(where + a)
            done = k
        symbols, at = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (symbols, at))
        base = self.pieces.count
        used = np.unique(symbols[symbols >= len(self.spec.pieces)])
        names = {int(u): self.pieces.alone[u - len(self.spec.pieces)] if u < base else chr(fresh[u - base]) for u in used}
        parts = [self._emit(names[int(u)]) for u in used]
        sizes, values = np.ones(len(self.spec.pieces) + len(used), np.int64), np.arange(len(self.spec.pieces))
        sizes[len(self.spec.pieces) :] = list(map(len, parts))
        values = np.concatenate([values, *map(np.array, parts)]).astype(np.uint32)
        which = np.where(symbols < len(self.spec.pieces), symbols, len(self.spec.pieces) + np.searchsorted(used, symbols))
        ids, ends = gather(values, sizes, which)
        last = np.searchsorted(at, letters[1:], side="right")  # of a unit's symbols, one behind its last
        bounds = np.append(0, ends)[last]
        return ids, np.diff(np.append(0, bounds))

    def _make(self, units: list[str]) -> list[bytes]:
        ids, sizes = self._ids_of(pa.array(units, pa.string()))
        raw, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(sizes)).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Unsigned 32-bit ids of the texts of a column, joined, and where each text's ids start and end."""
        raw, offsets = self.normaliser.apply(*utf8(column))
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        begins = np.append(True, ~self.joined[raw[:-1], raw[1:]])
        begins[offsets[:-1][offsets[:-1] < len(raw)]] = True
        starts = np.flatnonzero(begins)
        which, units = distinct(raw, starts)
        found = self.kept.find(units.to_pylist(), self._make)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ids, ends = gather(np.frombuffer(b"".join(found), "<u4"), sizes, which)
        bounds = np.append(0, ends)[np.searchsorted(starts, offsets)]
        if self.spec.byte_fallback:
            return ids, bounds
        again = np.append(False, (ids[1:] == self.unknown) & (ids[:-1] == self.unknown))  # the library joins neighbours
        again[bounds[:-1][bounds[:-1] < len(ids)]] = False
        return ids[~again], np.append(0, np.cumsum(~again))[bounds]

    def encode_rows(self, column: pa.Array) -> Iterator[bytes]:
        """Ids of each text of a column as little-endian unsigned 32-bit integers."""
        for a, b in slices(column, SLICE):
            ids, bounds = self.encode_column(column.slice(a, b - a))
            raw = ids.astype("<u4").tobytes()
            yield from (raw[4 * s : 4 * e] for s, e in zip(bounds.tolist(), bounds[1:].tolist()))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The same of a list."""
        return self.encode_rows(pa.array(texts, pa.string()))


class Inverse:
    """The inverse of the byte fallback, the pieces and the normaliser: from ids to text."""

    def __init__(self, spec: Spec):
        spelled = {2: " ⁇ ", 3: ""}
        parts = [bytes([int(p[3:5], 16)]) if k == 6 else spelled.get(k, p.replace(MARK, " ")).encode() for p, k in zip(spec.pieces, spec.kinds)]
        self.values, self.sizes = np.frombuffer(b"".join(parts), np.uint8), np.array(list(map(len, parts)))
        self.dummy_prefix = spec.dummy_prefix

    def decode_column(self, ids: pa.Array) -> pa.Array:
        """The texts of a column of binary ids; null stays null."""
        held = ids.to_pylist()
        sizes = np.array([len(x or b"") // 4 for x in held], np.int64)
        raw, ends = gather(self.values, self.sizes, np.frombuffer(b"".join(x or b"" for x in held), "<u4"))
        bounds = np.append(0, ends)[np.append(0, np.cumsum(sizes))]
        begin, end = bounds[:-1].copy(), bounds[1:]
        if self.dummy_prefix and len(raw):
            begin += (begin < end) & (raw[np.minimum(begin, len(raw) - 1)] == 32)
        data = raw.tobytes()
        found = [data[a:b].decode("utf-8", "replace") for a, b in zip(begin.tolist(), end.tolist())]
        return pa.array([None if x is None else t for t, x in zip(found, held)], pa.string())

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_column(pa.array([ids.astype("<u4").tobytes()], pa.binary()))[0].as_py()


@functools.lru_cache(maxsize=1)
def transducer(path: str) -> Transducer:
    return Transducer(read_model(path))


@functools.lru_cache(maxsize=1)
def inverse(path: str) -> Inverse:
    return Inverse(read_model(path))


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_pieces(
    docs: DataFrame, *, model: str | None = None, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False
) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit) of each whole text; null text is empty and has no ids.

    With ``decoded`` also decoded, the text that decode_pieces makes of the ids, by the same tasks. Null ids stay null,
    repeated rows stay repeated, an empty table gives no rows; other columns aren't read.
    """
    path = model or default_model()
    names = ["doc_id", "ids"] + ["decoded"] * decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, 1, SLICE):
            ids = pa.array(transducer(path).encode_rows(b.column(1)), pa.binary())
            back = [inverse(path).decode_column(ids)] if decoded else []
            yield pa.record_batch([b.column(0), ids, *back], names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, ids binary" + ", decoded string" * decoded
    )


def decode_pieces(ids: DataFrame, *, model: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and text of a column ``ids``; null ids give null."""
    path = model or default_model()
    picked = ids.select(*keep, "ids")
    schema = ", ".join(f"`{c}` {t}" for c, t in picked.dtypes[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                text = inverse(path).decode_column(part.column(len(keep)))
                yield pa.record_batch([*part.columns[: len(keep)], text], names=[*keep, "text"])

    return picked.mapInArrow(run, f"{schema}, text string")


def op2_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32, and of the text decoded from the ids n_bytes and text_sha256, for every document.

    Null text is empty; null ids are kept, repeated rows stay repeated, an empty table has no rows.
    """
    return encode_pieces(table(spark, sf_dir, "documents"), decoded=True).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_ids"),
        F.crc32("ids").alias("ids_crc32"),
        F.octet_length("decoded").cast("long").alias("n_bytes"),
        F.sha2("decoded", 256).alias("text_sha256"),
    )
