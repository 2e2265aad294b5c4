"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting passes over the features in turn; at each, a shallow tree on the feature's histogram of gradients
corrects that feature's lookup table a little. Pairs of features with the most left to explain get tables of two
dimensions in the same way. A score is the sum of one bin of each table through the logistic function.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import table
from tidemark.llm.tokens import parts

#: Most labelled rows that a model is fitted on; those with the smallest hash of their id.
FIT_ROWS = 20_000
THRESHOLD = 0.3

FEATURES = [
    "bytes", "words", "word_bytes", "longest_word", "upper", "digit", "exclaim", "comma_stop", "symbol",
    "bar", "non_ascii", "distinct_words", "top_word", "repeats", "line_words", "distinct_lines", "one_byte_words",
]

_CLASSES = np.zeros((256, 7))
for _k, _chars in enumerate(
    (
        "".join(map(chr, range(65, 91))),
        "0123456789",
        "!",
        ",.;:?",
        "#$%&*<>{}[]\\^~_=+@/",
        "|",
        "".join(map(chr, range(128, 256))),
    )
):
    _CLASSES[[ord(c) for c in _chars], _k] = 1


def features(text: str) -> list[float]:
    """The values of FEATURES; all 0 for a text without a byte. They are counts and single quotients of counts, which every
    processor gives alike to the last bit."""
    raw = text.encode()
    n = max(1, len(raw))
    share = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASSES / n
    words = raw.split()
    k = max(1, len(words))
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x]
    sizes = list(map(len, words))
    return [
        len(raw), len(words), sum(sizes) / k, max(sizes, default=0), *share,
        len(counts) / k, max(counts.values(), default=0) / k, sum(map(bytes.__eq__, words, words[1:])) / k,
        len(words) / max(1, len(lines)), len(set(lines)) / max(1, len(lines)), sizes.count(1) / k,
    ]


def feature_rows(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` and ``values``, the features of each whole text; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, len(keep)):
            values = [features(t or "") for t in b.column(len(keep)).to_pylist()]
            yield pa.record_batch(
                [*b.columns[: len(keep)], pa.array(values, pa.list_(pa.float64()))], names=[*keep, "values"]
            )

    picked = docs.select(*keep, F.col(text_col).alias("__tm_text"))
    schema = ", ".join(f"`{c}` {t}" for c, t in picked.dtypes[:-1])
    return picked.mapInArrow(run, f"{schema}, values array<double>")


@dataclass
class Model:
    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)])

    def score(self, x: np.ndarray) -> np.ndarray:
        """The chance of label 1 for each row of features."""
        b = self.bins(x)
        z = np.full(len(x), self.base)
        for t, i in zip(self.tables, b):
            z += t[i]
        for t, (i, j) in zip(self.pair_tables, self.pairs):
            z += t[b[i], b[j]]
        return 1 / (1 + np.exp(-z))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    """Edges halfway between values next to each other, at the quantiles: no value that was fitted on stands on an edge."""
    values = np.unique(x)
    at = np.searchsorted(values, np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))
    at = np.unique(at[at > 0])
    return (values[at - 1] + values[at]) / 2


def _gain(g, h, reg):
    return g * g / (h + reg)


def _split(g: np.ndarray, h: np.ndarray, reg: float) -> tuple[float, int]:
    """The best cut of a histogram in two, with what it gains."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(left_g):
        return 0.0, 0
    gain = _gain(left_g, left_h, reg) + _gain(g.sum() - left_g, h.sum() - left_h, reg) - _gain(g.sum(), h.sum(), reg)
    k = int(gain.argmax())
    return float(gain[k]), k + 1


def _tree(g: np.ndarray, h: np.ndarray, reg: float) -> np.ndarray:
    """What a tree of depth two gives each bin."""
    out = np.zeros(len(g))
    gain, cut = _split(g, h, reg)
    parts = [(0, cut), (cut, len(g))] if gain > 1e-9 else [(0, len(g))]
    for a, b in parts:
        gain, cut = _split(g[a:b], h[a:b], reg) if len(parts) > 1 else (0.0, 0)
        for c, d in [(a, a + cut), (a + cut, b)] if gain > 1e-9 else [(a, b)]:
            out[c:d] = g[c:d].sum() / (h[c:d].sum() + reg)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, reg: float) -> tuple[float, np.ndarray]:
    """Of the trees that cut one feature and then each side by the other, the best; with what it gains."""
    best = (-1.0, np.zeros_like(g))
    for turn in (False, True):
        a, b = (g.T, h.T) if turn else (g, h)
        _, cut = _split(a.sum(1), b.sum(1), reg)
        out, gain = np.zeros_like(a), -_gain(a.sum(), b.sum(), reg)
        for rows in (slice(0, cut), slice(cut, len(a))):
            x, y = a[rows].sum(0), b[rows].sum(0)
            _, c = _split(x, y, reg)
            for cols in (slice(0, c), slice(c, len(x))):
                value = x[cols].sum() / (y[cols].sum() + reg)
                out[rows, cols] = value
                gain += _gain(x[cols].sum(), y[cols].sum(), reg)
        if gain > best[0]:
            best = (float(gain), out.T if turn else out)
    return best


def fit(
    x: np.ndarray, y: np.ndarray, *, bins: int = 24, rounds: int = 60, pairs: int = 5, rate: float = 0.2, reg: float = 5.0
) -> Model:
    """Fit on rows of features and labels 0 and 1. With no rows, or labels all alike, the tables are empty or flat."""
    count = x.shape[1] if x.size else len(FEATURES)
    y = np.asarray(y, float)
    if not len(y):
        return Model(0.0, [np.zeros(0)] * count, [np.zeros(1)] * count)
    edges = [_edges(x[:, j], bins) for j in range(count)]
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    m = Model(float(np.log(share / (1 - share))), edges, [np.zeros(len(e) + 1) for e in edges])
    b = m.bins(x)
    z = np.full(len(y), m.base)
    chance = lambda: 1 / (1 + np.exp(-z))
    for _ in range(rounds):
        for j, t in enumerate(m.tables):
            p = chance()
            step = rate * _tree(np.bincount(b[j], y - p, len(t)), np.bincount(b[j], p * (1 - p), len(t)), reg)
            t += step
            z += step[b[j]]

    def grids(i: int, j: int, p: np.ndarray) -> list[np.ndarray]:
        shape = len(m.tables[i]), len(m.tables[j])
        at = b[i] * shape[1] + b[j]
        return [np.bincount(at, w, shape[0] * shape[1]).reshape(shape) for w in (y - p, p * (1 - p))]

    p = chance()
    ranked = sorted(
        ((_pair_tree(*grids(i, j, p), reg)[0], i, j) for i in range(count) for j in range(i)), reverse=True
    )
    m.pairs = [(i, j) for _, i, j in ranked[:pairs]]
    m.pair_tables = [np.zeros((len(m.tables[i]), len(m.tables[j]))) for i, j in m.pairs]
    for _ in range(rounds // 2):
        for t, (i, j) in zip(m.pair_tables, m.pairs):
            step = rate * _pair_tree(*grids(i, j, chance()), reg)[1]
            t += step
            z += step[b[i], b[j]]
    return m


def remainder(id_col: str = "doc_id"):
    """crc32 of the id as text modulo 5; 0 marks rows that no model is fitted on. A null id has none."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def train(
    docs: DataFrame, labels: DataFrame, *, max_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text"
) -> Model:
    """Fit on labelled documents, held-out ids left out.

    Of the labelled ids the ``max_rows`` with the smallest hash are taken; that bound is what is sent to all tasks
    and comes back to the driver, whatever the size of the corpus and however often an id occurs. Null ids and null labels
    are left out; an id labelled twice, or a document that occurs twice, counts each time within the bound.
    """
    sample = (
        labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull() & (remainder(id_col) != 0))
        .select(F.col(id_col).alias("__tm_id"), F.col("quality").cast("int").alias("__tm_label"))
        .orderBy(F.xxhash64("__tm_id"), "__tm_id", "__tm_label")
        .limit(max_rows)
    )
    picked = docs.select(F.col(id_col).alias("__tm_id"), F.col(text_col).alias("__tm_txt")).join(F.broadcast(sample), "__tm_id")
    order = [F.xxhash64("__tm_id"), "__tm_id", "__tm_label", "values"]
    rows = feature_rows(picked, ["__tm_id", "__tm_label"], "__tm_txt").orderBy(*order).limit(max_rows).toArrow()
    y = rows.column("__tm_label").to_numpy()
    return fit(np.array(rows.column("values").to_pylist(), float).reshape(-1, len(FEATURES)), y)


def score(docs: DataFrame, model: Model, *, keep: list[str], text_col: str = "text", name: str = "score") -> DataFrame:
    """The columns ``keep`` and the score of every whole text, 0 to 1; null and empty texts are scored as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, len(keep)):
            texts = b.column(len(keep)).to_pylist()
            got = shared.value.score(np.array([features(t or "") for t in texts], float).reshape(-1, len(FEATURES)))
            yield pa.record_batch([*b.columns[: len(keep)], pa.array(got, pa.float64())], names=[*keep, name])

    picked = docs.select(*keep, F.col(text_col).alias("__tm_text"))
    schema = ", ".join(f"`{c}` {t}" for c, t in picked.dtypes[:-1])
    return picked.mapInArrow(run, f"{schema}, `{name}` double")


def op10_quality(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, by a model fitted on labelled ids that aren't held out.

    Null text is scored as empty; a null id is scored and not held out; repeated rows stay repeated; no rows give none.
    """
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model, keep=["doc_id"]).select(
        "doc_id",
        F.coalesce(remainder() == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold, with their columns."""
    return score(docs, train(docs, labels), keep=docs.columns, name="__tm_score").where(f"__tm_score >= {threshold}").drop("__tm_score")
