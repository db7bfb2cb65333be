"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is put into one of at most BINS quantile bins. Boosting goes round the features cyclically: in
each round a shallow tree (at most LEAVES leaves over the ordered bins of one feature) is fitted to the gradient of
the logistic loss, and its small step is added to that feature's lookup table. Then the PAIRS pairs of features whose
four-quadrant trees lower the remaining loss most get tables of their own, boosted in the same cyclic way. A text's
score is the sigmoid of the intercept plus one table entry for each feature and pair: vectorised bin additions.

Features are computed from the whole text alone. Training takes at most SAMPLE labelled rows, the ones with the
smallest hash of their key (a bounded, documented sample), and only their features go to the driver; of rows of the same key
those with the smallest features are learned from, so a key that repeats counts once whatever the order of rows.

Defined cases: null text counts as empty and is scored like any text; keys with several labels count once for each
distinct label; null labels and null keys aren't learned from; without labels of both kinds every score is the share
of label 1 (0.5 without any); repeated rows are scored alike; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portcullis.llm.common import sample

SAMPLE, BINS, PAIR_BINS, LEAVES, PAIRS = 20_000, 48, 8, 3, 6
ROUNDS, PAIR_ROUNDS, RATE, RIDGE = 120, 60, 0.1, 2.0
#: A text whose score is at least this is good.
THRESHOLD = 0.3

FEATURES = (
    "log_length", "log_words", "mean_word", "long_words", "short_words", "letters", "upper", "digits", "spaces", "lines",
    "full_stops", "commas", "brackets", "symbols", "bars", "bangs", "high_bytes", "distinct_words", "top_word",
    "repeated_next", "distinct_lines", "top_line_share", "byte_entropy",
)


def _bytes(chars: str) -> np.ndarray:
    m = np.zeros(256)
    m[list(chars.encode())] = 1
    return m


_CLASSES = np.array([
    _bytes("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"), _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _bytes("0123456789"), _bytes(" \t"), _bytes("\n"),
    _bytes(".?;:"), _bytes(","), _bytes("()[]{}<>"), _bytes("#$%&*@^~=+\\/_`\"'"), _bytes("|"), _bytes("!"),
]).T


def features(text: str | None) -> list[float]:
    b = (text or "").encode()
    n = len(b)
    if not n:
        return [0.0] * len(FEATURES)
    histogram = np.bincount(np.frombuffer(b, np.uint8), minlength=256)
    shares = histogram @ _CLASSES / n
    p = histogram[histogram > 0] / n
    found = b.split()
    k = max(1, len(found))
    counts = Counter(found)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    lines = [x for x in b.split(b"\n") if x.strip()]
    line_counts = Counter(lines)
    top_line = max((len(x) * c for x, c in line_counts.items() if c > 1), default=0)
    repeated = sum(map(bytes.__eq__, found[:-1], found[1:]))
    return [
        np.log1p(n), np.log1p(len(found)), float(lengths.mean()) if len(found) else 0.0, float((lengths > 9).mean()) if len(found) else 0.0, float((lengths < 4).mean()) if len(found) else 0.0,
        *shares[:11].tolist(), float(histogram[128:].sum() / n), len(counts) / k, max(counts.values(), default=0) / k,
        repeated / k, len(line_counts) / max(1, len(lines)), top_line / n, float(-(p * np.log(p)).sum()),
    ]


@dataclass
class Model:
    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for j, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += t[np.searchsorted(e, x[:, j], "right")]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            z += t[np.searchsorted(self.pair_edges[i], x[:, i], "right"), np.searchsorted(self.pair_edges[j], x[:, j], "right")]
        return _sigmoid(z)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins))


def _gain(g, h):
    return g * g / (h + RIDGE)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The steps of a tree with at most LEAVES leaves over ordered bins with gradient sums g and curvature sums h."""
    leaves = [(0, len(g))]
    while len(leaves) < LEAVES:
        best = None
        for at, (a, b) in enumerate(leaves):
            if b - a < 2:
                continue
            gl, hl = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
            gs, hs = g[a:b].sum(), h[a:b].sum()
            gain = _gain(gl, hl) + _gain(gs - gl, hs - hl) - _gain(gs, hs)
            k = int(gain.argmax())
            if gain[k] > 1e-9 and (best is None or gain[k] > best[0]):
                best = (gain[k], at, a, a + k + 1, b)
        if best is None:
            break
        _, at, a, m, b = best
        leaves[at : at + 1] = [(a, m), (m, b)]
    out = np.zeros(len(g))
    for a, b in leaves:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best tree of one cut on either axis over a grid: its gain and its steps."""
    def corners(x: np.ndarray) -> list[np.ndarray]:
        c = x.cumsum(0).cumsum(1)
        a, top, left, all_ = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1], c[-1, -1]
        return [a, top - a, left - a, all_ - top - left + a]

    if min(g.shape) < 2:
        return 0.0, np.zeros_like(g)
    gs, hs = corners(g), corners(h)
    gain = sum(_gain(a, b) for a, b in zip(gs, hs, strict=True)) - _gain(g.sum(), h.sum())
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.zeros_like(g)
    for (rows, columns), a, b in zip(itertools.product((slice(0, i + 1), slice(i + 1, None)), (slice(0, j + 1), slice(j + 1, None))), gs, hs, strict=True):
        out[rows, columns] = a[i, j] / (b[i, j] + RIDGE)
    return float(gain[i, j]), out


def train(x: np.ndarray, y: np.ndarray) -> Model:
    """x: rows of features; y: 0 or 1."""
    share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if len(y) else 0.5
    model = Model(float(np.log(share / (1 - share))))
    if not 0 < (y.sum() if len(y) else 0) < len(y):
        return model
    model.edges = [_edges(x[:, j], BINS) for j in range(x.shape[1])]
    model.pair_edges = [_edges(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
    bins = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.edges)]
    coarse = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.pair_edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    z = np.full(len(y), model.intercept)
    for _ in range(ROUNDS):
        for b, t in zip(bins, model.tables, strict=True):
            p = _sigmoid(z)
            step = RATE * _tree(np.bincount(b, y - p, len(t)), np.bincount(b, p * (1 - p), len(t)))
            t += step
            z += step[b]

    def grid(i: int, j: int) -> tuple[np.ndarray, tuple[int, int]]:
        shape = (len(model.pair_edges[i]) + 1, len(model.pair_edges[j]) + 1)
        return coarse[i] * shape[1] + coarse[j], shape

    def sums(at: np.ndarray, shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        p = _sigmoid(z)
        n = shape[0] * shape[1]
        return np.bincount(at, y - p, n).reshape(shape), np.bincount(at, p * (1 - p), n).reshape(shape)

    gains = sorted(((_quadrants(*sums(*grid(i, j)))[0], i, j) for i, j in itertools.combinations(range(x.shape[1]), 2)), reverse=True)
    model.pairs = [(i, j) for gain, i, j in gains[:PAIRS] if gain > 0]
    model.pair_tables = [np.zeros(grid(i, j)[1]) for i, j in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (i, j), t in zip(model.pairs, model.pair_tables, strict=True):
            at, shape = grid(i, j)
            step = RATE * _quadrants(*sums(at, shape))[1]
            t += step
            z += step.ravel()[at]
    return model


def _featured(docs: DataFrame, key: str, text: str) -> DataFrame:
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = pa.array([features(t.as_py()) for t in b.column("text")], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column("key"), x], names=["key", "x"])

    return source.mapInArrow(run, f"key {source.schema['key'].dataType.simpleString()}, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """labels: key and label of the rows to learn from."""
    known = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where("y in (0, 1) and k is not null").distinct()
    chosen = sample(known, "k", SAMPLE)
    own = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    rows = own.join(F.broadcast(chosen.select("k").distinct()), F.col("key") == F.col("k"), "left_semi")
    once = _featured(rows, "key", "text").groupBy("key").agg(F.min("x").alias("x"))
    found = once.join(F.broadcast(chosen), F.col("key") == F.col("k")).select("k", "y", "x").collect()  # at most SAMPLE rows
    found.sort(key=lambda r: (r["k"], r["y"], r["x"]))
    x = np.array([r["x"] for r in found]).reshape(-1, len(FEATURES))
    return train(x, np.array([r["y"] for r in found], np.float64))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score (double) and predicted (int) of every row of docs."""
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = shared.value.score(np.array([features(t.as_py()) for t in b.column("text")]))
                yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=[key, "score", "predicted"])

    return source.mapInArrow(run, f"{key} {source.schema['key'].dataType.simpleString()}, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of docs that the model doesn't reject, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = shared.value.score(np.array([features(t.as_py()) for t in b.column(text)]))
                yield b.filter(pa.array(s >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
