"""Language identification: averaged hashed subword embeddings under a linear softmax, trained by SGD in numpy.

A word (run of letters, A-Z lower-cased, with marks at both ends) has its byte n-grams of 2 to 5 hashed into BUCKETS
rows of an embedding table; a text is the mean over its words of the mean of their subwords' rows. Since the layer
above is linear, the trained model is one table of class logits for each bucket, which is all that is sent to workers.

Training takes at most SAMPLE labelled texts, the ones with the smallest hash of their key (a bounded, documented
sample; of rows of one key the smallest by label and text). They go to the driver as they are if they are shorter than their
bags of buckets can be, else as bags, so its memory is bounded however long they are. One in HOLD of them is set aside to calibrate: a temperature that gives the best likelihood there, and the
least confidence at which the accepted ones are right often enough (PRECISION). Predictions under it are marked
``accepted = false``; the label is given all the same. Every text is read whole.

Defined cases: a null text, or one without any letter, is ``und`` with score 0 and not accepted; with no labelled rows
every text is ``und``; null labels aren't learned from; repeated rows are predicted alike; ties between languages go
to the first in alphabetical order; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portcullis.llm.common import sample

BUCKETS, DIMENSION, GRAMS = 1 << 15, 16, (2, 3, 4, 5)
SAMPLE, HOLD, EPOCHS, BATCH, RATE = 3000, 5, 6, 32, 40.0
PRECISION = 0.995
#: Code points of a text that goes to the driver; about the bytes of the largest bag.
LONG = 8 * BUCKETS
#: Words whose logits a worker keeps at once.
KEPT = 200_000
UNKNOWN = "und"

_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_MAY_BE_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _MAY_BE_LETTER.finditer(text))


def words(text: str) -> list[bytes]:
    return text.encode().translate(_LETTERS).split()


def subwords(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all n-grams of the words, and the n + 1 offsets of words in them."""
    marked = b"".join(b"<" + w + b">" for w in found)
    x = np.frombuffer(marked, np.uint8).astype(np.uint64)
    length = np.fromiter(map(len, found), np.int64, len(found)) + 2
    start = np.cumsum(length) - length
    end_of = np.repeat(start + length, length)
    at = np.arange(len(x))
    code = np.zeros(len(x), np.uint64)
    ids, owner = [], []
    of = np.repeat(np.arange(len(found)), length)
    for n in range(1, max(GRAMS) + 1):
        code = code[: len(x) - n + 1] * np.uint64(257) + x[n - 1 :] + np.uint64(1)
        if n in GRAMS and len(code):
            ok = at[: len(code)] + n <= end_of[: len(code)]
            h = (code[ok] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            ids.append((h >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32))
            owner.append(of[: len(code)][ok])
    ids, owner = np.concatenate(ids), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    offsets = np.zeros(len(found) + 1, np.int64)
    np.cumsum(np.bincount(owner, minlength=len(found)), out=offsets[1:])
    return ids[order], offsets


@dataclass
class Model:
    labels: list[str]
    logits: np.ndarray  # BUCKETS x labels
    bias: np.ndarray
    temperature: float
    least: float


def _bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and their weights, which sum to 1."""
    counts = Counter(words(text))
    if not counts:
        return np.zeros(0, np.int32), np.zeros(0)
    ids, offsets = subwords(list(counts))
    size = np.diff(offsets)
    n = np.fromiter(counts.values(), np.float64, len(counts))
    weight = np.repeat(n / (n.sum() * size), size)
    at, inverse = np.unique(ids, return_inverse=True)
    return at, np.bincount(inverse, weight)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(texts: list[str], labels: list[str], seed: int = 7) -> Model:
    return train_bags([_bag(t) for t in texts], labels, seed)


def train_bags(bags: list[tuple[np.ndarray, np.ndarray]], labels: list[str], seed: int = 7) -> Model:
    """bags: of each text its buckets and their weights."""
    names = sorted(set(labels))
    y = np.array([names.index(x) for x in labels], np.int64)
    usable = [i for i, b in enumerate(bags) if len(b[0])]
    held = [i for k, i in enumerate(usable) if k % HOLD == HOLD - 1]
    own = [i for k, i in enumerate(usable) if k % HOLD != HOLD - 1]
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.1, (BUCKETS, DIMENSION))
    w, b = rng.normal(0, 0.3, (DIMENSION, len(names))), np.zeros(len(names))
    steps, done = max(1, EPOCHS * -(-len(own) // BATCH)), 0
    for _ in range(EPOCHS):
        for rows in np.array_split(rng.permutation(own), max(1, -(-len(own) // BATCH))):
            if not len(rows):
                continue
            at, inverse = np.unique(np.concatenate([bags[i][0] for i in rows]), return_inverse=True)
            a = np.zeros((len(rows), len(at)))
            a[np.repeat(np.arange(len(rows)), [len(bags[i][0]) for i in rows]), inverse] = np.concatenate([bags[i][1] for i in rows])
            h = a @ e[at]
            g = _softmax(h @ w + b)
            g[np.arange(len(rows)), y[rows]] -= 1
            g /= len(rows)
            rate = RATE * (1 - done / steps)
            back = a.T @ (g @ w.T)
            w -= rate / 20 * (h.T @ g)
            b -= rate / 40 * g.sum(0)
            e[at] -= rate * back
            done += 1
    logits = e @ w
    model = Model(names, logits.astype(np.float32), b, 1.0, 0.0)
    if held:
        z = np.array([bags[i][1] @ logits[bags[i][0]] + b for i in held])
        loss = lambda t: -np.log(_softmax(z / t)[np.arange(len(held)), y[held]] + 1e-12).mean()
        model.temperature = min((0.1 * 1.15**k for k in range(40)), key=loss)
        p = _softmax(z / model.temperature)
        best, right = p.max(1), p.argmax(1) == y[held]
        order = np.argsort(-best, kind="stable")
        share = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
        good = np.flatnonzero(share >= PRECISION)
        model.least = float(best[order][good[-1]]) if len(good) else 1.0
    return model


class Predictor:
    """Keeps the logits of words it has met."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.table = np.zeros((1024, len(self.model.labels)), np.float32)

    def learn(self, new: list[bytes]) -> None:
        if len(self.index) + len(new) > KEPT and self.index:
            self.clear()
        ids, offsets = subwords(new)
        n = len(self.index)
        if n + len(new) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros((max(len(self.table), n + len(new)), self.table.shape[1]), np.float32)])
        self.table[n : n + len(new)] = np.add.reduceat(self.model.logits[ids], offsets[:-1], 0) / np.diff(offsets)[:, None]
        self.index.update(zip(new, range(n, n + len(new)), strict=True))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        m, out = self.model, []
        split = [words(t) if t and m.labels and has_letter(t) else [] for t in texts]
        for at in range(0, len(split), 256):  # so many texts' new words are learned at once
            group = split[at : at + 256]
            if new := {w for s in group for w in s}.difference(self.index):
                self.learn(list(new) if len(self.index) + len(new) <= KEPT else list({w for s in group for w in s}))
            get = self.index.__getitem__
            for s in group:
                if not s:
                    out.append((UNKNOWN, 0.0, False))
                    continue
                z = self.table[np.fromiter(map(get, s), np.int64, len(s))].mean(0, dtype=np.float64) + m.bias
                p = _softmax(z[None] / m.temperature)[0]
                k = int(p.argmax())
                out.append((m.labels[k], float(p[k]), bool(p[k] >= m.least)))
        return out


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang") -> Model:
    """labelled: rows to learn from. Of their keys the SAMPLE with the smallest hashes are taken to the driver, one row of each."""
    rows = labelled.select(F.col(key).alias("key"), F.col(text).alias("t"), F.col(label).alias("y")).where("t is not null and y is not null")
    ids = sample(rows.select(F.col("key").alias("k")).distinct(), "k", SAMPLE)
    chosen = rows.join(F.broadcast(ids), F.col("key") == F.col("k"), "left_semi")
    once = chosen.groupBy("key").agg(F.min(F.struct("y", "t")).alias("one")).select(F.xxhash64(F.col("key").cast("string")).alias("h"), "one.y", "one.t")
    found = once.mapInArrow(_compact, "h long, y string, t string, at array<int>, weight array<double>").collect()  # at most SAMPLE rows
    found.sort(key=lambda r: (r["h"], r["y"]))
    bags = [_bag(r["t"]) if r["at"] is None else (np.array(r["at"], np.int32), np.array(r["weight"])) for r in found]
    return train_bags(bags, [r["y"] for r in found])


def _compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Long texts as their bags."""
    for b in batches:
        for i in range(b.num_rows):
            h, y, t = (b.column(c)[i].as_py() for c in ("h", "y", "t"))
            at, weight = (None, None) if len(t) <= LONG else (x.tolist() for x in _bag(t))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((h, y, t if at is None else None, at, weight), kinds, strict=True)], names=["h", "y", "t", "at", "weight"])


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score and accepted of every row of docs."""
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [key, "lang_pred", "score", "accepted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(shared.value)
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                rows = predictor.predict(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("key"), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.float64(), pa.bool_()), strict=True))], names=names)

    return source.mapInArrow(run, f"{key} {source.schema['key'].dataType.simpleString()}, lang_pred string, score double, accepted boolean")
