"""Language-model scoring with Brown class-based bigrams.

Tokens are the words of a text between ASCII white space (A-Z lower-cased), then one end token. Over all training texts:

1. Words are counted (combined in each task, then by a shuffle). N tokens, V distinct ones. Words with at least
   N / 2**HEAD_BITS occurrences are the head, at most 2**HEAD_BITS words whatever the input, and are broadcast.
2. Units are the head words, one unit for all other words and the end token. Classes are those of head words (``classes``; by default they grow
   with the head, from CLASSES to MOST_CLASSES), one for other words and one for the end.
3. The neighbours of every unit are counted over all texts: each task combines its own, a shuffle by unit adds them up to one row for
   each unit with one entry for each neighbour, and that is written. Exchange clustering starts with the SEEDS most frequent words, the
   other head words counted as other words: each moves to the class that most raises the likelihood of the class bigrams, until a
   sweep moves none. Then in rounds all head words move at once to the class whose neighbours are most like theirs, until the likelihood
   rises by less than STANDS a token, or ROUNDS are over; a round that lowers it is undone.
4. Every word that isn't in the head has a class too. One more pass over the texts counts the classes before and after its places, at most
   two for each class, combined like the neighbours; it gets the class of head words whose neighbours are most like its own. Other words
   of one such class are a class of their own, its twin, as they are smoothed differently.
5. P(text) is the product over tokens of P(class | previous) P(word | class). previous is the class of the token before if that is
   a head word or the end, else "other word". Transitions are smoothed by ALPHA; a head word has its share of its class; another word with
   count c has (c + 1) / (class tokens + distinct words of the class + 1) in its twin. A word that was never met has the sum of what all twins
   leave for such words.

Every text is scored whole. Head words are looked up in the worker. The other words of a text, none of which can be
frequent, are joined with their counts and classes by a shuffle, and the sums by text by another: exact for the whole vocabulary.

Defined cases: null text counts as empty (the end token alone); repeated rows are scored alike, each as a row; a null key
is in the fold of the empty string; ties in counts are ordered by word; with no training texts N = V = 0 and every
token is unknown; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portcullis.llm.common import ROW, checkpointed, with_row

HEAD_BITS, SEEDS, SWEEPS, ROUNDS, ALPHA = 20, 512, 8, 12, 0.5
#: Classes of head words: at least, and at most; between them the head's size to the power of 0.4.
CLASSES, MOST_CLASSES = 64, 256
#: Gain in likelihood (nats a token) below which it counts as standing still.
STANDS = 0.005
#: Head words at most; the unit of all other words, and that of the end.
CLUSTERED = 1 << HEAD_BITS
OTHER, END_UNIT, N_UNITS = CLUSTERED, CLUSTERED + 1, CLUSTERED + 2
#: Distinct words that a task counts before it passes them on, and texts that are scored at once.
FLUSH, TEXTS = 1_000_000, 512
#: Bigrams that a task combines before it passes them on.
PAIRS = 4_000_000

END = b""  # no word is empty


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[bytes] = Counter()

    def out() -> pa.RecordBatch:
        b = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
        counts.clear()
        return b

    for b in batches:
        for t in b.column("text"):
            counts.update(words(t.as_py()))
        counts[END] += b.num_rows
        if len(counts) >= FLUSH:
            yield out()
    if counts:
        yield out()


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """word (binary, END too) and n (long) over all rows of docs."""
    return docs.select(F.col(text).alias("text")).mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


#: Bits of a unit in a pair; a neighbour before the word has the bit above them set.
UNIT_BITS = 21
MASK = (1 << UNIT_BITS) - 1


def small(units: np.ndarray, seeds: int) -> np.ndarray:
    """Which units are seeds, OTHER or the end."""
    return (units < seeds) | (units >= CLUSTERED)


def small_number(units: np.ndarray) -> np.ndarray:
    """Small units from 0: SEEDS seeds, OTHER, the end."""
    return np.where(units < SEEDS, units, units - CLUSTERED + SEEDS)


N_SMALL = SEEDS + 2


def _bigrams(batches: Iterator[pa.RecordBatch], units: dict[bytes, int]) -> Iterator[np.ndarray]:
    """The units of some texts at a time, with the end before, between and after them. units: of head words and END; all others are OTHER."""
    for b in batches:
        for at in range(0, b.num_rows, TEXTS):
            flat = [END]
            for t in b.column("text").slice(at, TEXTS):
                flat += words(t.as_py())
                flat.append(END)
            yield np.fromiter(map(units.get, flat, repeat(OTHER)), np.int64, len(flat))


def unit_bigrams(found: DataFrame, head: list[bytes]) -> np.ndarray:
    """How often small unit j follows small unit i, head words that are no seeds counted as OTHER; the end token also stands before
    each text. N_SMALL x N_SMALL, from the neighbours of all units."""
    seeds = min(len(head), SEEDS)
    of = np.zeros(N_UNITS, np.int64)
    of[:seeds], of[CLUSTERED:] = np.arange(seeds), np.arange(SEEDS, N_SMALL)
    of[seeds : len(head)] = SEEDS
    shared = found.sparkSession.sparkContext.broadcast(of.astype(np.int16))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        total = np.zeros(N_SMALL * N_SMALL)
        for b in batches:
            _, word, other, before, n = _entries(b)
            a, c = of[word].astype(np.int64), of[other].astype(np.int64)
            once = ~before | small(other, seeds)  # a pair of two other words is in the rows of both
            pair = np.where(before, c * N_SMALL + a, a * N_SMALL + c)
            total += np.bincount(pair[once], n[once], len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at].astype(np.int64))], names=["pair", "n"])

    return _summed(found.mapInArrow(run, "pair int, n long"), N_SMALL * N_SMALL).reshape(N_SMALL, N_SMALL)


def _summed(parts: DataFrame, size: int) -> np.ndarray:
    found = parts.groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size)
    out[found["pair"].to_numpy(np.int64)] = found["n"].to_numpy(np.float64)
    return out


def _rows(key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sorted keys (word << SLOT_BITS | neighbour) with their counts as rows: word, and e with neighbour << 32 | count."""
    word, entry = key >> SLOT_BITS, (key & (1 << SLOT_BITS) - 1) << 32 | n
    starts = np.flatnonzero(np.diff(word, prepend=-1))
    stops = np.append(starts[1:], len(word))
    for at in range(0, len(starts), 20_000):
        first, last = starts[at : at + 20_000], stops[at : at + 20_000]
        offsets = np.append(first, last[-1]) - first[0]
        e = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(entry[first[0] : last[-1]]))
        yield pa.RecordBatch.from_arrays([pa.array(word[first].astype(np.int32)), e], names=["word", "e"])


#: Bits of a neighbour: its unit, and whether it stands before the word.
SLOT_BITS = UNIT_BITS + 1


def _added(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the sums of their counts."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return key[first], np.add.reduceat(n[order], first) if len(first) else n


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (word, e) in order of words: one row for each word, with one entry for each neighbour."""
    key, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for b in batches:
        e = b.column("e")
        flat = e.flatten().to_numpy()
        own = np.repeat(b.column("word").to_numpy().astype(np.int64), e.value_lengths().to_numpy()) << SLOT_BITS | flat >> 32
        key, n = _added(np.concatenate([key, own]), np.concatenate([n, flat & 0xFFFFFFFF]))
        whole = int(np.searchsorted(key, key[-1] >> SLOT_BITS << SLOT_BITS)) if len(key) else 0  # the last word may go on
        if whole:
            yield from _rows(key[:whole], n[:whole])
            key, n = key[whole:], n[whole:]
    if len(key):
        yield from _rows(key, n)


def neighbours(docs: DataFrame, head: list[bytes], text: str = "text") -> DataFrame:
    """word (unit) and e, its neighbours with counts, as neighbour << 32 | count: one row for each word and one entry for each neighbour, so a
    row's length doesn't grow with the texts.

    Head words beyond the seeds have all their neighbours. Small units, which are next to very many, have those after them
    that are small; the others are in the rows of the head words."""
    shared, seeds = docs.sparkSession.sparkContext.broadcast(head), min(len(head), SEEDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = {w: i for i, w in enumerate(shared.value)} | {END: END_UNIT}
        close = np.zeros(N_SMALL * N_SMALL, np.int64)  # of small units, over the whole task
        pairs, held = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            key, n = np.unique(np.concatenate(pairs), return_counts=True)
            pairs.clear()
            left, right = key >> UNIT_BITS, key & MASK
            a, c = small(left, seeds), small(right, seeds)
            np.add.at(close, small_number(left[a & c]) * N_SMALL + small_number(right[a & c]), n[a & c])
            after, before = left[~a] << SLOT_BITS | right[~a], right[~c] << SLOT_BITS | 1 << UNIT_BITS | left[~c]
            yield from _rows(*_added(np.concatenate([after, before]), np.concatenate([n[~a], n[~c]])))

        for u in _bigrams(batches, units):
            pairs.append(u[:-1] << UNIT_BITS | u[1:])
            held += len(u)
            if held >= PAIRS:
                yield from out()
                held = 0
        if pairs:
            yield from out()
        at = np.flatnonzero(close)
        unit = lambda number: np.where(number < SEEDS, number, number - SEEDS + CLUSTERED)
        yield from _rows(unit(at // N_SMALL) << SLOT_BITS | unit(at % N_SMALL), close[at])

    parts = docs.select(F.col(text).alias("text")).mapInArrow(run, "word int, e array<long>")
    return checkpointed(parts.repartition("word").sortWithinPartitions("word").mapInArrow(_merged, "word int, e array<long>"))


def _entries(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Row, word, neighbour, whether it stands before the word, and count, of all entries of a batch of neighbours."""
    e = b.column("e")
    row = np.repeat(np.arange(b.num_rows), e.value_lengths().to_numpy())
    flat = e.flatten().to_numpy()
    other = flat >> 32
    return row, b.column("word").to_numpy()[row], other & MASK, other > MASK, flat & 0xFFFFFFFF


def class_bigrams(found: DataFrame, of: np.ndarray, k: int, seeds: int) -> tuple[np.ndarray, np.ndarray]:
    """The bigrams of classes, and for each small unit the classes after it (first k columns) and before it."""
    shared = found.sparkSession.sparkContext.broadcast(of.astype(np.int16))
    size = k * k + N_SMALL * 2 * k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        total = np.zeros(size)
        for b in batches:
            _, word, other, before, n = _entries(b)
            a, c, s = of[word].astype(np.int64), of[other].astype(np.int64), small(other, seeds)
            near = k * k + small_number(other) * 2 * k + a
            own = ~before & small(word, seeds)
            for at, which in ((a * k + c, ~before), (c * k + a, before & s), (near, before & s), (near + k, ~before & s), (k * k + small_number(word) * 2 * k + c, own)):
                total += np.bincount(at[which], n[which], size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at].astype(np.int64))], names=["pair", "n"])

    total = _summed(found.mapInArrow(run, "pair int, n long"), size)
    return total[: k * k].reshape(k, k), total[k * k :].reshape(N_SMALL, 2 * k)


def nearest(near: np.ndarray, cc: np.ndarray, first: int, last: int) -> np.ndarray:
    """The class from first to last whose neighbours are most like each row of near: classes after and before it."""
    k = len(cc)
    after, before = np.log(cc[first:last] + ALPHA), np.log(cc[:, first:last] + ALPHA)
    after -= np.log(cc[first:last].sum(1, keepdims=True) + ALPHA * k)
    before -= np.log(cc[:, first:last].sum(0) + ALPHA * k)
    return first + (near[:, :k] @ after.T + near[:, k:] @ before).argmax(1)


def reassigned(found: DataFrame, of: np.ndarray, cc: np.ndarray, seeds: int, n_classes: int) -> np.ndarray:
    """of, with the nearest class of each head word that is no seed."""
    shared, k = found.sparkSession.sparkContext.broadcast((of.astype(np.int16), cc)), len(cc)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, cc = shared.value
        for b in batches:
            row, _, other, before, n = _entries(b)
            near = np.bincount(row * 2 * k + before * k + of[other], n, b.num_rows * 2 * k).reshape(-1, 2 * k)
            yield pa.RecordBatch.from_arrays([b.column("word"), pa.array(nearest(near, cc, 0, n_classes).astype(np.int16))], names=["word", "class"])

    moved = found.where(F.col("word").between(seeds, CLUSTERED - 1)).mapInArrow(run, "word int, class short").toPandas()
    out = of.copy()
    out[moved["word"].to_numpy(np.int64)] = moved["class"].to_numpy(np.int64)
    return out


def likelihood(cc: np.ndarray) -> float:
    """Of class bigrams, up to what doesn't depend on the classes."""
    return float(_xlogx(cc).sum() - _xlogx(cc.sum(0)).sum() - _xlogx(cc.sum(1)).sum())


def exchange_rounds(found: DataFrame, head: list[bytes], of: np.ndarray, cc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes and class bigrams after rounds over all head words, given those of the seeds."""
    seeds, k = min(len(head), SEEDS), len(cc)
    q = k - 2
    of = reassigned(found, of, cc, seeds, q)
    cc, near = class_bigrams(found, of, k, seeds)
    for _ in range(ROUNDS - 1):
        to = reassigned(found, of, cc, seeds, q)
        to[:seeds] = nearest(near[:seeds], cc, 0, q)
        new, near = class_bigrams(found, to, k, seeds)
        gain = likelihood(new) - likelihood(cc)
        if gain > 0:
            of, cc = to, new
        if gain <= STANDS * cc.sum():
            break
    return of, cc


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(bigrams: np.ndarray, kinds: list[int], n_classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """The class of each unit. kinds: how many units there are of each kind, in order; a kind has classes of its own,
    n_classes at most."""
    of, first, last = np.zeros(len(bigrams), np.int64), np.zeros(len(bigrams), np.int64), np.zeros(len(bigrams), np.int64)
    at = k = 0
    for n in kinds:
        of[at : at + n] = k + np.arange(n) % n_classes
        first[at : at + n], last[at : at + n] = k, k + min(n, n_classes)
        at, k = at + n, k + min(n, n_classes)
    member = np.zeros((len(of), k))
    member[np.arange(len(of)), of] = 1
    to_class, from_class = bigrams @ member, bigrams.T @ member  # unit -> following class, unit -> preceding class
    cc = member.T @ to_class
    for _ in range(sweeps):
        moved = 0
        for w in range(len(of)):
            a, p, q, self_n = of[w], first[w], last[w], bigrams[w, w]
            if q - p < 2:
                continue
            right, left = to_class[w].copy(), from_class[w].copy()  # counts of w with each class after and before it
            right[a] -= self_n
            left[a] -= self_n
            if not (right.any() or left.any() or self_n):
                continue
            cc[a] -= right
            cc[:, a] -= left
            cc[a, a] -= self_n
            rows, columns = cc[p:q].sum(1), cc[:, p:q].sum(0)
            r, c = np.flatnonzero(right), np.flatnonzero(left)
            gain = (_xlogx(cc[p:q, r] + right[r]) - _xlogx(cc[p:q, r])).sum(1) + (_xlogx(cc[c, p:q] + left[c, None]) - _xlogx(cc[c, p:q])).sum(0)
            own = cc[np.arange(p, q), np.arange(p, q)]  # counted in both sums above
            gain += _xlogx(own + right[p:q] + left[p:q] + self_n) - _xlogx(own + right[p:q]) - _xlogx(own + left[p:q]) + _xlogx(own)
            gain -= _xlogx(rows + right.sum() + self_n) - _xlogx(rows)
            gain -= _xlogx(columns + left.sum() + self_n) - _xlogx(columns)
            b = p + int(gain.argmax())
            if gain[b - p] <= gain[a - p] + 1e-6:
                b = a
            cc[b] += right
            cc[:, b] += left
            cc[b, b] += self_n
            if b != a:
                moved += 1
                of[w] = b
                to_class[:, a] -= bigrams[:, w]
                to_class[:, b] += bigrams[:, w]
                from_class[:, a] -= bigrams[w]
                from_class[:, b] += bigrams[w]
        if not moved:
            break
    return of


def _contexts(head: list[bytes], of: np.ndarray, q: int) -> dict[bytes, int]:
    """Head word or END -> its class as a context; all others are q."""
    return dict(zip(head, of[: len(head)].tolist(), strict=True)) | {END: q + 1}


def other_classes(docs: DataFrame, head: list[bytes], of: np.ndarray, cc: np.ndarray, text: str = "text") -> tuple[DataFrame, np.ndarray]:
    """word and class of every other word that docs have, written, and how often each class of other words follows each context."""
    k = len(cc)
    q = k - 2
    shared = docs.sparkSession.sparkContext.broadcast((_contexts(head, of, q), cc))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value[0].get
        ids: dict[bytes, int] = {}
        slots, held = [], 0

        def out() -> pa.RecordBatch:
            key, n = np.unique(np.concatenate(slots), return_counts=True)
            stops = np.searchsorted(key // (2 * k), np.arange(len(ids) + 1)).astype(np.int32)
            e = pa.ListArray.from_arrays(pa.array(stops), pa.array((key % (2 * k)) << 32 | n))
            b = pa.RecordBatch.from_arrays([pa.array(list(ids), pa.binary()), e], names=["word", "e"])
            ids.clear()
            slots.clear()
            return b

        for b in batches:
            for at in range(0, b.num_rows, TEXTS):
                flat = [END]
                for t in b.column("text").slice(at, TEXTS):
                    flat += words(t.as_py())
                    flat.append(END)
                context = np.fromiter(map(get, flat, repeat(q)), np.int64, len(flat))
                places = np.flatnonzero(context == q)
                if not len(places):
                    continue
                id_ = np.fromiter((ids.setdefault(flat[i], len(ids)) for i in places.tolist()), np.int64, len(places))
                slots += [id_ * 2 * k + context[places + 1], id_ * 2 * k + k + context[places - 1]]
                held += len(places)
                if held >= PAIRS or len(ids) >= FLUSH:
                    yield out()
                    held = 0
        if slots:
            yield out()

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order of words: the class of each word, and at the end the sums of (context, class)."""
        cc = shared.value[1]
        total = np.zeros((k, q))
        last, near = None, np.zeros((0, 2 * k))

        def out(found: pa.Array, near: np.ndarray) -> pa.RecordBatch:
            class_ = nearest(near, cc, 0, q)
            np.add.at(total.T, class_, near[:, k:])
            none = pa.nulls(len(found))
            return pa.RecordBatch.from_arrays([found, pa.array(class_.astype(np.int16)), none.cast(pa.int16()), none.cast(pa.int64())], names=["word", "class", "context", "n"])

        for b in batches:
            if not b.num_rows:
                continue
            word, e = b.column("word"), b.column("e")
            new = np.ones(len(word), bool)
            new[1:] = pc.not_equal(word.slice(1), word.slice(0, len(word) - 1)).to_numpy(zero_copy_only=False)
            new[0] = last is None or word[0].as_py() != last
            group = np.cumsum(new) - 1 + (last is not None)
            row = np.repeat(group, e.value_lengths().to_numpy())
            flat = e.flatten().to_numpy()
            dense = np.bincount(row * 2 * k + (flat >> 32), flat & 0xFFFFFFFF, (group[-1] + 1) * 2 * k).reshape(-1, 2 * k)
            dense[: len(near)] += near
            found = word.filter(pa.array(new))
            if last is not None:
                found = pa.concat_arrays([pa.array([last], word.type), found])
            if len(found) > 1:
                yield out(found.slice(0, len(found) - 1), dense[:-1])
            last, near = found[-1].as_py(), dense[-1:]
        if last is not None:
            yield out(pa.array([last], pa.binary()), near)
        context, class_ = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(class_), pa.binary()), pa.array(class_.astype(np.int16)), pa.array(context.astype(np.int16)), pa.array(total[context, class_].astype(np.int64))], names=["word", "class", "context", "n"])

    parts = docs.select(F.col(text).alias("text")).mapInArrow(run, "word binary, e array<long>")
    chosen = checkpointed(parts.repartition("word").sortWithinPartitions("word").mapInArrow(choose, "word binary, class short, context short, n long"))
    sums = np.zeros((k, q))
    for r in chosen.where("word is null").groupBy("context", "class").agg(F.sum("n").alias("n")).collect():  # at most k * q
        sums[r["context"], r["class"]] = r["n"]
    return chosen.where("word is not null").select("word", "class"), sums


@dataclass
class Model:
    """q classes of head words. Contexts: those, other words (q), the end (q + 1). Targets: those, their twins (q + class), the end (2 * q)."""

    tokens: int  # N
    distinct: int  # V
    least: int  # words with at least this count are the head
    head: list[bytes]
    of: np.ndarray  # class of head words
    base: np.ndarray  # log10 (c + 1) / (N + V + 1) of head words
    emission: np.ndarray  # log10 P(word | class) of head words
    transition: np.ndarray  # log10 P(target | context)
    log_room: np.ndarray  # log10 (tokens + distinct words + 1) of twins
    unseen: np.ndarray  # log10 P(a word that was never met | context)
    end_base: float

    @property
    def log_all(self) -> float:
        return float(np.log10(self.tokens + self.distinct + 1))

    @property
    def classes(self) -> int:
        return len(self.log_room)


def fit(docs: DataFrame, text: str = "text", classes: int | None = None) -> tuple[Model, DataFrame]:
    """The model, and the written counts and classes (null for head words) of all words of docs."""
    counts = checkpointed(word_counts(docs, text))
    row = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    tokens, distinct = row["n"], row["v"]
    least = (tokens >> HEAD_BITS) + 1
    rows = counts.where(F.col("n") >= least).collect()  # at most 2**HEAD_BITS
    ends = next((r["n"] for r in rows if bytes(r["word"]) == END), 0) or sum(r["n"] for r in counts.where(F.col("word") == F.lit(END)).collect())
    pairs = sorted(((-r["n"], bytes(r["word"])) for r in rows if bytes(r["word"]) != END))
    head, n = [w for _, w in pairs], -np.array([c for c, _ in pairs], np.float64)
    m = min(len(head), SEEDS)
    q = min(m, classes or int(min(MOST_CLASSES, max(CLASSES, len(head) ** 0.4))))
    near = neighbours(docs, head, text)
    bigrams = unit_bigrams(near, head)
    used = np.concatenate([np.arange(m), [SEEDS, SEEDS + 1]])
    found = np.zeros(N_SMALL, np.int64)
    found[used] = exchange(bigrams[np.ix_(used, used)], [m, 1, 1], n_classes=q or 1)
    k = q + 2
    member = np.zeros((N_SMALL, k))
    member[used, found[used]] = 1
    cc = member.T @ bigrams @ member
    of = np.zeros(N_UNITS, np.int64)
    of[:m], of[OTHER], of[END_UNIT] = found[:m], q, q + 1
    of[m : len(head)] = q
    if len(head) > m:
        of, cc = exchange_rounds(near, head, of, cc)
    if q:
        others, follows = other_classes(docs, head, of, cc, text)
    else:
        others, follows = counts.select("word", F.lit(None).cast("short").alias("class")).limit(0), np.zeros((k, 0))
    known = checkpointed(counts.join(others, "word", "left").select("word", "n", "class"))
    words_of = np.zeros(q)
    for r in known.where("class is not null").groupBy("class").count().collect():
        words_of[r["class"]] = r["count"]
    follow = np.concatenate([cc[:, :q], follows, cc[:, q + 1 :]], 1)
    transition = (follow + ALPHA) / (follow.sum(1, keepdims=True) + ALPHA * (2 * q + 1))
    room = follows.sum(0) + words_of + 1
    unseen = np.log10((transition[:, q : 2 * q] / room).sum(1)) if q else np.full(k, -np.log10(tokens + distinct + 1.0))
    emission = np.log10(n) - np.log10(cc.sum(0)[of[: len(head)]])
    log_all = np.log10(tokens + distinct + 1)
    return Model(tokens, distinct, least, head, of[: len(head)].astype(np.int16), np.log10(n + 1) - log_all, emission, np.log10(transition), np.log10(room), unseen, float(np.log10(ends + 1) - log_all)), known


_OUT = "word binary, context short, times int, n_tokens long, n_known long, base_score double, score double"


def score(docs: DataFrame, model: Model, counts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, n_known, train_tokens, base_score and score (log10 P) of every row of docs."""
    source = with_row(docs).select(ROW, F.col(key).alias("key"), F.col(text).alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        get = {w: i for i, w in enumerate(m.head)}.get
        q, log_all, end_known = m.classes, m.log_all, int(m.tokens > 0)
        for b in batches:
            for at in range(0, b.num_rows, TEXTS):
                part = b.slice(at, TEXTS)
                split = [words(t.as_py()) for t in part.column("text")]
                size = np.fromiter(map(len, split), np.int64, len(split))
                flat = [w for s in split for w in s]
                index = np.fromiter(map(get, flat, repeat(-1)), np.int64, len(flat))
                known, rare = np.flatnonzero(index >= 0), np.flatnonzero(index < 0)
                context = np.full(len(flat), q, np.int64)
                context[known] = m.of[index[known]]
                # each text's contexts with the end before and after it
                stop = np.cumsum(size + 1)
                c = np.full(stop[-1] + 1, q + 1, np.int64)
                inside = np.ones(len(c), bool)
                inside[0] = inside[stop] = False
                c[inside] = context
                before = c[np.flatnonzero(inside) - 1]
                owner = np.repeat(np.arange(len(split)), size)
                add = lambda places, x: np.bincount(owner[places], x, len(split))
                n_known = np.bincount(owner[known], minlength=len(split)) + end_known
                # other words as if they had never been met: what their counts and classes change is added after the join
                base = add(known, m.base[index[known]]) + m.end_base - log_all * (size - n_known + end_known)
                total = add(known, m.transition[before[known], context[known]] + m.emission[index[known]]) + add(rare, m.unseen[before[rare]]) + m.transition[c[stop - 1], 2 * q]
                rows, keys = part.column(ROW).to_numpy(), part.column("key")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows), keys, pa.array([b" %d" % r for r in rows.tolist()], pa.binary()), pa.nulls(len(rows), pa.int16()), pa.array(np.ones(len(rows), np.int32)), pa.array(size + 1), pa.array(n_known), pa.array(base), pa.array(total)],
                    names=names,
                )
                if len(rare):
                    ids: dict[bytes, int] = {}
                    id_ = np.fromiter((ids.setdefault(flat[i], len(ids)) for i in rare.tolist()), np.int64, len(rare))
                    seen, times = np.unique((owner[rare] * len(ids) + id_) * (q + 2) + before[rare], return_counts=True)
                    of, own = seen // (q + 2) // len(ids), pa.array(list(ids), pa.binary()).take(pa.array(seen // (q + 2) % len(ids)))
                    none = pa.nulls(len(seen), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rows[of]), pa.nulls(len(seen), keys.type), own, pa.array((seen % (q + 2)).astype(np.int16)), pa.array(times.astype(np.int32)), none, none, pa.nulls(len(seen), pa.float64()), pa.nulls(len(seen), pa.float64())],
                        names=names,
                    )

    names = [ROW, "key", "word", "context", "times", "n_tokens", "n_known", "base_score", "score"]
    parts = source.mapInArrow(run, f"{ROW} long, key {kind}, {_OUT}")
    # a text's own row has a word that starts with a space, so it meets no count and is dealt evenly
    rare = counts.where(F.col("n") < model.least).where(F.col("word") != F.lit(END))
    joined = parts.join(rare, "word", "left").where("n is not null or n_tokens is not null")
    q = model.classes
    gain = model.transition[:, q : 2 * q] - model.log_room - model.unseen[:, None]  # a number for each context and class
    gains = docs.sparkSession.createDataFrame([(i, j, float(x)) for (i, j), x in np.ndenumerate(gain)], "context short, class short, gain double")
    met = joined.join(F.broadcast(gains), ["context", "class"], "left")
    times, more = F.col("times"), F.log10(F.col("n") + 1)
    of_text = F.col("n_tokens").isNotNull()
    pick = lambda own, other: F.when(of_text, F.col(own)).otherwise(other)
    slim = met.select(ROW, "key", "n_tokens", pick("n_known", times.cast("long")).alias("known"), pick("base_score", times * more).alias("base"), pick("score", times * (F.col("gain") + more)).alias("total"))
    out = slim.groupBy(ROW).agg(F.max("key").alias(key), F.sum("n_tokens").alias("n_tokens"), F.sum("known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("total").alias("score"))
    return out.drop(ROW).withColumn("train_tokens", F.lit(model.tokens).cast("long"))
