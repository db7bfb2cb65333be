"""Benchmark decontamination: BM25 over test items with block-max WAND, then a check of question and answer.

Items are cut into segments of at most SEGMENT words, which an inverted index holds with their BM25 impacts, each
divided by the segment's score for itself: a passage that holds all of a segment scores 1. Every passage of a text
(WINDOW words, every STRIDE) is a query; a segment of at most STRIDE words lies whole in one of them. Retrieval
returns all segments at SCORE or above, without a top-k:

- bound 1: the sum of the terms' largest impacts of any segment, added up for all passages of a text at once;
- bound 2: the same for each block of BLOCK segments (block-max); only blocks that reach SCORE are opened;
- the postings of those blocks give the exact scores.

A hit is verified in the text around it: of the item's question at least QUESTION must stand there, of its answer at least ANSWER. What
stands is the larger of two shares: that of the part's n-grams (five words), and that of its words which stay if the part is aligned with
the stretch of text nearest to it (1 - edits / words; an edit is a word replaced, dropped or put in). So a copy with a word changed here and there is
found, though each change breaks five n-grams. Parts of more than ALIGNED words have the first share alone, which tolerates
single changes there. The answer is what follows the last line that starts with ``answer:``, or else the last quarter of the words.

The index is broadcast in shards of about SHARD words of items, dealt by a hash of their ids; with more items there are more
passes over the texts, each written before the next. Document frequencies are those of all items, counted by Spark. Texts are
read whole, one at a time.

Defined cases: null text counts as empty and never matches; items of fewer than five words are checked as one
n-gram; ids may be of any type; repeated items give a row for each distinct id, items without an id a row each, with a null; repeated rows of texts give rows each; of several places the
one with the best score, then the first, is given; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from portcullis.llm.common import ROW, checkpointed, filtered, with_row, without
from portcullis.llm.license_scan import words

SEGMENT, STRIDE, BLOCK = 64, 64, 32
WINDOW = 2 * STRIDE
SCORE, QUESTION, ANSWER, GRAM = 0.6, 0.8, 0.5, 5
K1, B = 1.2, 0.75
SHARD = 2_000_000
ALIGNED = 4096

HITS = "first_word int, score double, question_overlap double, answer_overlap double"


def parts(text: str | None) -> tuple[list[bytes], list[bytes]]:
    """Question and answer words of an item."""
    lines = (text or "").split("\n")
    for i in range(len(lines) - 1, 0, -1):
        if lines[i].lower().startswith("answer:"):
            return words("\n".join(lines[:i])), words("\n".join(lines[i:])[len("answer:") :])
    found = words(text)
    cut = len(found) - len(found) // 4
    return found[:cut], found[cut:]


def segments(found: list[bytes]) -> list[list[bytes]]:
    n = -(-len(found) // SEGMENT)
    return [found[i * len(found) // n : (i + 1) * len(found) // n] for i in range(n)]


def grams(found: list[bytes], n: int) -> set[tuple[bytes, ...]]:
    return set(zip(*(found[i:] for i in range(n)), strict=False))


def edits(part: list[bytes], text: list[bytes]) -> int:
    """The fewest words to replace, drop or put in to make part a stretch of text; one bit of a number for each word of part."""
    places: dict[bytes, int] = {}
    for i, w in enumerate(part):
        places[w] = places.get(w, 0) | 1 << i
    every, last = (1 << len(part)) - 1, 1 << len(part) - 1
    up, down, now = every, 0, len(part)
    best = now
    for w in text:
        same = places.get(w, 0)
        across = ((same & up) + up ^ up) | same
        more, less = down | ~(across | up) & every, up & across
        now += bool(more & last) - bool(less & last)
        best = min(best, now)
        same |= down
        more, less = more << 1 & every, less << 1 & every
        up, down = less | ~(same | more) & every, more & same
    return best


class Index:
    """Of some items, with the document frequencies and the mean length of all segments."""

    def __init__(self, items: list[tuple[object, str | None]], frequency: dict[bytes, int], n_segments: int, mean: float) -> None:
        self.ids = [i for i, _ in items]
        first: dict[object, int] = {}
        #: of each item the first with its id; items without an id are on their own
        self.group = [n if i is None else first.setdefault(i, n) for n, i in enumerate(self.ids)]
        self.items = []
        self.owner: list[int] = []
        self.vocabulary: dict[bytes, int] = {}
        entries: list[tuple[int, int, float]] = []
        for _, text in items:
            question, answer = parts(text)
            checks = [(g, len(g)) for g in (grams(x, min(GRAM, max(1, len(x)))) for x in (question, answer))]
            for s in segments(question + answer):
                counts = Counter(s)
                impact = {}
                for w, tf in counts.items():
                    df = frequency[w]
                    idf = np.log(1 + (n_segments - df + 0.5) / (df + 0.5))
                    impact[w] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(s) / mean))
                own = sum(impact.values())
                for w, x in impact.items():
                    entries.append((self.vocabulary.setdefault(w, len(self.vocabulary) + 1), len(self.owner), x / own))
                self.owner.append(len(self.items))
            self.items.append((len(question) + len(answer), [min(GRAM, max(1, len(x))) for x in (question, answer)], checks, (question, answer)))
        entries.sort()
        term = np.array([e[0] for e in entries], np.int64)
        self.segment = np.array([e[1] for e in entries], np.int64)
        self.impact = np.array([e[2] for e in entries], np.float64)
        n_terms = len(self.vocabulary) + 1
        self.start = np.searchsorted(term, np.arange(n_terms + 1))
        self.largest = np.zeros(n_terms)
        np.maximum.at(self.largest, term, self.impact)
        # block-max lists: for each term its blocks and the largest impact in each
        self.n_blocks = max(1, -(-len(self.owner) // BLOCK))
        block = term * self.n_blocks + self.segment // BLOCK
        at, first = np.unique(block, return_index=True)
        self.block = at % self.n_blocks
        self.block_max = np.maximum.reduceat(self.impact, first) if len(first) else np.zeros(0)
        self.block_start = np.searchsorted(at // self.n_blocks, np.arange(n_terms + 1))

    @staticmethod
    def _runs(start: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """The places of the lists of some terms."""
        a, n = start[terms], start[terms + 1] - start[terms]
        return np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())

    def retrieve(self, ids: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(first word of the passage, segment, score) of all segments at SCORE or above. ids: terms, 0 if not indexed."""
        n = len(ids)
        if not n or not len(self.owner):
            return
        known = np.flatnonzero(ids)
        once = np.unique(known // STRIDE * len(self.largest) + ids[known])  # each term once in each run of STRIDE words
        run, term = np.divmod(once, len(self.largest))
        n_runs = -(-n // STRIDE)
        bound = np.bincount(run, self.largest[term], n_runs + 1)
        bound = bound[:-1] + bound[1:]  # a passage is two runs
        from_ = np.searchsorted(run, np.arange(n_runs + 2))
        for i in np.flatnonzero(bound[: max(1, n_runs - 1)] >= SCORE - 1e-9).tolist():
            a = i * STRIDE
            terms = np.unique(term[from_[i] : from_[i + 2]])
            if self.largest[terms].sum() < SCORE - 1e-9:
                continue
            at = self._runs(self.block_start, terms)
            open_ = np.bincount(self.block[at], self.block_max[at], self.n_blocks) >= SCORE - 1e-9
            if not open_.any():
                continue
            at = self._runs(self.start, terms)
            at = at[open_[self.segment[at] // BLOCK]]
            scores = np.bincount(self.segment[at], self.impact[at], len(self.owner))
            for s in np.flatnonzero(scores >= SCORE - 1e-9).tolist():
                yield a, s, float(scores[s])

    def hits(self, text: str | None) -> list[tuple[int, int, float, float, float]]:
        """(item's place, first word of the passage, score, question overlap, answer overlap) of the items that text holds, one of each id."""
        found = words(text)
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in found), np.int64, len(found))
        best: dict[int, tuple] = {}
        for a, s, score in self.retrieve(ids):
            length, sizes, checks, words_of = self.items[self.owner[s]]
            item = self.group[self.owner[s]]
            near = found[max(0, a - length) : a + WINDOW + length]
            there, overlap = set(near), []
            for size, (wanted, n), part, least in zip(sizes, checks, words_of, (QUESTION, ANSWER), strict=True):
                share = len(wanted & grams(near, size)) / n if n else 1.0
                if share < least and len(part) <= ALIGNED and sum(w in there for w in part) >= least * len(part):
                    share = max(share, 1 - edits(part, near) / len(part))
                overlap.append(share)
                if share < least:
                    break
            if len(overlap) < 2:
                continue
            if overlap[0] >= QUESTION and overlap[1] >= ANSWER:
                if item not in best or (-score, a) < (-best[item][2], best[item][1]):
                    best[item] = (item, a, score, *overlap)
        return [best[i] for i in sorted(best)]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many segments have each word; the empty word stands for all segments, a space for all words."""
    for b in batches:
        counts: Counter[bytes] = Counter()
        for t in b.column("t"):
            for s in segments([w for part in parts(t.as_py()) for w in part]):
                counts.update(set(s))
                counts[b""] += 1
                counts[b" "] += len(s)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])


def indexes(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> tuple[int, Iterator[Index]]:
    """How many shards the items make, and their indexes, one at a time. Words are counted by Spark; the driver holds the items and
    the counts of one shard."""
    items = checkpointed(with_row(benchmark.select(F.col(item).alias("i"), F.col(text).alias("t"))))
    counts = checkpointed(items.select("t").mapInArrow(_measure, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    totals = {bytes(r["word"]): r["n"] for r in counts.where(F.col("word").isin(b"", b" ")).collect()}
    n, length = totals.get(b"", 0), totals.get(b" ", 0)
    shards = -(-length // SHARD)
    shard = F.pmod(F.xxhash64(F.coalesce(F.col("i").cast("string"), F.concat(F.lit("row "), F.col(ROW)))), F.lit(max(1, shards)))  # an id lies in one shard

    def one(s: int) -> Index:
        rows = items.where(shard == s)
        known = counts if shards == 1 else rows.select("t").mapInArrow(_measure, "word binary, n long").select("word").distinct().join(counts, "word")
        frequency = {bytes(r["word"]): r["n"] for r in known.collect()}
        return Index([(r["i"], r["t"]) for r in rows.orderBy(ROW).collect()], frequency, n, length / max(1, n))

    return shards, (one(s) for s in range(shards))


def _passes(benchmark: DataFrame, search: Callable[[Broadcast], DataFrame]) -> DataFrame | None:
    """The union of search(index) over all shards. With several, each pass is written before the next index is made."""
    shards, found = indexes(benchmark)
    out = None
    for index in found:
        shared = benchmark.sparkSession.sparkContext.broadcast(index)
        part = search(shared)
        if shards > 1:
            part = checkpointed(part)
            shared.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, item_id (each of its table's type) and HITS: a row for each row of docs and item that it holds."""
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    id_type = benchmark.schema["item_id"].dataType
    schema = f"{key} {source.schema['key'].dataType.simpleString()}, item_id {id_type.simpleString()}, {HITS}"
    names = [key, "item_id", "first_word", "score", "question_overlap", "answer_overlap"]
    kinds = [to_arrow_type(id_type), pa.int32(), pa.float64(), pa.float64(), pa.float64()]

    def search(shared: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids = shared.value.ids
            for b in batches:
                found = [(i, (ids[h[0]], *h[1:])) for i, t in enumerate(b.column("text")) for h in shared.value.hits(t.as_py())]
                if found:
                    columns = zip(*(h for _, h in found), strict=True)
                    yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array([i for i, _ in found])), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

        return source.mapInArrow(run, schema)

    found = _passes(benchmark, search)
    return docs.sparkSession.createDataFrame([], schema) if found is None else found


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that hold no item, with all their columns."""

    def keep(rows: DataFrame) -> DataFrame:
        source = rows.select(ROW, F.col(text).alias("text"))

        def search(shared: Broadcast) -> DataFrame:
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    hit = pa.array([bool(shared.value.hits(t.as_py())) for t in b.column("text")], pa.bool_())
                    yield pa.RecordBatch.from_arrays([b.column(ROW).filter(hit)], names=[ROW])

            return source.mapInArrow(run, f"{ROW} long")

        found = _passes(benchmark, search)
        return rows if found is None else without(rows, checkpointed(found.distinct()))

    return filtered(docs, keep)
