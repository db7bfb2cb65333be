"""MinHash near-duplicate detection on weighted bags of five-word shingles: BagMinHash, bands, verified overlap.

Signatures. A shingle's weight is the number of its places. Weights are discretised to whole levels, and the levels lie
in dyadic ranges (0, 1], (1, 2], (2, 4], (4, 8] ...; each shingle has a Poisson process for each range, whose
rate is the range's length and whose points carry a component of the signature and a level. A component's
value is the first point at a level within a shingle's weight, over all shingles, so two signatures agree in a component
with probability equal to the weighted Jaccard similarity. Points are drawn in order of time, for all shingles of a group of
texts at once, and a shingle stops when its time is past all of its text's components: about n + m log m points.

Bands of ROWS components put texts into buckets. No bucket's pairs are written out:

1. Texts with the same bag are one (a shuffle of digests; the first row stands for them).
2. Star: each bucket's centre is the member whose buckets are fullest (of edited copies, the text nearest to all); each
   member is verified against the centre, by the multiset overlap of the shingles of their whole texts. Pairs of
   SIMILARITY or more are links. Members of one centre are dealt out in slices, so a task streams texts past one
   centre text.
3. Links are closed to classes (large star, small star; checkpointed rounds).
4. Rest: in a bucket that still has more than one class, every member outside the bucket's most common class meets every
   member, in cells of at most CELL by CELL. There, members of different classes whose signatures agree in LEAST or more of
   the components (4.5 standard deviations below SIMILARITY) are verified, the likeliest first, and a link unites their
   classes at once, so a cell gives fewer links than it has classes. A pair is compared in the first bucket that it shares.
   Then classes are closed again. So a link between texts that share a bucket isn't lost when neither is near the centre.

At a similarity of exactly 0.8 a pair shares one of the 24 buckets with probability 0.9993.

Defined cases: null text counts as empty; a text without words is a class of its own; texts of fewer than five words have one
shingle, of all their words; repeated rows are in one class; the class id is the smallest key of the class (null only
if all are null), and of its rows the one with that key that comes first stays; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portcullis.llm.common import BROADCAST_KEYS, ROW, checkpointed, filtered, join_groups, only, with_row, without
from portcullis.llm.license_scan import _WORD_BYTES

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 6
M = BANDS * ROWS
LEAST = 0.65
#: Elements whose points are drawn at once; members of a centre in a slice; members of a bucket in a cell.
GROUP, SLICE, CELL = 150_000, 256, 1024

_U = np.uint64
_GOLD, _C1, _C2 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _C1
    x = (x ^ (x >> _U(27))) * _C2
    return x ^ (x >> _U(31))


_POWERS = [np.cumprod(np.full(256, 0x100000001B3, _U))]


def _powers(n: int) -> np.ndarray:
    if len(_POWERS[0]) < n:
        _POWERS[0] = np.cumprod(np.full(2 * n, 0x100000001B3, _U))
    return _POWERS[0]


def shingles(text: str | None) -> np.ndarray:
    """A 64-bit hash of each shingle of a text, in order."""
    b = np.frombuffer((text or "").encode().translate(_WORD_BYTES), np.uint8)
    inside = np.zeros(len(b) + 2, np.int8)
    inside[1:-1] = b != 32
    step = np.diff(inside)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if not len(start):
        return np.zeros(0, _U)
    length = end - start
    first = np.cumsum(length) - length
    at = np.arange(first[-1] + length[-1]) - np.repeat(first, length)
    word = np.add.reduceat((b[b != 32].astype(_U) + _U(1)) * _powers(int(length.max()))[at], first)
    word = _mix(word + length.astype(_U) * _GOLD)
    k = min(SHINGLE, len(word))
    out = np.zeros(len(word) - k + 1, _U)
    for i in range(k):
        out = out * _U(0xD1342543DE82EF95) + word[i : i + len(out)]
    return _mix(out + _U(k))


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles and their weights."""
    return np.unique(shingles(text), return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two bags; 0 if either is empty."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    same = b[0][at] == a[0]
    shared = int(np.minimum(a[1][same], b[1][at[same]]).sum())
    return shared / (int(a[1].sum()) + int(b[1].sum()) - shared)


def signatures(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int, m: int = M) -> np.ndarray:
    """n x m first points of the bags: element i has weight weights[i] in bag owner[i]. Empty bags have inf."""
    h = np.full(n * m, np.inf)
    ranges = 1 + np.ceil(np.log2(weights)).astype(np.int64)
    j = np.arange(ranges.sum()) - np.repeat(np.cumsum(ranges) - ranges, ranges)
    rate = np.exp2(np.maximum(j - 1, 0))
    low = np.where(j == 0, 0.0, rate)
    share = np.minimum(1.0, (np.repeat(weights, ranges) - low) / rate)
    seed = _mix(np.repeat(elements, ranges) + j.astype(_U) * _C1)
    of, time = np.repeat(owner, ranges), np.zeros(len(j))
    while len(seed):
        e = 1 if len(seed) > 20_000 else 16  # points of each process drawn in this round
        a = _mix(seed[:, None] + _GOLD * np.arange(1, e + 1, dtype=_U))
        c = _mix(a ^ _C2)
        seed = seed + _U(int(_GOLD) * e % 2**64)
        gap = -np.log(((a >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate[:, None]
        points = np.cumsum(np.concatenate([time[:, None], gap], 1), 1)[:, 1:]  # added up in order: the same sums in any round
        component = ((c >> _U(32)) * _U(m) >> _U(32)).astype(np.int64)
        ok = (c & _U(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 < share[:, None]
        np.minimum.at(h, (of[:, None] * m + component)[ok], points[ok])
        time = points[:, -1]
        on = time < h.reshape(n, m).max(1)[of]
        seed, time, rate, share, of = seed[on], time[on], rate[on], share[on], of[on]
    return h.reshape(n, m)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    band = np.arange(BANDS, dtype=_U) * _C2

    def out() -> pa.RecordBatch:
        size = np.fromiter((len(e) for e, _ in bags), np.int64, len(bags))
        h = signatures(np.concatenate([e for e, _ in bags]), np.concatenate([w for _, w in bags]), np.repeat(np.arange(len(bags)), size), len(bags))
        bits = _mix(h.view(_U))
        key = np.zeros((len(bags), BANDS), _U)
        for i in range(ROWS):
            key = key * _U(0xD1342543DE82EF95) + bits[:, i::ROWS]
        key = _mix(key + band).view(np.int64)
        full = size > 0
        lists = pa.ListArray.from_arrays(np.arange(0, full.sum() * BANDS + 1, BANDS, dtype=np.int32), pa.array(key[full].ravel()))
        low = (bits & _U(0xFFFF)).astype(np.uint16)
        digest = [np.stack(_digest(e, w)).tobytes() for (e, w), f in zip(bags, full, strict=True) if f]
        b = pa.RecordBatch.from_arrays([pa.array(np.array(rows, np.int64)[full]), pa.array(digest, pa.binary()), lists, pa.array([x.tobytes() for x in low[full]], pa.binary())], names=[ROW, "digest", "bands", "signature"])
        bags.clear()
        rows.clear()
        return b

    bags, rows, n = [], [], 0
    for b in batches:
        for row, t in zip(b.column(ROW).to_pylist(), b.column("text"), strict=True):
            bags.append(bag(t.as_py()))
            rows.append(row)
            n += len(bags[-1][0]) + 1
            if n >= GROUP:
                yield out()
                n = 0
    if bags:
        yield out()


def _digest(e: np.ndarray, w: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """128 bits of a bag."""
    with np.errstate(over="ignore"):
        x = _mix(e + w.astype(_U) * _GOLD)
        return x.sum(dtype=_U), _mix(x ^ _C1).sum(dtype=_U)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by centre and slice, the centre's own text first in each: the pairs of SIMILARITY or more."""
    now, centre_bag = None, None
    for b in batches:
        links = []
        for centre, slice_, row, t in zip(b.column("centre").to_pylist(), b.column("slice").to_pylist(), b.column("row").to_pylist(), b.column("text"), strict=True):
            if row is None:
                now, centre_bag = (centre, slice_), bag(t.as_py())
            elif now != (centre, slice_):
                raise RuntimeError("a slice came without its centre")
            elif similarity(centre_bag, bag(t.as_py())) >= SIMILARITY:
                links.append((centre, row))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([x for _, x in links], pa.int64())], names=["u", "v"])


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of pairs (centre, row), written and distinct, those whose texts are similar, as (u, v). texts: ROW, text."""
    # centres with more rows than a slice holds; the others are one slice and need no join
    large = checkpointed(pairs.groupBy("centre").agg(F.count("*").alias("n")).where(F.col("n") > SLICE).select("centre", F.ceil(F.col("n") / SLICE).cast("int").alias("slices")))
    hint = F.broadcast if large.count() <= BROADCAST_KEYS else lambda df: df
    cut = pairs.join(hint(large), "centre", "left").select("centre", F.pmod(F.xxhash64("row"), F.coalesce("slices", F.lit(1))).cast("int").alias("slice"), "row")
    cut = checkpointed(cut)
    centres = cut.select(F.col("centre").alias(ROW), "centre", "slice", F.lit(None).cast("long").alias("row")).distinct()
    wanted = cut.select(F.col("row").alias(ROW), "centre", "slice", "row").unionByName(centres)
    there = only(texts, checkpointed(wanted.select(ROW).distinct()))
    dealt = wanted.join(there, ROW).select("centre", "slice", "row", "text").repartition("centre", "slice").sortWithinPartitions("centre", "slice", F.col("row").asc_nulls_first())
    return dealt.mapInArrow(_verify, "u long, v long")


def classes(links: DataFrame) -> DataFrame:
    """node and class (the smallest node) of the nodes of links (u, v): large star and small star until nothing changes."""
    e = checkpointed(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = checkpointed(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        e = checkpointed(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("class")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("class")).distinct())


class _Cell:
    """Strays and home members of one cell of a bucket. Classes are united as links are found."""

    def __init__(self, band: int) -> None:
        self.band, self.strays, self.home, self.parent = band, [], [], {}

    def find(self, c: int) -> int:
        while (up := self.parent.get(c, c)) != c:
            c = up
        return c

    def links(self) -> Iterator[tuple[int, int]]:
        if not self.strays or not self.home:
            return
        s = np.frombuffer(b"".join(x[2] for x in self.strays), np.uint16).reshape(len(self.strays), M)
        s_row = np.array([x[0] for x in self.strays])
        bags: dict[int, tuple] = {}
        for row, class_, signature, packed, stray in self.home:
            same = s == np.frombuffer(signature, np.uint16)
            agree = same.sum(1)
            near = np.flatnonzero((agree >= LEAST * M) & (s_row != row) & ((s_row < row) | (not stray)))
            if self.band and len(near):  # a pair is compared in the first bucket that it shares
                near = near[~same[near].reshape(len(near), BANDS, ROWS).all(2)[:, : self.band].any(1)]
            own = None
            for i in near[np.argsort(-agree[near], kind="stable")].tolist():
                a, b = self.find(class_), self.find(self.strays[i][1])
                if a == b:
                    continue
                own = own or _unpacked(packed)
                if i not in bags:
                    bags[i] = _unpacked(self.strays[i][3])
                if similarity(own, bags[i]) >= SIMILARITY:
                    self.parent[max(a, b)] = min(a, b)
                    yield row, int(s_row[i])


def _packed(bags: tuple[np.ndarray, np.ndarray]) -> bytes:
    return bags[0].tobytes() + bags[1].astype(np.int32).tobytes()


def _unpacked(b: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(b) // 12
    return np.frombuffer(b, _U, n), np.frombuffer(b, np.int32, n, 8 * n)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 1024):
            part = b.slice(at, 1024)
            yield pa.RecordBatch.from_arrays([part.column(ROW), pa.array([_packed(bag(t.as_py())) for t in part.column("text")], pa.binary())], names=["row", "bag"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by cell. Each member at home in a cell meets each stray of the cell."""
    names = ("key", "i", "j", "band", "role", "stray", "row", "class", "signature", "bag")

    def out(cell: _Cell) -> pa.RecordBatch:
        found = list(cell.links())
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], names=["u", "v"])

    now, cell = None, None
    for b in batches:
        for key, i, j, band, role, stray, *member in zip(*(b.column(c).to_pylist() for c in names), strict=True):
            if (key, i, j) != now:
                if cell is not None:
                    yield out(cell)
                now, cell = (key, i, j), _Cell(band)
            if role:
                cell.home.append((*member, stray))
            else:
                cell.strays.append(tuple(member))
    if cell is not None:
        yield out(cell)


def rest_links(buckets: DataFrame, found: DataFrame, signed: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (u, v) between different classes that share a bucket. buckets: key, band, row, written."""
    of = checkpointed(buckets.join(found, F.col("row") == F.col("node"), "left").select("key", "band", "row", F.coalesce("class", "row").alias("class")))
    shares = of.groupBy("key", "class").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "class")).alias("top"), F.sum("n").alias("n"), F.count("*").alias("k"))
    blocks = lambda n: F.ceil(n / CELL).cast("int")
    mixed = checkpointed(shares.where("k > 1").select("key", "n", F.col("top.class").alias("top"), blocks(F.col("n")).alias("homes"), blocks(F.col("n") - F.col("top.n")).alias("blocks")))
    members = checkpointed(join_groups(of, mixed, "key", "n").withColumn("stray", F.col("class") != F.col("top")))
    own = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    all_ = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    base = ["key", "band", "row", "class", "stray"]
    at_home = members.select(*base, F.lit(True).alias("role"), own("homes").alias("j"), all_("blocks").alias("i"))
    as_strays = members.where("stray").select(*base, F.lit(False).alias("role"), own("blocks").alias("i"), all_("homes").alias("j"))
    bags = only(texts, checkpointed(members.select(F.col("row").alias(ROW)).distinct())).mapInArrow(_pack, "row long, bag binary")
    facts = bags.join(signed.select(F.col(ROW).alias("row"), "signature"), "row")
    cells = at_home.unionByName(as_strays).join(facts, "row").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return cells.mapInArrow(_compare, "u long, v long")


def near_classes(rows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """rows: docs with ROW. ROW, key and first (the least ROW of the row's class) of every row."""
    texts = rows.select(ROW, F.col(text).alias("text"))
    signed = checkpointed(texts.mapInArrow(_sign, f"{ROW} long, digest binary, bands array<long>, signature binary"))
    same = checkpointed(signed.groupBy("digest").agg(F.min(ROW).alias("rep"), F.count("*").alias("copies")))
    reps = signed.join(same.select(F.col("rep").alias(ROW)), ROW, "left_semi")
    keys = reps.select(F.posexplode("bands").alias("band", "key"), F.col(ROW).alias("row"))
    shared = checkpointed(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    buckets = checkpointed(keys.join(shared, "key"))
    # the centre of a bucket is its member with the fullest buckets: of edited copies, the text nearest to all
    weight = checkpointed(buckets.groupBy("row").agg(F.sum("n").alias("weight")))
    best = F.max(F.struct("weight", (-F.col("row")).alias("last")))
    centres = checkpointed(buckets.join(weight, "row").groupBy("key").agg(best.alias("best"), F.count("*").alias("members")).select("key", "members", (-F.col("best.last")).alias("centre")))
    star = join_groups(buckets.select("key", "row"), centres, "key", "members").where("row <> centre").select("centre", "row").distinct()
    links = checkpointed(verified(checkpointed(star), texts))
    found = checkpointed(classes(links))
    extra = rest_links(buckets.select("key", "band", "row"), found, signed, texts)
    joined = classes(links.unionByName(extra))
    class_of = checkpointed(same.join(joined, F.col("rep") == F.col("node"), "left").select("digest", "copies", F.coalesce("class", "rep").alias("first")))
    first = join_groups(signed.select(ROW, "digest"), class_of, "digest", "copies").select(F.col(ROW).alias("r"), "first")
    return rows.select(ROW, F.col(key).alias("key")).join(first, F.col(ROW) == F.col("r"), "left").select(ROW, "key", F.coalesce("first", ROW).alias("first"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: key, class_id, class_size, kept."""
    found = checkpointed(near_classes(with_row(docs), key, text))
    order = F.struct(F.col("key").isNull().alias("a"), F.col("key").alias("key"), F.col(ROW).alias(ROW))
    groups = checkpointed(found.groupBy("first").agg(F.min(order).alias("best"), F.count("*").alias("class_size")))
    return join_groups(found, groups, "first", "class_size").select(F.col("key").alias(key), F.col("best.key").alias("class_id"), "class_size", (F.col(ROW) == F.col(f"best.{ROW}")).alias("kept"))


def drop_near(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, one of each class, with all their columns."""

    def keep(rows: DataFrame) -> DataFrame:
        found = checkpointed(near_classes(rows, key, text))
        order = F.struct(F.col("key").isNull().alias("a"), F.col("key").alias("key"), F.col(ROW).alias(ROW))
        best = found.groupBy("first").agg(F.min(order).alias("best")).select(F.col(f"best.{ROW}").alias(ROW))
        return without(rows, checkpointed(found.select(ROW).join(best, ROW, "left_anti")))

    return filtered(docs, keep)
