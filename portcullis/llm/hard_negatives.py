"""Hard-negative mining over inverted lists whose centroids keep a radius.

Vectors become whole numbers, floor(SCALE * entry), and a score is the exact inner product of two. Rows of the same label and
vector are one point of the index with its WORST + 1 smallest keys, as no answer can need more of them.

Index. Centroids come from k-means over a sample of points with the smallest hashes (SAMPLE a cluster, at most SAMPLE *
CLUSTERS); every point is then put into its nearest centroid's list, whose radius is the greatest distance of a member. Lists are
written as blocks of about BLOCK_BYTES, so a list that holds a third of all points is many blocks.

Search. For a query q and a list with centroid c and radius r, Cauchy-Schwarz gives |q.x - q.c| <= |q| r for every member
x. A query visits its lists by falling upper bound q.c + |q| r, in rounds of FIRST lists, then GROW times as many. A list is
skipped if its bounds lie outside of all the query's windows of scores, or if its upper bound falls strictly below the kth score that
each window has by then (or, where a window ends, all it can still give). A query without a list to visit is done. Within a round,
queries are packed in chunks, chunks and blocks meet by an equality join, and a task multiplies a chunk by a block. Each hands on
a query's best WORST of each window, and a window function over (query, window) keeps the best ones, map side first.

So nothing is approximate: bounds are widened by the error of their own arithmetic, and results equal brute force. There are at most
log(CLUSTERS) / log(GROW) + 2 rounds. Mining is two searches: positives (same label, any score), then negatives (other labels), whose
windows are the positives' scores.

Rows: one with a null key, label or vector, or with a null or non-finite entry, takes no part. Where a key is divisible by 7 the label is
moved as the query asks for (relabelled). A vector shorter than the longest goes on with zeros; whole numbers beyond 2**31 - 1 count as
that; scores beyond a long count as the nearest long. A repeated anchor row is an anchor of its own, and its copies are other rows. An
anchor without another row of its label, or without a negative in the window, gives no rows; an empty table gives none. Other columns
aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from portcullis.llm.common import ROW, checkpointed, sample, with_row
from portcullis.llm.vectors import floors, is_whole, matrix, padded, products

SCALE, MOST = 256, (1 << 31) - 1
#: Answers of a search.
WORST = 5
#: Most lists; points of the sample for each; rounds of k-means; lists in the first round of a search and the growth of rounds.
CLUSTERS, SAMPLE, LLOYD, FIRST, GROW = 2048, 32, 6, 8, 8
#: Bytes of the vectors in a block; queries in a chunk.
BLOCK_BYTES, CHUNK = 1 << 19, 256
_NONE = np.iinfo(np.int64).max


@dataclass
class Index:
    """blocks: cluster, block, d, x, label, keys, rows (packed), written. The rest has an entry for each cluster, at most CLUSTERS."""

    blocks: DataFrame
    centroids: np.ndarray
    radius: np.ndarray
    count: np.ndarray

    @property
    def d(self) -> int:
        return self.centroids.shape[1]


def _nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each x, and the distance to it."""
    of, gap = np.zeros(len(x), np.int64), np.zeros(len(x))
    for at in range(0, len(x), 2048):
        part = x[at : at + 2048]
        of[at : at + 2048] = found = ((centroids**2).sum(1) - 2 * part @ centroids.T).argmin(1)
        gap[at : at + 2048] = np.sqrt(((part - centroids[found]) ** 2).sum(1))
    return of, gap


def k_means(x: np.ndarray, k: int, rounds: int = LLOYD) -> np.ndarray:
    """At most k centroids of the vectors x, whose first ones are the start."""
    centroids = np.unique(x[:k], axis=0)
    for _ in range(rounds):
        of, _ = _nearest(x, centroids)
        n = np.bincount(of, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, of, x)
        centroids = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centroids)
    return centroids


def _place(centroids: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The columns of the batches, and cluster and gap of x."""
    for b in batches:
        of, gap = _nearest(matrix(b.column("x"), centroids.shape[1]).astype(np.float64), centroids)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(of.astype(np.int32)), pa.array(gap)], names=[*b.schema.names, "cluster", "gap"])


def placed(df: DataFrame, centroids: np.ndarray) -> DataFrame:
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(partial(_place, centroids), f"{kinds}, cluster int, gap double")


def _pack(t: pa.Table) -> pa.Table:
    """One block: its points' vectors, labels and sorted keys with their rows, the free places at the end."""
    n = t.num_rows
    x = t.column("x").combine_chunks()
    d = len(x.flatten()) // n
    keys, rows = np.full((n, WORST + 1), _NONE), np.full((n, WORST + 1), -1)
    for i, at in enumerate(t.column("at").to_pylist()):
        for j, y in enumerate(at):
            keys[i, j], rows[i, j] = y["key"], y["row"]
    packed = (matrix(x, d).astype(np.int32), t.column("label").to_numpy(), keys, rows)
    return pa.table({"cluster": t.column("cluster").slice(0, 1), "block": t.column("block").slice(0, 1), **{c: pa.array([p.tobytes()], pa.binary()) for c, p in zip(("x", "label", "keys", "rows"), packed, strict=True)}})


def index(rows: DataFrame, d: int, clusters: int | None = None) -> Index:
    """Of rows (row, key, label, x), written. clusters: by default half the square root of the number of points, at most CLUSTERS."""
    first = F.row_number().over(Window.partitionBy("label", "x").orderBy("key", "row"))
    few = rows.withColumn("i", first).where(F.col("i") <= WORST + 1)  # Spark cuts the rows of a group in each task first
    points = checkpointed(few.groupBy("label", "x").agg(F.array_sort(F.collect_list(F.struct("key", "row"))).alias("at")).withColumn("h", F.xxhash64("label", "x")))
    n = points.count()
    k = clusters or int(min(CLUSTERS, max(1, np.ceil(np.sqrt(n) / 2))))
    fitted = sample(points.select("x", "h"), "h", SAMPLE * k).toArrow()
    centroids = k_means(matrix(fitted.column("x").combine_chunks(), d).astype(np.float64), k)
    assigned = checkpointed(placed(points, centroids))
    radius, count = np.zeros(len(centroids)), np.zeros(len(centroids), np.int64)
    for r in assigned.groupBy("cluster").agg(F.max("gap").alias("gap"), F.count("*").alias("n")).collect():  # a row for each cluster
        radius[r["cluster"]], count[r["cluster"]] = r["gap"], r["n"]
    blocks = _blocks(count, d)
    dealt = assigned.join(F.broadcast(_by_cluster(rows, blocks)), "cluster").withColumn("block", F.pmod("h", "blocks").cast("int"))
    packed = dealt.select("cluster", "block", "x", "label", "at").groupBy("cluster", "block").applyInArrow(_pack, "cluster int, block int, x binary, label binary, keys binary, rows binary")
    return Index(checkpointed(packed), centroids, radius, count)


def _blocks(count: np.ndarray, d: int) -> np.ndarray:
    return np.ceil(count / max(1, BLOCK_BYTES // (4 * d))).astype(int)


def _by_cluster(df: DataFrame, blocks: np.ndarray) -> DataFrame:
    """cluster and its number of blocks."""
    return df.sparkSession.createDataFrame([(i, n) for i, n in enumerate(blocks.tolist()) if n], "cluster int, blocks int")


def _pack_queries(t: pa.Table) -> pa.Table:
    """One chunk: vectors, labels, own rows, numbers, and the windows of its queries, empty ones (low above high) at the end."""
    x = t.column("x").combine_chunks()
    windows = t.column("windows").to_pylist()
    ends = np.tile(np.array([1, 0]), (len(windows), max(map(len, windows)), 1))
    for i, w in enumerate(windows):
        ends[i, : len(w)] = [(y["low"], y["high"]) for y in w]
    packed = (matrix(x, len(x.flatten()) // len(windows)).astype(np.int32), t.column("label").to_numpy(), t.column("row").to_numpy(), t.column("query").to_numpy(), ends)
    return pa.table({"chunk": t.column("chunk").slice(0, 1), **{c: pa.array([p.tobytes()], pa.binary()) for c, p in zip(("x", "label", "row", "query", "windows"), packed, strict=True)}})


def chunked(queries: DataFrame, ix: Index) -> DataFrame:
    """Queries in chunks of about CHUNK. A chunk's queries have neighbouring home clusters; a home with many is several chunks."""
    homed = checkpointed(placed(queries, ix.centroids).drop("gap"))
    sizes = {r["cluster"]: r["n"] for r in homed.groupBy("cluster").agg(F.count("*").alias("n")).collect()}  # a row for each cluster
    axis = np.linalg.svd(ix.centroids - ix.centroids.mean(0), full_matrices=False)[2][0]
    deals, chunk, held = [], 0, 0
    for c in sorted(sizes, key=lambda c: float(ix.centroids[c] @ axis)):
        if held and held + sizes[c] > CHUNK:
            chunk, held = chunk + 1, 0
        parts = -(-sizes[c] // CHUNK)
        deals.append((c, chunk, parts))
        chunk, held = (chunk + parts, 0) if parts > 1 else (chunk, held + sizes[c])
    deal = queries.sparkSession.createDataFrame(deals, "cluster int, first long, parts int")
    dealt = homed.join(F.broadcast(deal), "cluster").withColumn("chunk", F.col("first") + F.pmod(F.xxhash64("query"), F.col("parts")))
    return checkpointed(dealt.select("chunk", "query", "row", "label", "x", "windows").groupBy("chunk").applyInArrow(_pack_queries, "chunk long, x binary, label binary, row binary, query binary, windows binary"))


@dataclass
class _Chunk:
    """x, label, row, query: of the queries; ends: the low and high ends of their windows."""

    x: np.ndarray
    label: np.ndarray
    row: np.ndarray
    query: np.ndarray
    ends: np.ndarray

    @classmethod
    def read(cls, b: dict, d: int) -> _Chunk:
        query = np.frombuffer(b["query"], np.int64)
        return cls(np.frombuffer(b["x"], np.int32).reshape(-1, d), np.frombuffer(b["label"], np.int64), np.frombuffer(b["row"], np.int64), query, np.frombuffer(b["windows"], np.int64).reshape(len(query), -1, 2))

    def only(self, at: np.ndarray, ends: np.ndarray) -> dict:
        return {c: p.tobytes() for c, p in (("x", self.x[at]), ("label", self.label[at]), ("row", self.row[at]), ("query", self.query[at]), ("windows", ends[at]))}


def _visits(centroids: np.ndarray, radius: np.ndarray, full: np.ndarray, at: int, upto: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks with the kth scores found so far: a row for each list that some query visits as its at-th to upto-th, with those queries.

    A low end is raised to the kth score: below it nothing can be among the best. cluster is null in a row that says that a query
    has more lists to visit after these."""
    names = ("x", "label", "row", "query", "windows")
    for b in batches:
        out: list[dict] = []
        for r in b.to_pylist():
            c = _Chunk.read(r, centroids.shape[1])
            ends = c.ends.copy()
            place = {q: i for i, q in enumerate(c.query.tolist())}
            for k in r["kth"] or ():
                i, w = place[k["query"]], k["window"]
                ends[i, w, 0] = max(ends[i, w, 0], k["score"])
            q = c.x.astype(np.float64)
            mid, reach = q @ centroids.T, np.sqrt((q**2).sum(1))[:, None] * radius
            slack = 1 + 1e-9 * (np.abs(mid) + reach + np.sqrt((q**2).sum(1))[:, None] * np.sqrt((centroids**2).sum(1)))  # more than rounding can do
            high, low = mid + reach + slack, mid - reach - slack
            order = np.argsort(-np.where(full, high, -np.inf), axis=1, kind="stable")[:, : int(full.sum())]
            # a window is open for a list whose scores may lie in it
            open_ = ((ends[:, :, 0] <= ends[:, :, 1])[:, :, None] & (high[:, None] >= ends[:, :, :1]) & (low[:, None] <= ends[:, :, 1:])).any(1)
            now = np.zeros_like(open_)
            np.put_along_axis(now, order[:, at:upto], True, 1)
            for cluster in np.flatnonzero((now & open_).any(0)).tolist():
                out.append({"cluster": cluster} | c.only(np.flatnonzero((now & open_)[:, cluster]), ends))
            later = np.zeros_like(open_)
            np.put_along_axis(later, order[:, upto:], True, 1)
            if (later & open_).any():
                out.append({"cluster": None} | dict.fromkeys(names))
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("cluster", pa.int32()), *((c, pa.binary()) for c in names)]))


def _best(scores: np.ndarray, allowed: np.ndarray, keys: np.ndarray, rows: np.ndarray, own: int) -> list[tuple[int, int]]:
    """The best WORST (score, key) of a block for one query and window: higher scores, then smaller keys, not the query's own row."""
    at = np.flatnonzero(allowed)
    if len(at) > WORST + 1:
        cut = np.partition(scores[at], len(at) - WORST - 1)[len(at) - WORST - 1]
        at = at[scores[at] >= cut]
        at = at[np.lexsort((keys[at, 0], -scores[at]))][: WORST + 1]
    found = [(int(scores[i]), int(k)) for i in at for k, r in zip(keys[i], rows[i], strict=True) if r >= 0 and r != own]
    return sorted(found, key=lambda y: (-y[0], y[1]))[:WORST]


def _score(d: int, same: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a chunk's visiting queries and a block: query, window, score, key."""
    for b in batches:
        out: list[tuple[int, int, int, int]] = []
        for r in b.to_pylist():
            c = _Chunk.read(r, d)
            label = np.frombuffer(r["b_label"], np.int64)
            keys, rows = np.frombuffer(r["keys"], np.int64).reshape(len(label), -1), np.frombuffer(r["rows"], np.int64).reshape(len(label), -1)
            scores = products(c.x, np.frombuffer(r["b_x"], np.int32).reshape(-1, d))
            for i, q in enumerate(c.query.tolist()):
                fits = (label == c.label[i]) == same
                for w, (low, high) in enumerate(c.ends[i].tolist()):
                    if low <= high:
                        out += [(q, w, *y) for y in _best(scores[i], fits & (scores[i] >= low) & (scores[i] <= high), keys, rows, int(c.row[i]))]
        columns = np.array(out, np.int64).reshape(-1, 4)
        yield pa.RecordBatch.from_arrays([pa.array(columns[:, 0]), pa.array(columns[:, 1].astype(np.int32)), pa.array(columns[:, 2]), pa.array(columns[:, 3])], names=["query", "window", "score", "key"])


def search(ix: Index, queries: DataFrame, same: bool) -> DataFrame:
    """query, window, rank, score, key: the best WORST of each window of the queries (query, row, label, x, windows of low and high ends).

    Candidates have the query's label if same, else another; the row called row is no candidate."""
    chunks = chunked(queries, ix)
    full = ix.count > 0
    blocks = F.broadcast(_by_cluster(queries, _blocks(ix.count, ix.d)))
    packed = ix.blocks.select("cluster", "block", F.col("x").alias("b_x"), F.col("label").alias("b_label"), "keys", "rows")
    chunk_of = checkpointed(chunks.select("chunk", "query").mapInArrow(_names, "chunk long, query long"))
    rank = F.row_number().over(Window.partitionBy("query", "window").orderBy(F.desc("score"), "key"))
    best, at, upto = None, 0, FIRST
    while True:
        if best is None:
            known = chunks.withColumn("kth", F.lit(None).cast("array<struct<query: long, window: int, score: long>>"))
        else:  # at most CHUNK queries of a chunk, with a number for each window
            kth = best.where(F.col("rank") == WORST).join(chunk_of, "query").groupBy("chunk").agg(F.collect_list(F.struct("query", "window", "score")).alias("kth"))
            known = chunks.join(kth, "chunk", "left")
        kinds = ", ".join(f"{c} binary" for c in ("x", "label", "row", "query", "windows"))
        step = partial(_visits, ix.centroids, ix.radius, full, at, upto)
        visits = checkpointed(known.drop("chunk").mapInArrow(step, f"cluster int, {kinds}"))
        met = visits.join(blocks, "cluster").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(packed, ["cluster", "block"])
        found = met.drop("cluster", "block", "blocks").mapInArrow(partial(_score, ix.d, same), "query long, window int, score long, key long")
        if best is not None:
            found = found.unionByName(best.drop("rank"))
        best = checkpointed(found.withColumn("rank", rank).where(F.col("rank") <= WORST))
        if upto >= full.sum() or visits.where("cluster IS NULL").isEmpty():
            return best
        at, upto = upto, upto + (upto - at) * GROW


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, query): the numbers of the chunk's queries."""
    for b in batches:
        for chunk, packed in zip(b.column("chunk").to_pylist(), b.column("query").to_pylist(), strict=True):
            query = np.frombuffer(packed, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(query), chunk)), pa.array(query)], names=["chunk", "query"])


def relabelled(key: Column, label: Column) -> Column:
    """Where the key is divisible by 7, the next label of ten."""
    return F.when(key % 7 == 0, (label + 1) % 10).otherwise(label)


def mine(table: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", anchors: Callable[[Column], Column] = lambda k: k % 100 == 0, label_of: Callable[[Column, Column], Column] = lambda k, y: y, low: int = 80, clusters: int | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    The negatives of a positive score at least low percent of it, and at most as much as it."""
    k, y = F.col(f"`{key}`").cast("long"), F.col(f"`{label}`").cast("long")
    names = table.columns
    aside = table.toDF(*[n if n.lower() != ROW else f"{ROW}_of_table" for n in names]) if vector != ROW else table
    rows = with_row(aside.select(*[F.col(f"`{c}`") for c in (key, vector, label)])).where(k.isNotNull() & y.isNotNull() & is_whole(vector))
    rows, d = padded(checkpointed(rows.select(F.col(ROW).alias("row"), k.alias("key"), label_of(k, y).alias("label"), floors(vector, SCALE, MOST, "int").alias("x"))), "x", 0)
    spark = table.sparkSession
    kind = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not d:
        return spark.createDataFrame([], kind)
    ix = index(rows, d, clusters)
    asked = checkpointed(rows.where(anchors(F.col("key"))).select(F.col("row").alias("query"), "row", "key", "label", "x"))
    any_score = F.array(F.struct(F.lit(-(1 << 63)).cast("long").alias("low"), F.lit((1 << 63) - 1).cast("long").alias("high")))
    positives = search(ix, asked.select("query", "row", "label", "x", any_score.alias("windows")), same=True)
    positives = positives.where("score >= 0").select("query", F.col("rank").alias("place"), F.col("key").alias("positive_id"), F.col("score").alias("positive_score"))
    # no whole number lies between low percent of a negative score and that score
    window = F.struct(F.ceil(F.col("positive_score").cast("decimal(38,0)") * low / 100).cast("long").alias("low"), F.col("positive_score").alias("high"))
    scores = positives.groupBy("query").agg(F.sort_array(F.collect_set("positive_score")).alias("scores"), F.sort_array(F.collect_set(window)).alias("windows"))  # at most WORST
    wanted = checkpointed(asked.join(scores, "query"))
    negatives = search(ix, wanted.select("query", "row", "label", "x", "windows"), same=False)
    scored = negatives.join(wanted.select("query", "windows", F.col("key").alias("anchor_id")), "query").withColumn("positive_score", F.col("windows")[F.col("window")]["high"])
    out = positives.join(scored.withColumnsRenamed({"key": "negative_id", "score": "negative_score"}), ["query", "positive_score"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
