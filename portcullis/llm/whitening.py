"""Whitening of embeddings by a tiled covariance.

A component c of a vector becomes x = floor(SCALE * c) + SHIFT. The fit list has each distinct x vector once, found by one
aggregation, so that a vector which a third of all rows repeats counts once and is one row after the map side. Of its n
vectors with the sums S, all from whole numbers without rounding:

    x-vectors -> n, S                                   sums of batches, added up by Spark
      -> row blocks, cut into column blocks of TILE     centred first: (n * x - S) / n, the numerator exact
      -> joined with themselves by row block            each pair of column blocks I <= J is a part of tile (I, J)
      -> products, added up within a task, then by tile
      -> driver: the covariance (a number for each pair of dimensions), its eigenvectors
      -> every row: centred, projected, scaled          and, over the fit list, the covariance of the result

A task holds a row block (at most BLOCK numbers) and HELD tiles. The driver holds d x d numbers for d dimensions, so d is what
bounds it, not the rows.

Rows: one whose vector is null or holds null or a number that isn't finite is left out. A vector shorter than the longest goes on
with zeros. Entries beyond 2**44 count as that. Directions without variance (eigenvalue at most 1e-12 of the greatest) have no
rows, since nothing can be scaled by them; an empty table, one distinct vector or vectors without entries give no rows. deviation is null
where a long can't hold it. Repeated rows and null keys give rows like any other. Other columns aren't read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portcullis.llm.common import checkpointed
from portcullis.llm.vectors import floors, is_whole, matrix, padded

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
TILE = 32
#: Numbers in a row block; rows of one at most; tiles that a task adds up before it hands them on; largest number.
BLOCK, BLOCK_ROWS, HELD, MOST = 1 << 21, 1024, 1024, 1 << 44
_SUM_ROWS = 1 << 17


def _deviations(x: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    """n * x - S, exact; Python's numbers where a long is too short."""
    if not x.size:
        return x
    if n * int(np.abs(x).max()) + max(map(abs, s)) < 1 << 62:
        return n * x - np.array(s, np.int64)
    return n * x.astype(object) - np.array(s, object)


def _batches(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[np.ndarray]:
    """x of the batches, at most BLOCK numbers at a time."""
    rows = max(1, min(BLOCK_ROWS, BLOCK // d))
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield matrix(b.column("x").slice(at, rows), d)


def _sums(d: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (i, s): sums of the dimensions over at most _SUM_ROWS vectors each; i = -1 counts vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.arange(-1, d, dtype=np.int32)), pa.array(np.concatenate([[n], s]))], names=["i", "s"])

        s, n = np.zeros(d, np.int64), 0
        for x in _batches(batches, d):
            s += x.sum(0)
            n += len(x)
            if n >= _SUM_ROWS:
                yield out()
                s, n = np.zeros(d, np.int64), 0
        if n:
            yield out()

    return run


def _column_blocks(d: int, n: int, s: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (block, part, cells): the centred numbers of a row block in TILE dimensions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, x in enumerate(_batches(batches, d)):
            centred = (_deviations(x, n, s) / n).astype(np.float64)
            cells = [np.ascontiguousarray(centred[:, at : at + TILE]).tobytes() for at in range(0, d, TILE)]
            block = np.full(len(cells), (TaskContext.get().partitionId() << 32) + k, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(np.arange(len(cells), dtype=np.int32)), pa.array(cells, pa.binary())], names=["block", "part", "cells"])

    return run


def _tiles(sums: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
    keys = list(sums)
    b = pa.RecordBatch.from_arrays([pa.array([i for i, _ in keys], pa.int32()), pa.array([j for _, j in keys], pa.int32()), pa.array([sums[k].tobytes() for k in keys], pa.binary())], names=["i", "j", "tile"])
    sums.clear()
    return b


def _multiply(d: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (i, left, j, right), two column blocks of a row block: sums of their products by tile."""
    width = lambda part: min(TILE, d - part * TILE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for i, left, j, right in zip(*(b.column(c).to_pylist() for c in ("i", "left", "j", "right")), strict=True):
                tile = np.frombuffer(left).reshape(-1, width(i)).T @ np.frombuffer(right).reshape(-1, width(j))
                sums[i, j] = sums[i, j] + tile if (i, j) in sums else tile
                if len(sums) >= HELD:
                    yield _tiles(sums)
        yield _tiles(sums)

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (i, j, tile), those of a tile in this task, in order: their sums."""
    now, total = None, np.zeros(0)
    for b in batches:
        for i, j, tile in zip(*(b.column(c).to_pylist() for c in ("i", "j", "tile")), strict=True):
            if (i, j) == now:
                total = total + np.frombuffer(tile)
                continue
            if now:
                yield _tiles({now: total})
            now, total = (i, j), np.frombuffer(tile)
    if now:
        yield _tiles({now: total})


def covariance(fit: DataFrame, d: int, n: int, s: list[int]) -> np.ndarray:
    """The d x d covariance, divisor n, of the vectors x of fit, written, whose number is n and whose sums are s."""
    blocks = fit.select("x").mapInArrow(_column_blocks(d, n, s), "block long, part int, cells binary")
    left, right = blocks.select("block", F.col("part").alias("i"), F.col("cells").alias("left")), blocks.select("block", F.col("part").alias("j"), F.col("cells").alias("right"))
    pairs = left.join(right, "block").where("i <= j").select("i", "left", "j", "right")
    parts = pairs.mapInArrow(_multiply(d), "i int, j int, tile binary")
    found = parts.repartition("i", "j").sortWithinPartitions("i", "j").mapInArrow(_add, "i int, j int, tile binary").collect()  # d * d numbers
    v = np.zeros((d, d))
    for r in found:
        rows, columns = slice(r["i"] * TILE, min(d, (r["i"] + 1) * TILE)), slice(r["j"] * TILE, min(d, (r["j"] + 1) * TILE))
        v[rows, columns] = np.frombuffer(r["tile"]).reshape(rows.stop - rows.start, -1)
        v[columns, rows] = v[rows, columns].T
    return v / n


def principal(v: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns), the largest entry of each positive; those with variance, at most so many."""
    e, w = np.linalg.eigh(v)
    order = np.argsort(-e, kind="stable")[:most]
    order = order[(e[order] > 0) & (e[order] > 1e-12 * e.max())]
    w = w[:, order]
    return e[order], w * np.sign(w[np.abs(w).argmax(0), np.arange(len(order))])


def _projected(x: np.ndarray, n: int, s: list[int], e: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n * x - S, and the whitened vectors."""
    deviation = _deviations(x, n, s)
    return deviation, (deviation / n).astype(np.float64) @ w / np.sqrt(e)


def _moments(d: int, n: int, s: list[int], e: np.ndarray, w: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (i, s): of the whitened vectors, their sums (k numbers) and those of their products (k * k)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(e) + len(e) ** 2)
        for x in _batches(batches, d):
            white = _projected(x, n, s, e, w)[1]
            total += np.concatenate([white.sum(0), (white.T @ white).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["i", "s"])

    return run


def _squares(deviation: np.ndarray) -> list[int | None]:
    """Exact sums of squares, None beyond a long."""
    if not deviation.size:
        return [0] * len(deviation)
    if deviation.dtype != object and int(np.abs(deviation).max()) ** 2 * deviation.shape[1] < 1 << 63:
        return (deviation**2).sum(1).tolist()
    found = (sum(int(y) ** 2 for y in row) for row in deviation)
    return [y if y < 1 << 63 else None for y in found]


def _whiten(d: int, n: int, s: list[int], e: np.ndarray, w: np.ndarray, explained: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(e)
        for b in batches:
            for at in range(0, b.num_rows, BLOCK_ROWS):
                part = b.slice(at, BLOCK_ROWS)
                deviation, white = _projected(matrix(part.column("x"), d), n, s, e, w)
                rows = pa.array(np.repeat(np.arange(part.num_rows), k))
                yield pa.RecordBatch.from_arrays([part.column("key").take(rows), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), part.num_rows)), pa.array(_squares(deviation), pa.int64()).take(rows), pa.array(white.ravel()), pa.array(np.tile(explained, part.num_rows))], names=["key", "component", "deviation", "whitened", "explained"])

    return run


def whiten(table: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """For each row with a whole vector and each component: key, component, n, deviation, whitened, explained, identity_error."""
    kind = table.schema[key].dataType.simpleString()
    rows = table.where(is_whole(vector)).select(F.col(f"`{key}`").alias("key"), F.transform(floors(vector, SCALE, MOST), lambda c: c + SHIFT).alias("x"))
    rows, d = padded(checkpointed(rows), "x", SHIFT)
    none = table.sparkSession.createDataFrame([], f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    if not d:
        return none
    fit = checkpointed(rows.select("x").distinct())
    totals: dict[int, int] = defaultdict(int)
    for r in fit.mapInArrow(_sums(d), "i int, s long").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():  # d + 1 numbers
        totals[r["i"]] = int(r["s"])
    n, s = totals[-1], [totals[i] for i in range(d)]
    v = covariance(fit, d, n, s)
    e, w = principal(v, components)
    if not len(e):
        return none
    k = len(e)
    m = {r["i"]: r["s"] for r in fit.mapInArrow(_moments(d, n, s, e, w), "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()}  # k + k * k numbers
    mean = np.array([m[i] for i in range(k)]) / n
    error = np.abs(np.array([m[k + i] for i in range(k * k)]).reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max()
    out = rows.mapInArrow(_whiten(d, n, s, e, w, e / np.trace(v)), f"key {kind}, component int, deviation long, whitened double, explained double")
    return out.select(F.col("key").alias(key), "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(float(error)).alias("identity_error"))
