"""What the operators on embeddings share: whole numbers from vectors, and exact products of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_whole(vector: str) -> Column:
    """The vector isn't null and holds no null and no number that isn't finite."""
    v = F.col(f"`{vector}`").cast("array<double>")
    return v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))


def floors(vector: str, scale: int, most: int, kind: str = "long") -> Column:
    """floor(scale * entry) of every entry, cut to -most ... most."""
    return F.transform(F.col(f"`{vector}`").cast("array<double>"), lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(float(most))), F.lit(float(-most)))).cast(kind))


def padded(df: DataFrame, vector: str, fill: int) -> tuple[DataFrame, int]:
    """df, written, with vectors of one length, and that length; shorter ones go on with fill."""
    least, most = df.agg(F.min(F.size(vector)), F.max(F.size(vector))).first()
    if not most or least == most:
        return df, most or 0
    kind = df.schema[vector].dataType.elementType.simpleString()
    return df.withColumn(vector, F.concat(vector, F.array_repeat(F.lit(fill).cast(kind), F.lit(most) - F.size(vector)))), most


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """The vectors of an Arrow column of lists, as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers, as longs; one that a long can't hold becomes the nearest that it can."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = int(np.abs(a.astype(np.int64)).max()) * int(np.abs(b.astype(np.int64)).max()) * a.shape[1]
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 1 << 63:
        return a.astype(np.int64) @ b.astype(np.int64).T
    return np.clip(a.astype(object) @ b.astype(object).T, -(1 << 63), (1 << 63) - 1).astype(np.int64)
