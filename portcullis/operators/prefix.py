"""Sums, maxima and places along an order, over many tasks.

A window over all rows, or over all rows of one large group, is one task. Here rows are dealt by ranges of the order, a window runs
within each range, and what comes before a range is carried in from a table with a row or two for each range: so a group
may have any share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from portcullis.checkpoints import checkpointed

PART = "__part"


def ranged(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """df, written, with PART, the number of a row's range of (by, order)."""
    return checkpointed(df.repartitionByRange(*by, *order).withColumn(PART, F.spark_partition_id()))


def before(dealt: DataFrame, by: list[str], order: list[str], **what: tuple[str, Column]) -> DataFrame:
    """Adds, for each name, the sum or max of a column over the rows that come before in order, among those with the same by; null if
    there are none.

    Rows that order and by don't tell apart come in any order. dealt: from ranged with the same by and order."""
    kinds = {"sum": F.sum, "max": F.max}
    within = Window.partitionBy(PART, *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumns({name: kinds[kind](column).over(within) for name, (kind, column) in what.items()})
    total = dealt.groupBy(PART, *by).agg(*[kinds[kind](column).alias(f"__of_{name}") for name, (kind, column) in what.items()])
    if by:  # a key that ends one range and begins the next: the only ones that carry anything on
        total = total.withColumn("__n", F.count("*").over(Window.partitionBy(*by))).where("__n > 1")
    # at most two rows for each range
    earlier = Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    carried = total.select(F.col(PART).alias("__p"), *[F.col(c).alias(f"__by_{c}") for c in by], *[kinds[kind](f"__of_{name}").over(earlier).alias(f"__in_{name}") for name, (kind, _) in what.items()])
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__by_{c}")) for c in by], F.col(PART) == F.col("__p"))
    out = local.join(F.broadcast(carried), same, "left")
    join = {"sum": lambda a, b: F.coalesce(a + b, a, b), "max": lambda a, b: F.greatest(a, b)}
    return out.select(*[c for c in dealt.columns if c not in what], *[join[kind](F.col(name), F.col(f"__in_{name}")).alias(name) for name, (kind, _) in what.items()])


def places(df: DataFrame, order: list[str], name: str = "place", by: list[str] = ()) -> DataFrame:
    """Adds a row's place in order, from 1, among the rows with the same by."""
    by = list(by)
    return before(ranged(df, by, order), by, order, **{name: ("sum", F.lit(1))}).withColumn(name, (F.coalesce(F.col(name), F.lit(0)) + 1).cast("int")).drop(PART)


def islands(df: DataFrame, by: list[str], start: str, end: str, gap: int, *order: str) -> DataFrame:
    """df, written, with ``island``: the start of the first of a run of ranges (start, end) of which each begins at most gap after
    the greatest end before it. order: more columns, for a stable order."""
    line = [start, end, *order]
    dealt = ranged(df, by, line)
    last = before(dealt, by, line, __last=("max", F.col(end)))
    head = last.withColumn("__head", F.when(F.col("__last").isNull() | (F.col("__last") + gap < F.col(start)), F.col(start)))
    out = before(head, by, line, island=("max", F.col("__head")))
    return out.withColumn("island", F.greatest("__head", "island")).drop(PART, "__last", "__head")
