"""Results that are read page by page.

A result is written once: every row gets its place in the order (a prefix sum over ranges, so no task orders it all), rows of a page go to a
folder of its own, and a cursor names the result and the next page. Reading a page reads that folder alone, whatever the size of the rest."""

from __future__ import annotations

import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portcullis import checkpoints
from portcullis.operators import prefix

#: Rows of a page; at most.
ROWS, MOST = 1000, 10_000


class CursorError(ValueError):
    pass


def _folder(spark: SparkSession, result: str) -> str:
    return f"{checkpoints.folder(spark)}/pages-{result}"


def write(df: DataFrame, order: list[str], rows: int = ROWS) -> str | None:
    """Writes df in pages; the cursor of the first, or None if there are no rows. order tells all rows apart."""
    rows = max(1, min(rows, MOST))
    result = uuid.uuid4().hex
    placed = prefix.places(df, order, "__place").withColumn("__page", F.floor((F.col("__place") - 1) / rows).cast("int"))
    placed.repartition("__page").sortWithinPartitions("__page", "__place").write.partitionBy("__page").parquet(_folder(df.sparkSession, result))
    return f"{result}:0" if _there(df.sparkSession, result, 0) is not None else None


def _there(spark: SparkSession, result: str, page: int) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{_folder(spark, result)}/__page={page}")
    except AnalysisException:
        return None


def read(spark: SparkSession, cursor: str) -> tuple[DataFrame, str | None]:
    """The rows of a cursor's page, in order, and the cursor of the next page, if there is one."""
    if not re.fullmatch(r"[0-9a-f]{32}:\d{1,9}", cursor):
        raise CursorError(f"no cursor: {cursor}")
    result, page = cursor.split(":")
    found = _there(spark, result, int(page))
    if found is None:
        raise CursorError(f"no such page: {cursor}")
    after = int(page) + 1
    return found.orderBy("__place").drop("__place"), f"{result}:{after}" if _there(spark, result, after) is not None else None
