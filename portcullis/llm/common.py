"""What the operators share: tables, fold numbers, checkpoints and row identity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from portcullis.checkpoints import checkpointed
from portcullis.checkpoints import folder as checkpoint_folder

__all__ = ["BROADCAST_KEYS", "ROW", "checkpoint_folder", "checkpointed", "filtered", "fold", "join_groups", "only", "sample", "table", "with_row", "without"]

ROW = "__row"
#: Most 64-bit keys that are broadcast to filter a table before a shuffle: some 32 MB. Beyond it the table is shuffled.
BROADCAST_KEYS = 1_000_000


#: Rows of an Arrow batch between the JVM and Python, at most; some megabytes of texts.
BATCH_ROWS = 2000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table. Batches of more than BATCH_ROWS rows are made smaller for the session, as both sides hold several at a time."""
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str, n: int) -> Column:
    """crc32 of the key as text, modulo n; a null key counts as the empty string."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(n)).cast("int")


def sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """df if it has at most so many rows, else the ones with the smallest hashes of their key, at most so many.

    A cut-off of the hash comes first, so a partition hands on its share of the sample only, however many partitions there are."""
    n = df.count()
    if n <= most:
        return df
    hashed = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 40))
    return df.withColumn("__h", hashed).where(F.col("__h") <= int((1 << 40) * min(1.0, 1.2 * most / n))).orderBy("__h", *df.columns).limit(most).drop("__h")


#: Rows that a file may have, as bits; files that are numbered at most.
FILE_BITS, FILES = 36, 1_000_000


def _is_plain_scan(df: DataFrame) -> bool:
    """df is a file scan with nothing above it but projections and filters."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias") and plan.children().size() == 1:
        plan = plan.children().apply(0)
    return plan.nodeName().startswith("LogicalRelation")


def with_row(df: DataFrame) -> DataFrame:
    """Adds ROW, a number for each row that is the same in every later run of the plan.

    Of a Parquet scan it is the file's number and the row's place in it, whatever the splits, which may change with the number of
    executors. Any other plan is written first, with running numbers."""
    if _is_plain_scan(df):
        try:
            found = df.select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index")).select("f").distinct().limit(FILES + 1).collect()
        except AnalysisException:  # a format without row numbers, or a column called _metadata
            found = None
        if found is not None and len(found) <= FILES:
            files = df.sparkSession.createDataFrame([(r["f"], i << FILE_BITS) for i, r in enumerate(sorted(found))], "__portcullis_file string, __portcullis_first long")
            placed = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() != ROW], F.col("_metadata.file_path").alias("__portcullis_file"), F.col("_metadata.row_index").alias("__portcullis_at"))
            return placed.join(F.broadcast(files), "__portcullis_file").withColumn(ROW, F.col("__portcullis_first") + F.col("__portcullis_at")).drop("__portcullis_file", "__portcullis_first", "__portcullis_at")
    return checkpointed(df.withColumn(ROW, F.monotonically_increasing_id()))


def filtered(docs: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """keep(docs with ROW), with the columns of docs alone; a column of docs that has ROW's name is put aside meanwhile."""
    names = docs.columns
    aside = [n if n.lower() != ROW else ROW + "_of_docs" + "_" * max(map(len, names)) for n in names]
    return keep(with_row(docs.toDF(*aside))).select(*[F.col(f"`{n}`") for n in aside]).toDF(*names)


def only(df: DataFrame, keys: DataFrame, key: str = ROW) -> DataFrame:
    """The rows of df whose key is among keys, which is written and has that column alone."""
    small = keys.count() <= BROADCAST_KEYS
    return df.join(F.broadcast(keys) if small else keys, key, "left_semi")


#: Rows that a group may have, as a share of all rows and at least, to meet its rows by a shuffle.
TIER, LARGE = 100_000, 2_000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """rows with the columns of their groups. Both are written; groups has a row for each key, with the number of its rows as size.

    Groups of more than a TIERth of all rows (and more than LARGE), so fewer than TIER, are broadcast: their rows stay where they
    are, however many they are. The rows of the others, few of each key, are shuffled."""
    total = groups.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    cut = max(LARGE, total // TIER)
    large, small = groups.where(F.col(size) > cut), groups.where(F.col(size) <= cut)
    if large.isEmpty():
        return rows.join(groups, key)
    hot = rows.join(F.broadcast(large), key)
    return hot.unionByName(rows.join(F.broadcast(large.select(key)), key, "left_anti").join(small, key))


def without(df: DataFrame, keys: DataFrame, key: str = ROW) -> DataFrame:
    """The rows of df whose key isn't among keys, which is written and has that column alone."""
    small = keys.count() <= BROADCAST_KEYS
    return df.join(F.broadcast(keys) if small else keys, key, "left_anti")
