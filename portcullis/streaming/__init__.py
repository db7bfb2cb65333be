"""Scans over a stream of source files.

The engine's own entities have no event time. ``scan_stream`` scans each batch on its own, so bindings of a Go package reach over the files of
one batch only. ``scan_packages`` keeps what was parsed: a batch's files are parsed and written by scope, and every scope that they belong to is routed
anew over all its files so far, each in its last form. A file that binds a name thus corrects what was said of files that came before it, and the
results of a scope are those of a batch scan over its files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from portcullis.checkpoints import checkpointed
from portcullis.operators import findings, scan
from portcullis.operators.scan import Scan
from portcullis.rules import Rule

#: Folders into which the state of a stream is dealt by scope; a batch reads those of its scopes alone.
BUCKETS = 64


def scan_stream(files: DataFrame, rules: list[Rule], sink: Callable[[DataFrame, DataFrame, int], None], checkpoint: str, **options) -> StreamingQuery:
    """files: a streaming DataFrame of (path, content). sink gets findings, enforcement points and the batch's number."""

    def batch(df: DataFrame, n: int) -> None:
        s = Scan(df, rules, **options)
        sink(s.findings, s.enforcement_points, n)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()


def routed_batch(df: DataFrame, n: int, rules: list[Rule], state: str, least: str | None = None, categories: list[str] = (), languages: list[str] = (), excludes: list[str] = ()) -> tuple[Scan, DataFrame]:
    """The scan of all scopes of a batch's files, over their files of this and earlier batches, and those files (file, scope).

    What a batch parsed goes to state once, under its number, so a batch that is run again writes the same."""
    spark = df.sparkSession
    one = scan.parsed(scan.selected(df, languages, excludes), rules, all_edges=True).withColumn("scope", findings.scope())
    with scan.small_batches(spark):
        one.withColumn("bucket", F.pmod(F.xxhash64("scope"), F.lit(BUCKETS)).cast("int")).write.mode("overwrite").partitionBy("bucket").parquet(f"{state}/batch={n}")
    try:
        new = spark.read.parquet(f"{state}/batch={n}")
    except AnalysisException:  # no file was parsed
        return Scan.of_parsed(checkpointed(one.limit(0)), rules, least, categories), one.limit(0).select("file", "scope")
    scopes = checkpointed(new.select("bucket", "scope").distinct())
    buckets = [r["bucket"] for r in scopes.select("bucket").distinct().collect()]  # at most BUCKETS
    so_far = spark.read.schema(new.schema.add("batch", "long")).parquet(state).where(F.col("bucket").isin(buckets) & (F.col("batch") <= n))
    of_scopes = so_far.join(scopes.select("scope"), "scope", "left_semi")
    last = F.rank().over(Window.partitionBy("file").orderBy(F.desc("batch")))  # the rows of each batch that had the file
    kept = checkpointed(of_scopes.withColumn("__n", last).where("__n = 1").drop("__n", "batch", "bucket"))
    return Scan.of_parsed(kept, rules, least, categories), kept.select("file", "scope").distinct()


def scan_packages(files: DataFrame, rules: list[Rule], sink: Callable[[DataFrame, DataFrame, DataFrame, int], None], state: str, checkpoint: str, **options) -> StreamingQuery:
    """files: a streaming DataFrame of (path, content); state: a folder that driver and workers share.

    sink gets findings, enforcement points, the files that they are about (file, scope), and the batch's number. They take the place of all
    that earlier batches said about those files."""

    def batch(df: DataFrame, n: int) -> None:
        s, about = routed_batch(df, n, rules, state, **options)
        sink(s.findings, s.enforcement_points, about, n)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
