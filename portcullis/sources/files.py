"""Source trees as DataFrames of (path, content)."""

from __future__ import annotations

import json
import os
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portcullis.functions import paths
from portcullis.sources import tree
from portcullis.sources.ignore import exclusion_patterns, from_lines, glob_pattern, ignore_rules

__all__ = ["exclusion_patterns", "glob_pattern", "ignore_rules", "source_files"]

#: How deep ignore files are looked for in stores that only Spark reads.
DEPTH = 24


def source_files(spark: SparkSession, root: str, excludes: list[str] = (), rules: list[tuple[str, bool]] = (), ignore: bool = False) -> DataFrame:
    """SOURCE_FILES of known languages below root. Hidden, excluded and ignored files, and text that isn't valid UTF-8, are left out.

    rules: (pattern, keeps), as ignore_rules gives them. ignore: the tree's own ignore files count, without being listed first. Trees are
    read by the ``source_tree`` format; a worker that doesn't see a local folder fails. A store that Arrow can't open is read by Spark's own
    reader, with the path filters before the content; that one passes over names that begin with ``_``."""
    if os.path.isdir(root) or "://" in root and tree.Store.opens(root):
        tree.register(spark)
        top = root if "://" in root else str(Path(root).resolve())
        n = max(64, 8 * spark.sparkContext.defaultParallelism)
        given = {"excludes": "\n".join(excludes), "rules": json.dumps(list(rules)), "ignore": str(ignore).lower(), "partitions": n}
        return spark.read.format(tree.FORMAT).options(**given).load(top)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = re.escape(re.sub("^[a-z0-9]+:(//[^/]*)?", "", root).rstrip("/"))
    relative = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:(//[^/]*)?", ""), f"^.*?{base}/", "")
    kept = raw.select(relative.alias("path"), "content").where(~F.col("path").rlike(r"(^|/)\.") & paths.language(F.col("path")).isNotNull())
    for p in exclusion_patterns(list(excludes)):
        kept = kept.where(~F.col("path").rlike(p))
    rules = [*rules, *(_ignore_files(spark, root) if ignore else [])]
    if rules:
        ignored = F.lit(False)
        for p, keeps in rules:
            ignored = F.when(F.col("path").rlike(p), F.lit(not keeps)).otherwise(ignored)
        kept = kept.where(~ignored)
    text = F.col("content").cast("string")
    return kept.where(F.is_valid_utf8(text)).select("path", text.alias("content"))


def _ignore_files(spark: SparkSession, root: str) -> list[tuple[str, bool]]:
    """Rules of the ignore files of a tree that only Spark's file systems open, from the outside in, level by level. Spark's reader hides
    names that begin with a dot."""
    jvm, out = spark._jvm, []
    store = jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for k in range(DEPTH):
        for status in store.globStatus(jvm.org.apache.hadoop.fs.Path(root.rstrip("/") + "/" + "*/" * k + ".gitignore")) or ():
            prefix = "".join(f"{x}/" for x in str(status.getPath()).split("/")[-k - 1 : -1])
            if not re.search(r"(^|/)\.", prefix):
                stream = store.open(status.getPath())
                try:
                    out += from_lines(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").splitlines(), prefix)
                finally:
                    stream.close()
    return out
