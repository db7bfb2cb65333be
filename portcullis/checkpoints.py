"""Tables that are computed once and written to the shared folder of spark.checkpoint.dir."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The shared folder. Only on one machine, and only where the session names none, a folder of our own is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="portcullis-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    folder(df.sparkSession)
    return df.checkpoint()
