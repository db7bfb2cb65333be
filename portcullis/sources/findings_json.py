"""Findings as JSON: a report with ``findings``, or a bare list of them, with the fields of older versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from portcullis import model

_WIRE = model.FINDINGS.replace("bigint", "bigint") + ", rego_stub string, cedar_stub string"
_ITEM = "struct<" + ", ".join(x.strip().replace(" ", ":", 1) for x in _WIRE.replace(model.POLICY_OUTPUTS, "\0").split(",")).replace("\0", model.POLICY_OUTPUTS) + ">"


def outputs(given: Column, rego_stub: Column, cedar_stub: Column) -> Column:
    """Policy outputs, the first of each engine; stubs of the older form only where an engine has none."""
    first = lambda engine, stub: F.coalesce(F.get(F.filter(F.coalesce(given, F.array().cast(model.POLICY_OUTPUTS)), lambda x: x["engine"] == engine), F.lit(0)), F.when(stub.isNotNull(), F.struct(F.lit(engine).alias("engine"), stub.alias("content"))))
    return F.filter(F.array(first("rego", rego_stub), first("cedar", cedar_stub)), lambda x: x.isNotNull())


def parse(texts: DataFrame, column: str = "value") -> DataFrame:
    """FINDINGS of JSON documents."""
    wrapped = F.from_json(F.col(column), f"struct<findings:array<{_ITEM}>>")["findings"]
    bare = F.from_json(F.col(column), f"array<{_ITEM}>")
    f = texts.select(F.explode(F.when(F.col(column).rlike(r"^\s*\["), bare).otherwise(wrapped)).alias("f")).select("f.*")
    f = f.withColumn("policy_outputs", outputs(F.col("policy_outputs"), F.col("rego_stub"), F.col("cedar_stub"))).drop("rego_stub", "cedar_stub")
    return f.withColumns({"surface": F.coalesce("surface", F.lit("backend")), "pass": F.coalesce("pass", F.lit("structural"))})


def read(spark: SparkSession, path: str) -> DataFrame:
    """FINDINGS of the JSON files at path."""
    return parse(spark.read.text(path, wholetext=True))


def to_json(findings: DataFrame) -> DataFrame:
    """findings as JSON objects in a column ``json``; fields without a value are left out."""
    return findings.select(F.to_json(F.struct(*findings.columns)).alias("json"))
