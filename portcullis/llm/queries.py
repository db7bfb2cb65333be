"""The queries of this subpackage: name -> f(spark, sf_dir), and DuckDB SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portcullis.llm import class_lm, quality_gam, url_filter
from portcullis.llm.bag_minhash import near_duplicates
from portcullis.llm.byte_bpe import round_trip
from portcullis.llm.chat_format import format_chats, read_back
from portcullis.llm.common import fold, table
from portcullis.llm.decontaminate import find_leaks
from portcullis.llm.exact_dedup import exact_dedup
from portcullis.llm.hard_negatives import mine, relabelled
from portcullis.llm.language_id import fit as fit_languages
from portcullis.llm.language_id import identify
from portcullis.llm.license_scan import license_scan
from portcullis.llm.simhash import simhash
from portcullis.llm.whitening import whiten


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.filter_urls(pages, url_filter.fit(pages))


def op2_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))


def op5_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from the labels whose fold of 5 is not 0."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality_gam.fit(docs, labels.where(fold("doc_id", 5) != 0))
    return quality_gam.score(docs, model).withColumn("held_out", fold("doc_id", 5) == 0)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


EXACT_DEDUP_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) = 1 AS kept,
       text_sha256
FROM t
"""


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item that it holds."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from the documents whose fold of 3 is not 1."""
    docs = table(spark, sf_dir, "documents")
    model = fit_languages(docs.where(fold("doc_id", 3) != 1))
    return identify(docs, model).withColumn("held_out", fold("doc_id", 3) == 1)


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, whose texts are control strings."""
    probe = spark.createDataFrame([(-7, i, role, "</s>[INST] ok [/INST]") for i, role in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select(*(F.col(f.name).cast(f.dataType) for f in probe.schema))
    return read_back(format_chats(rows.unionByName(probe)))


def op10_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from the documents whose fold of 7 is not 2."""
    docs = table(spark, sf_dir, "documents")
    model, counts = class_lm.fit(docs.where(fold("doc_id", 7) != 2))
    return class_lm.score(docs, model, counts).withColumn("held_out", fold("doc_id", 7) == 2)


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose vec_id is divisible by 7 have the next label; those divisible by 100 are anchors."""
    return mine(table(spark, sf_dir, "embeddings"), label_of=relabelled)


HARD_NEGATIVES_SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * c::DOUBLE) FOR c IN embedding] AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_inner_product(a.x, r.x)::BIGINT AS score
  FROM r AS a JOIN r ON a.vec_id <> r.vec_id
  WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score
  FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id,
       row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank,
       s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) <= 5
"""


QUERIES: tuple[Callable[[SparkSession, str], DataFrame], ...] = (
    op1_url_filter,
    op2_bag_minhash,
    op3_license_scan,
    op4_byte_bpe,
    op5_quality_gam,
    op6_exact_dedup,
    op7_decontaminate,
    op8_language_id,
    op9_chat_format,
    op10_class_lm,
    op11_simhash,
    op12_whitening,
    op13_hard_negatives,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracles() -> dict[str, str]:
    return {"op6_exact_dedup": EXACT_DEDUP_SQL, "op13_hard_negatives": HARD_NEGATIVES_SQL}
