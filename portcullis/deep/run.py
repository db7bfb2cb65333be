"""The deep pass. Candidates are chosen, expanded and put into requests by Spark; there are at most ``max_candidates`` of them. Tasks make the
calls in waves, through a ledger (``ledger.py``); from the driver, one by one, go calls to a model on the driver's own machine that the
workers of a cluster don't reach. What comes back is clamped, turned into findings and merged by Spark again."""

from __future__ import annotations

import logging
import uuid
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from portcullis import checkpoints, model
from portcullis.deep import ledger, prompt
from portcullis.deep.settings import Settings, is_local
from portcullis.deep.transports import Analyzer, Http, Subprocess
from portcullis.operators import candidates as C
from portcullis.operators import semantic as S

log = logging.getLogger(__name__)

_LOOKS = f"candidate int, {model.SEMANTIC}"


def shared_folder(spark: SparkSession) -> str | None:
    """The folder of checkpoints as a path, if it is one that files can be opened in."""
    where = urlsplit(checkpoints.folder(spark))
    return where.path if where.scheme in ("", "file") else None


def on_workers(spark: SparkSession, settings: Settings, ask: Analyzer) -> bool:
    """Whether tasks make the calls: they can take the transport with them, reach what it calls, and share a ledger."""
    reach = spark.sparkContext.master.startswith("local") or settings.mode == "http" and not is_local(settings.base_url)
    return isinstance(ask, (Http, Subprocess)) and reach and shared_folder(spark) is not None


def run(findings: DataFrame, files: DataFrame, settings: Settings, ask: Analyzer) -> DataFrame:
    """FINDINGS after the second look at files (path, content)."""
    spark = findings.sparkSession
    order = Window.orderBy(model.path_order(F.col("file")), "line_start", "line_end", "original_finding_id")
    chosen = C.select_candidates(findings, files, settings.max_candidates, settings.max_prompt_chars).withColumn("candidate", F.row_number().over(order))
    chosen = spark.createDataFrame(chosen.collect(), chosen.schema)  # at most max_candidates: chosen once, as later steps read them again
    asked = [(r["candidate"], r["user"]) for r in prompt.requests(chosen, findings).orderBy("candidate").collect()]
    if on_workers(spark, settings, ask):
        answered = ledger.ask_all(spark, asked, settings, ask, f"{shared_folder(spark)}/calls-{uuid.uuid4().hex}")
    else:
        answered = ledger.one_by_one(asked, settings, ask)
    looks = []
    for i, entry in answered:
        if "skip" in entry:
            log.warning("candidate %d is left out: %s", i, entry["skip"])
            continue
        looks += [(i, *(x[k] for k in ("line_start", "line_end", "category", "confidence", "description", "reasoning", "is_false_positive"))) for x in entry["findings"]]
    own = chosen.select("candidate", "file", "language", "source_snippet", "original_finding_id", F.col("line_start").alias("window_start"), F.col("line_end").alias("window_end"))
    answers = spark.createDataFrame(looks, _LOOKS).join(own, "candidate")
    kept = S.without_rejected(findings, answers)
    return S.merge(kept, S.as_findings(S.clamp(answers), findings, files))
