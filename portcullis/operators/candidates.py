"""Candidates for a second look: low-certainty findings, and regions that name authorization without a finding."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portcullis import model
from portcullis.functions import paths, text
from portcullis.operators import prefix

# Names that suggest authorization, as whole words in any case.
AUTH_NAME = (
    r"(?iuU)\b(?:authori[sz]\w*|authenticat\w*|is_?(?:admin|owner|authori[sz]ed|authenticated|in_?role)|has_?(?:role|permission|access|privilege)\w*"
    r"|(?:requires?|ensures?)_?(?:auth|admin|role|permission|login|user|owner)|check_?(?:auth|admin|role|permission|access|privilege)|current_?user"
    r"|get_?(?:roles|permissions|privileges)|guard\w*|authz\w*|rbac|acl|before_action|before_filter|login_required|permission_required)\b"
)
#: Lines taken before and after a hit.
BEFORE, AFTER = 5, 15
#: Share of the candidates that regions may take, in single precision.
COLD_SHARE = 0.3


def escalates(confidence: Column, category: Column) -> Column:
    return (confidence == "low") | ((confidence == "medium") & category.isin("business_rule", "custom", "ownership"))


def cold_budget(most: int, escalations: int) -> int:
    """How many regions may be added: the share of most in 32-bit floats, rounded up, one at least, within what is left."""
    if most <= 0:
        return 0
    single = lambda x: struct.unpack("f", struct.pack("f", x))[0]
    share = single(single(float(most)) * single(COLD_SHARE))
    whole = int(share) + (share > int(share))
    return max(0, min(max(1, whole), most - escalations))


def windows(hits: DataFrame) -> DataFrame:
    """hits: file, line. file, line_start, line_end: windows around hits, joined where they touch. A file's hits may lie in many tasks."""
    one = hits.select("file", "line").distinct().select("file", F.greatest(F.col("line") - BEFORE, F.lit(1)).alias("s"), (F.col("line") + AFTER).alias("e"))
    return prefix.islands(one, ["file"], "s", "e", 1).groupBy("file", "island").agg(F.max("e").alias("line_end")).select("file", F.col("island").alias("line_start"), "line_end")


def clear_of(regions: DataFrame, taken: DataFrame) -> DataFrame:
    """Regions that share no line with a taken range of their file.

    A region is free if no range that begins before the region's end ends after its start: one pass over a file's ranges by their
    starts and regions by their ends, with the largest end so far."""
    ranges = taken.where("line_start <= line_end").select("file", F.col("line_start").alias("__at"), F.lit(0).alias("__region"), F.col("line_end").alias("__end"))
    both = regions.withColumns({"__at": F.col("line_end"), "__region": F.lit(1)}).unionByName(ranges, allowMissingColumns=True)
    order = ["__at", "__region"]
    last = prefix.before(prefix.ranged(both, ["file"], order), ["file"], order, __last=("max", F.col("__end")))
    return last.where((F.col("__region") == 1) & (F.col("__last").isNull() | (F.col("__last") < F.col("line_start")))).select(*regions.columns)


def by_priority(regions: DataFrame, budget: int) -> DataFrame:
    """The first regions: files that look like authorization code first, then by path and line."""
    return regions.orderBy(paths.priority(F.col("file")).desc(), model.path_order(F.col("file")), "line_start").limit(budget)


def hit_lines(files: DataFrame) -> DataFrame:
    """file, line of every line of files (path, content) that carries such a name."""
    each = files.select(F.col("path").alias("file"), F.posexplode(text.lines(F.col("content"))).alias("i", "x"))
    return each.where(F.col("x").rlike(AUTH_NAME)).select("file", (F.col("i") + 1).cast("bigint").alias("line"))


def select_candidates(findings: DataFrame, files: DataFrame, most: int = 50, max_chars: int = 16_000) -> DataFrame:
    """CANDIDATES: escalated findings in order, then cold regions within their budget, both with context."""
    src = files.select(F.col("path").alias("file"), "content", paths.language(F.col("path")).alias("file_language"))
    chosen = findings.where(escalates(F.col("confidence"), F.col("category"))).orderBy(model.path_order(F.col("file")), "line_start", "id").limit(most)
    around = lambda: text.context(F.col("content"), F.col("line_start"), F.col("line_end"), max_chars)
    shape = lambda df, kind, finding, category, language: df.withColumn("x", around()).select(
        F.lit(kind).alias("kind"), "file", language.alias("language"), F.col("x.line_start"), F.col("x.line_end"), F.col("x.snippet").alias("source_snippet"),
        F.col("x.imports").alias("imports"), finding.alias("original_finding_id"), category.alias("seed_category"),
    )
    escalated = shape(chosen.join(src, "file"), "escalation", F.col("id"), F.col("category"), F.col("language"))
    budget = cold_budget(most, chosen.count()) if most else 0
    cold = by_priority(clear_of(windows(hit_lines(files)), escalated), budget)
    none = F.lit(None).cast("string")
    regions = shape(cold.join(src, "file"), "cold_region", none, none, F.col("file_language"))
    return escalated.unionByName(regions).orderBy(model.path_order(F.col("file")), "line_start", "line_end")
