"""Queries over whole passes: candidates, requests, hints, templates, JSON, policies of a scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portcullis import rules
from portcullis.checkpoints import checkpointed
from portcullis.deep import prompt
from portcullis.functions import text
from portcullis.operators import candidates, findings, policies, scan
from portcullis.plans import derived as D
from portcullis.plans.derived import frame
from portcullis.plans.scans import _scan, code
from portcullis.registry import query
from portcullis.sources import findings_json
from portcullis.sources.files import exclusion_patterns

W = lambda **t: "WITH " + ", ".join(f"{k} AS ({v})" for k, v in t.items()) + "\n"

_IMPORTS = f"""SELECT seq, CASE seq % 4 WHEN 0 THEN 'typescript' WHEN 1 THEN 'python' WHEN 2 THEN 'go' ELSE 'java' END AS language,
  CASE seq % 5 WHEN 0 THEN 'import x from "express"' WHEN 1 THEN 'from django.db import y' WHEN 2 THEN '"github.com/gin-gonic/gin"' WHEN 3 THEN 'import org.springframework.security.X' ELSE 'from flask import z' END AS line FROM ({D.FINDINGS}) t"""


@query("framework_hints", W(i=_IMPORTS) + """SELECT seq, name FROM i JOIN (VALUES ('typescript', 'from "express"', 'Express'), ('python', 'from django.', 'Django'), ('go', 'github.com/gin-gonic/gin', 'Gin'), ('java', 'org.springframework.security', 'Spring Security'), ('python', 'from flask', 'Flask')) f(language, signature, name)
ON i.language = f.language AND contains(i.line, f.signature)""")
def framework_hints(spark: SparkSession, sf: str) -> DataFrame:
    i = frame(spark, sf, _IMPORTS).withColumn("imports", F.array(F.lit("first line"), "line"))
    return prompt.hints(i, "seq").select("seq", "name")


@query("exclude_globs", W(p=D.PATHS) + "SELECT path FROM p WHERE NOT (path LIKE 'src/%' OR regexp_matches(path, '(^|/)[^/]*\\.test(\\.[^/]*)?$') OR regexp_matches(path, '(^|/)ui/'))")
def exclude_globs(spark: SparkSession, sf: str) -> DataFrame:
    p = frame(spark, sf, D.PATHS)
    for pattern in exclusion_patterns(["src/**", "*.test", "*.test.*", "ui/"]):
        p = p.where(~F.col("path").rlike(pattern))
    return p


@query("render_template", W(f=D.FINDINGS) + "SELECT seq, 'role == \"' || category || '\" and x in [' || '\"' || confidence || '\"' || '] {{unknown}}' AS body FROM f")
def render_template(spark: SparkSession, sf: str) -> DataFrame:
    quoted = lambda c: F.concat(F.lit("'"), c, F.lit("'"))
    out = text.render(F.lit('role == "{{role_value}}" and x in [{{roles_set}}] {{unknown}}'), {"role_value": quoted("category"), "roles_set": text.quoted_items(quoted("confidence"))}, ("roles_set",))
    return frame(spark, sf, D.FINDINGS).select("seq", out.alias("body"))


@query("findings_json", W(f=D.FINDINGS) + "SELECT CAST(seq AS STRING) AS id, file, line_start, 'backend' AS surface, CASE seq % 3 WHEN 0 THEN '' WHEN 1 THEN 'rego:old' ELSE 'rego:new' END AS outputs FROM f")
def findings_json_query(spark: SparkSession, sf: str) -> DataFrame:
    """Findings written as JSON reports, one with an old stub and one with both forms among three, and read again."""
    f = frame(spark, sf, D.FINDINGS).withColumn("id", F.col("seq").cast("string"))
    stub = F.when(F.col("seq") % 3 > 0, "old")
    new = F.when(F.col("seq") % 3 == 2, F.array(F.struct(F.lit("rego").alias("engine"), F.lit("new").alias("content"))))
    item = F.struct("id", "file", "line_start", "line_end", "code_snippet", "category", "confidence", stub.alias("rego_stub"), new.alias("policy_outputs"))
    reports = f.select(F.to_json(F.struct(F.array(item).alias("findings"))).alias("value"))
    back = findings_json.parse(reports)
    return back.select("id", "file", "line_start", "surface", F.array_join(F.transform("policy_outputs", lambda x: F.concat(x["engine"], F.lit(":"), x["content"])), "|").alias("outputs"))


@query("report_summary_json", W(f=D.FINDINGS) + "SELECT category, count(*) AS n, count_if(confidence = 'high') AS high FROM f GROUP BY 1")
def report_summary_json(spark: SparkSession, sf: str) -> DataFrame:
    """The maps of a report, written as JSON and read again."""
    counts = frame(spark, sf, D.FINDINGS).groupBy("category").agg(F.count("*").alias("n"), F.count_if(F.col("confidence") == "high").alias("high"))
    one = counts.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("category", F.struct("n", "high"))))).alias("j"))  # eight categories
    return one.select(F.explode(F.from_json("j", "map<string,struct<n:bigint,high:bigint>>")).alias("category", "v")).select("category", "v.n", "v.high")


_COLD = """x AS (SELECT 'src/' || stem || '.ts' AS file, 1 + row_number() OVER (PARTITION BY stem ORDER BY event_id) AS line, k FROM (SELECT event_id, concat(event_type, '/f', CAST(user_id % 25 AS STRING)) AS stem, event_id % 7 AS k FROM events) b),
hits AS (SELECT DISTINCT file, line FROM x WHERE k IN (2, 3, 5) UNION SELECT DISTINCT file, 1 FROM x)"""


@query("auth_name_lines", f"WITH {_COLD} SELECT file, CAST(line AS BIGINT) AS line FROM hits")
def auth_name_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that name authorization: calls and comments of hasRole and authorize, and every head line."""
    return candidates.hit_lines(code(spark, sf, "ts"))


@query("select_candidates")
def select_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Escalations first, then cold regions within their budget; tests hold its parts against brute force."""
    s = _scan(spark, sf, "ts")
    return candidates.select_candidates(s.findings, code(spark, sf, "ts")).select("kind", "file", "language", "line_start", "line_end", F.size("imports").alias("n_imports"), F.length("source_snippet").alias("n_chars"))


@query("scan_policy_files", """WITH x AS (SELECT 'src/' || concat(event_type, '/f', CAST(user_id % 25 AS STRING)) || '.ts' AS file, event_id % 7 AS k, user_id % 25 % 3 AS b FROM events)
SELECT file, count_if(k IN (0, 2, 6) OR k = 3 AND b <> 0) AS finding_count, true AS valid FROM x GROUP BY file HAVING count_if(k IN (0, 2, 6) OR k = 3 AND b <> 0) > 0""")
def scan_policy_files(spark: SparkSession, sf: str) -> DataFrame:
    """Rego files of a whole scan, each checked."""
    out = policies.policy_files(_scan(spark, sf, "ts").findings, "rego", "out", "app")
    return policies.checked(out.select("file", "finding_count", "content"), "rego").drop("content")


_BROKEN = """SELECT seq, CASE seq % 6 WHEN 0 THEN concat('package a', chr(10), 'allow if {', chr(10), '  input.x == "', category, '"', chr(10), '}') WHEN 1 THEN concat('package a', chr(10), 'allow if { input.x == }') WHEN 2 THEN concat('package a', chr(10), 'x := "', category)
  WHEN 3 THEN concat('package a', chr(10), 'allow if { some i; input.xs[i] == ', CAST(seq AS STRING), ' }') WHEN 4 THEN concat('allow if { true }', category) ELSE concat('package a', chr(10), 'default allow') END AS rego,
  CASE seq % 5 WHEN 0 THEN concat('permit (principal, action, resource) when { principal.role == "', category, '" };') WHEN 1 THEN 'permit (principal, action, resource)' WHEN 2 THEN concat('permit (principal, action, resource) when { ', category, ' };')
  WHEN 3 THEN concat('forbid (principal, action == Action::"', category, '", resource);') ELSE 'permit (action, principal, resource);' END AS cedar FROM """ + f"({D.FINDINGS}) t"


@query("policy_checks", W(f=D.FINDINGS) + "SELECT seq, seq % 6 IN (0, 3) AS rego, seq % 5 IN (0, 3) AS cedar FROM f")
def policy_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Policies that an engine reads among ones that it refuses."""
    p = frame(spark, sf, _BROKEN)
    one = policies.checked(p, "rego", "rego").drop("rego").withColumnRenamed("valid", "rego")
    return policies.checked(one, "cedar", "cedar").drop("cedar").withColumnRenamed("valid", "cedar").select("seq", "rego", "cedar")


@query("findings_in_order", W(f=D.FINDINGS) + "SELECT seq, row_number() OVER (ORDER BY string_split(file, '/'), line_start, seq) AS place FROM f")
def findings_in_order(spark: SparkSession, sf: str) -> DataFrame:
    """The place of every finding in a listing: its place in a range of the order, after the ranges before it."""
    at = F.monotonically_increasing_id()
    rows = checkpointed(findings.in_order(frame(spark, sf, D.FINDINGS), "seq").select("seq", F.spark_partition_id().alias("range"), at.alias("at")))
    before, first = 0, []
    for r in rows.groupBy("range").count().orderBy("range").collect():
        first.append((r["range"], before - (r["range"] << 33) + 1))
        before += r["count"]
    shift = spark.createDataFrame(first, "range int, shift long")
    return rows.join(F.broadcast(shift), "range").select("seq", (F.col("at") + F.col("shift")).alias("place"))
