"""Findings-shaped and code-shaped tables that are derived from ``events`` row by row, in SQL that Spark and DuckDB both run.

The given tables hold no source code, so the queries of this package and their oracles both start from these."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FINDINGS = """
SELECT event_id AS seq,
  concat(CASE user_id % 5 WHEN 0 THEN 'src/api/' WHEN 1 THEN 'web/client/' WHEN 2 THEN 'services/opa-sync/' WHEN 3 THEN 'lib/core-auth/' ELSE 'app/roles/' END,
         event_type, '-', CAST(user_id % 40 AS STRING), CASE user_id % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.go' ELSE '.py' END) AS file,
  1 + (event_id * 37) % 400 AS line_start,
  1 + (event_id * 37) % 400 + event_id % 6 AS line_end,
  CASE event_id % 8 WHEN 0 THEN 'rbac' WHEN 1 THEN 'abac' WHEN 2 THEN 'middleware' WHEN 3 THEN 'business_rule' WHEN 4 THEN 'ownership' WHEN 5 THEN 'feature_gate' WHEN 6 THEN 'route' ELSE 'custom' END AS category,
  CASE event_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS confidence,
  CASE event_id % 7 WHEN 0 THEN 'if (user.role === "admin") {' WHEN 1 THEN 'authorize("orders:read", req)' WHEN 2 THEN 'enforcer.check(''edit'', post)' WHEN 3 THEN 'return guard(ctx)'
    WHEN 4 THEN 'roles.includes("owner") || roles.includes("staff")' WHEN 5 THEN 'gate.allows(plan)' ELSE concat('x', CAST(event_id AS STRING), ' = y') END AS code_snippet,
  concat('rule-', CAST(event_id % 11 AS STRING)) AS pattern_rule,
  event_id % 11 AS rule_ord,
  event_id % 11 = 7 AS externalized
FROM events
"""

#: The same finding several times: the id repeats, the order differs.
REPEATED = f"SELECT concat(file, '#', CAST(line_start % 9 AS STRING)) AS id, * FROM ({FINDINGS}) t"

BINDINGS = f"""
SELECT DISTINCT file AS scope, CASE seq % 52 WHEN 0 THEN 'enforcer' WHEN 1 THEN 'gate' WHEN 2 THEN 'guard' WHEN 3 THEN 'post' ELSE concat('name', CAST(seq % 52 AS STRING)) END AS name
FROM ({FINDINGS}) t
"""

#: Assignments of names of six levels, each to the next and the last to the first, within scopes; one seed in each scope.
EDGES = """
SELECT DISTINCT concat('s', CAST(user_id % 30 AS STRING)) AS scope, concat('n', CAST((event_id % 6 + 1) % 6 AS STRING), '_', CAST((event_id * 7) % 97 AS STRING)) AS lhs,
  concat('make(n', CAST(event_id % 6 AS STRING), '_', CAST((event_id * 5) % 89 AS STRING), ', n', CAST(event_id % 6 AS STRING), '_', CAST((event_id * 11) % 83 AS STRING), ')') AS rhs
FROM events
"""
SEEDS = "SELECT concat('s', CAST(user_id % 30 AS STRING)) AS scope, concat('n', CAST(min(event_id) % 6 AS STRING), '_', CAST((min(event_id) * 5) % 89 AS STRING)) AS name FROM events GROUP BY 1"

#: Second looks at ranges near those of the findings.
SEMANTIC = f"""
SELECT seq, file, line_start + seq % 4 - 1 AS line_start, line_end + seq % 5 - 2 AS line_end, line_start - 2 AS window_start, line_start + 3 AS window_end,
  category, CASE seq % 3 WHEN 0 THEN 'medium' WHEN 1 THEN 'high' ELSE 'low' END AS confidence, seq % 10 = 0 AS is_false_positive, CAST(seq AS STRING) AS original_finding_id,
  pattern_rule AS seed_rule, 100 + (seq * 13) % 9000 AS input_tokens, (seq * 7) % 1200 AS output_tokens
FROM ({FINDINGS}) t
"""

PATHS = """
SELECT DISTINCT concat(CASE user_id % 9 WHEN 0 THEN 'src/api/' WHEN 1 THEN 'Web/' WHEN 2 THEN 'internal/authz/' WHEN 3 THEN 'europa/x/' WHEN 4 THEN 'lib/1st-part/' WHEN 5 THEN '' WHEN 6 THEN 'app/ui/deep/'
    WHEN 7 THEN 'webhooks/' ELSE 'client/../lib/' END, CASE event_id % 4 WHEN 0 THEN 'orders' WHEN 1 THEN 'rbac-policy' WHEN 2 THEN 'Rakefile' ELSE 'my-file.test' END,
  CASE event_id % 7 WHEN 0 THEN '.ts' WHEN 1 THEN '.TSX' WHEN 2 THEN '.go' WHEN 3 THEN '' WHEN 4 THEN '.php' WHEN 5 THEN '.vue' ELSE '.kts' END) AS path
FROM events
"""


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """One of the tables above."""
    braces = sql.replace("{", "{{").replace("}", "}}").replace("FROM events", "FROM {events}")
    return spark.sql(braces, events=spark.read.parquet(f"{sf_dir}/events.parquet"))
