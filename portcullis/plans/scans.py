"""Scans of code that is derived from ``events``: one TypeScript, Python and Go file for each kind of event and 25 users.

Each event gives a line from a small set, so what a scan must find is a CASE over event_id, known without any parser."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portcullis import rules
from portcullis.operators import scan
from portcullis.plans.derived import frame
from portcullis.registry import query

_BASE = "SELECT event_id, concat(event_type, '/f', CAST(user_id % 25 AS STRING)) AS stem, user_id % 25 AS u, event_id % 7 AS k FROM events"
_LINE = {
    "ts": """CASE k WHEN 0 THEN concat('if (user.role === "r', CAST(event_id % 5 AS STRING), '") { f(); }') WHEN 1 THEN 'if (msg.role === "assistant") { f(); }' WHEN 2 THEN 'hasRole("staff");'
      WHEN 3 THEN 'authorize("orders:read");' WHEN 4 THEN concat('const x', CAST(event_id AS STRING), ' = total + 1;') WHEN 5 THEN '// hasRole("admin")' ELSE 'ok = post.ownerId === user.id;' END""",
    "py": """CASE k WHEN 0 THEN concat('x = user.role == "r', CAST(event_id % 5 AS STRING), '"') WHEN 1 THEN 'y = msg.role == "assistant"' WHEN 2 THEN 'has_role("staff")'
      WHEN 3 THEN 'guard.can("edit")' WHEN 4 THEN concat('z = ', CAST(event_id AS STRING)) WHEN 5 THEN '# has_role("admin")' ELSE 'ok = doc.owner_id == user.id' END""",
    "go": """CASE k WHEN 0 THEN concat('ok = user.Role == "r', CAST(event_id % 5 AS STRING), '"') WHEN 1 THEN 'y := msg.Kind' WHEN 2 THEN 'ok = HasRole("staff")'
      WHEN 3 THEN 'ok = engine.Can("edit")' WHEN 4 THEN concat('z := ', CAST(event_id AS STRING)) WHEN 5 THEN '// HasRole("admin")' ELSE 'ok = doc.OwnerID == user.ID' END""",
    "js": """CASE k WHEN 0 THEN concat('if (user.role !== "r', CAST(event_id % 5 AS STRING), '") { f(); }') WHEN 1 THEN 'const y = msg.role;' WHEN 2 THEN 'hasRole("staff");'
      WHEN 3 THEN 'authorize("orders:read");' WHEN 4 THEN concat('x', CAST(event_id AS STRING), ' = `hasRole("t")`;') WHEN 5 THEN '/* hasRole("admin") */' ELSE 'ok = post.ownerId == user.id;' END""",
    "java": """CASE k WHEN 0 THEN concat('class C', CAST(event_id AS STRING), ' { boolean f() { return u.getRole().equals("r"); } }') WHEN 1 THEN 'class D { String role = "user"; }' WHEN 2 THEN 'class E { @RolesAllowed("staff") void f() { } }'
      WHEN 3 THEN 'class G { void f() { engine.isPermitted("doc:read"); } }' WHEN 4 THEN 'class H { boolean isOrgAdmin(User u) { return true; } }' WHEN 5 THEN '// @RolesAllowed("admin")' ELSE 'class I { boolean f() { return u.getId().equals(p.getOwnerId()); } }' END""",
    "cs": """CASE k WHEN 0 THEN concat('class C', CAST(event_id AS STRING), ' { void F() { user.IsInRole("r"); } }') WHEN 1 THEN 'class D { string role = "user"; }' WHEN 2 THEN 'class E { [Authorize(Roles = "staff")] void F() { } }'
      WHEN 3 THEN 'class G { void F() { engine.HasClaim("dept", "hr"); } }' WHEN 4 THEN 'class H { bool IsInRole(string r) { return true; } }' WHEN 5 THEN '// [Authorize]' ELSE 'class I { [AllowAnonymous] void F() { } }' END""",
    "php": """CASE k WHEN 0 THEN concat('$x = $user->role === "r', CAST(event_id % 5 AS STRING), '";') WHEN 1 THEN '$y = $msg->body === "user";' WHEN 2 THEN '$user->hasRole("staff");'
      WHEN 3 THEN '$engine->isGranted("edit");' WHEN 4 THEN concat('$z = ', CAST(event_id AS STRING), ';') WHEN 5 THEN '# $user->hasRole("admin");' ELSE 'Gate::allows("update", $post);' END""",
    "kt": """CASE k WHEN 0 THEN concat('fun a', CAST(event_id AS STRING), '() = user.role == "r"') WHEN 1 THEN 'val y = msg.kind' WHEN 2 THEN '@RolesAllowed("staff") fun b() { }'
      WHEN 3 THEN 'val ok = user.roles.contains("admin")' WHEN 4 THEN concat('val z = ', CAST(event_id AS STRING)) WHEN 5 THEN '// user.hasRole("admin")' ELSE 'val g = http.hasRole("ADMIN")' END""",
    "rb": """CASE k WHEN 0 THEN concat('x = user.role == "r', CAST(event_id % 5 AS STRING), '"') WHEN 1 THEN 'y = msg.kind' WHEN 2 THEN 'before_action :require_login'
      WHEN 3 THEN 'authorize @post, :update?' WHEN 4 THEN concat('z = ', CAST(event_id AS STRING)) WHEN 5 THEN '# authorize @post' ELSE 'ok = current_user.can?(:edit, post)' END""",
}
_HEAD = {
    "ts": ("import { authorize } from \"../authz/client\";", "import { authorize } from \"../util/client\";"),
    "py": ("from app.policy import guard", "from app.util import guard"),
    "go": ("package f; import engine \"x/opa\"", "package f; import engine \"x/util\""),
    "js": ("const { authorize } = require('../authz/client');", "const { authorize } = require('../util/client');"),
    "java": ("import com.acme.policy.engine;", "import com.acme.util.engine;"),
    "cs": ("using engine = Acme.Authz.Engine;", "using engine = Acme.Util.Engine;"),
    "php": ("<?php use Acme\\Policy\\Engine as engine;", "<?php use Acme\\Util\\Engine as engine;"),
    "kt": ("import acme.policy.engine", "import acme.util.engine"),
    "rb": ("require 'policy'", "require 'util'"),
}
#: What each line is found as, by its number k; line 3 is bound to a policy module in a third of the files.
_RULE = {
    "ts": {0: "ts-role-check-conditional", 2: "ts-has-role-call", 3: "ts-authorize-function-call", 6: "ts-ownership-check"},
    "py": {0: "py-role-check-conditional", 2: "py-has-role-call", 3: "py-permission-check-call", 6: "py-ownership-check"},
    "go": {0: "go-role-check-conditional", 2: "go-has-role-call", 3: "go-permission-check-call", 6: "go-ownership-check"},
    "js": {0: "ts-role-check-conditional", 2: "ts-has-role-call", 3: "ts-authorize-function-call", 6: "ts-ownership-check"},
    "java": {0: "java-role-equals-check", 2: "java-roles-allowed", 3: "java-shiro-is-permitted", 6: "java-ownership-check"},
    "cs": {0: "csharp-is-in-role-call", 2: "csharp-aspnet-authorize-roles", 3: "csharp-has-claim-call", 6: "csharp-aspnet-allow-anonymous"},
    "php": {0: "php-role-equals-check", 2: "php-has-role-call", 3: "php-symfony-is-granted", 6: "php-laravel-gate-allows-denies"},
    "kt": {0: "kotlin-role-equals-check", 2: "kotlin-roles-allowed", 3: "kotlin-role-collection-contains", 6: "kotlin-has-role-call"},
    "rb": {0: "ruby-role-equals-check", 2: "ruby-rails-before-action-filter", 3: "ruby-pundit-authorize", 6: "ruby-cancancan-can-check"},
}
_LANGUAGE = {"ts": "typescript", "py": "python", "go": "go", "js": "javascript", "java": "java", "cs": "csharp", "php": "php", "kt": "kotlin", "rb": "ruby"}
#: Kotlin and Ruby have no policy imports, so nothing is bound there.
_UNBOUND = ("kt", "rb")


def code(spark: SparkSession, sf_dir: str, ext: str) -> DataFrame:
    """SOURCE_FILES: a head line, then the events' lines by event_id."""
    lines = frame(spark, sf_dir, f"SELECT stem, u, event_id, {_LINE[ext]} AS line FROM ({_BASE}) b")
    first = F.when(F.col("u") % 3 == 0, _HEAD[ext][0]).otherwise(_HEAD[ext][1])
    files = lines.groupBy("stem", "u").agg(F.array_sort(F.collect_list(F.struct("event_id", "line"))).alias("x"))
    folder = F.concat(F.lit("d"), F.col("u")) if ext == "go" else F.lit("src")  # each Go file is a package of its own
    # few rows that take long: without a number of partitions, adaptive execution would put them into one
    return files.repartition(3 * spark.sparkContext.defaultParallelism, "stem").select(F.concat(folder, F.lit("/"), "stem", F.lit(f".{ext}")).alias("path"), F.concat_ws("\n", first, F.transform("x", lambda e: e["line"])).alias("content"))


def _expected(ext: str) -> str:
    """findings and enforcement points in SQL: file, line_start, rule, enforced."""
    rule = "CASE k " + " ".join(f"WHEN {k} THEN '{r}'" for k, r in _RULE[ext].items()) + " END"
    folder = "'d' || u || '/'" if ext == "go" else "'src/'"
    return f"""x AS (SELECT {folder} || stem || '.{ext}' AS file, 1 + row_number() OVER (PARTITION BY stem ORDER BY event_id) AS line_start, {rule} AS pattern_rule, {'false' if ext in _UNBOUND else 'k = 3 AND u % 3 = 0'} AS enforced FROM ({_BASE}) b),
y AS (SELECT * FROM x WHERE pattern_rule IS NOT NULL)"""


def _scan(spark: SparkSession, sf_dir: str, ext: str) -> scan.Scan:
    return scan.Scan(code(spark, sf_dir, ext), [r for r in rules.builtin() if _LANGUAGE[ext] in r.languages])


def _register(ext: str) -> None:
    @query(f"scan_{ext}_findings", f"WITH {_expected(ext)} SELECT file, CAST(line_start AS BIGINT) AS line_start, pattern_rule FROM y WHERE NOT enforced")
    def found(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _scan(spark, sf_dir, ext).findings.select("file", "line_start", "pattern_rule")

    @query(f"scan_{ext}_points", f"WITH {_expected(ext)} SELECT DISTINCT file, CAST(line_start AS BIGINT) AS line_start FROM y WHERE enforced")
    def points(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _scan(spark, sf_dir, ext).enforcement_points


for _ext in _LINE:
    _register(_ext)


@query("scan_summary", f"""WITH {_expected("ts")}, n AS (SELECT count_if(NOT enforced) AS findings, count(DISTINCT CASE WHEN NOT enforced THEN file END) AS files, count_if(NOT enforced AND pattern_rule = 'ts-ownership-check') AS medium, count_if(enforced) AS enforcement_points FROM y)
SELECT findings, files, medium, findings - medium AS high, enforcement_points, CAST(CASE WHEN findings + enforcement_points = 0 THEN 0 ELSE round(enforcement_points / (findings + enforcement_points) * 100) END AS INTEGER) AS externalized_pct FROM n""")
def scan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which share of the decisions in the TypeScript files is left to a policy engine."""
    return _scan(spark, sf_dir, "ts").summary().select("findings", "files", "medium", "high", "enforcement_points", "externalized_pct")


_PLAIN = """SELECT o_orderkey AS n, concat('app/m', CAST(o_custkey % 97 AS STRING), '.ts') AS path,
  CASE WHEN o_orderkey % 1009 = 7 THEN 'if (user.role === "admin") { open(); }' ELSE concat('const total', CAST(o_orderkey AS STRING), ' = price.times(', CAST(o_custkey AS STRING), ', { unit: "', o_orderstatus, '" }) + base[', CAST(o_custkey % 7 AS STRING), '];') END AS line FROM orders"""


def plain_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SOURCE_FILES as code bases are: long files, few of whose lines decide on access."""
    rows = spark.sql(_PLAIN.replace("{", "{{").replace("}", "}}").replace("FROM orders", "FROM {orders}"), orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))
    files = _dealt(rows).groupBy("path").agg(F.sort_array(F.collect_list(F.struct("n", "line"))).alias("x"))
    return files.select("path", F.concat_ws("\n", F.col("x.line")).alias("content"))


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows of a path together. Files are few and take long, so they are dealt once, to a number of partitions that adaptive execution leaves as it is."""
    return rows.repartition(6 * rows.sparkSession.sparkContext.defaultParallelism, "path")


@query("scan_plain_code", f"WITH x AS ({_PLAIN}), y AS (SELECT path, n, line, row_number() OVER (PARTITION BY path ORDER BY n, line) AS line_start FROM x) SELECT path AS file, line_start, 'ts-role-check-conditional' AS pattern_rule FROM y WHERE n % 1009 = 7")
def scan_plain_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scan.Scan(plain_code(spark, sf_dir), [r for r in rules.builtin() if "typescript" in r.languages])
    return s.findings.select("file", "line_start", "pattern_rule")


#: Seven lines of ordinary code of each language; one order in 1009 has the decision in place of the fifth.
_BLOCK = {
    "ts": ('export function total{n}(order: Order, price: number): number {\n  if (price > {c}) {\n    return price * order.items.length;\n  }\n  const base = lookup("{s}", order.items[{k}]);\n  return base + {n};\n}', '  if (user.role === "admin") { return 0; }', "ts-role-check-conditional"),
    "js": ('function total{n}(order, price) {\n  if (price > {c}) {\n    return price * order.items.length;\n  }\n  const base = lookup("{s}", order.items[{k}]);\n  return base + {n};\n}', '  if (user.role === "admin") { return 0; }', "ts-role-check-conditional"),
    "py": ('def total{n}(order, price):\n    if price > {c}:\n        return price * len(order.items)\n    # what the order is based on\n    base = lookup("{s}", order.items[{k}])\n    return base + {n}\n', '    base = user.role == "admin"', "py-role-check-conditional"),
    "go": ('func total{n}(order Order, price int) (int, error) {\n\tif price > {c} {\n\t\treturn price * len(order.Items), nil\n\t}\n\tbase := lookup("{s}", order.Items[{k}])\n\treturn base + {n}, nil\n}', '\tbase := user.Role == "admin"', "go-role-check-conditional"),
    "java": ('class Total{n} {\n  int of(Order order, int price) {\n    if (price > {c}) { return price * order.items().size(); }\n    // what the order is based on\n    int base = lookup("{s}", order.items().get({k}));\n    return base + {n}; }\n}', '    boolean base = user.getRole().equals("admin");', "java-role-equals-check"),
    "cs": ('class Total{n} {\n  int Of(Order order, int price) {\n    if (price > {c}) { return price * order.Items.Count; }\n    // what the order is based on\n    var b = Lookup("{s}", order.Items[{k}]);\n    return b + {n}; }\n}', '    var b = user.IsInRole("Admin");', "csharp-is-in-role-call"),
    "kt": ('fun total{n}(order: Order, price: Int): Int {\n    if (price > {c}) {\n        return price * order.items.size\n    }\n    val base = lookup("{s}", order.items[{k}])\n    return base + {n}\n}', '    val base = user.role == "admin"', "kotlin-role-equals-check"),
    "rb": ('def total{n}(order, price)\n  if price > {c}\n    return price * order.items.size\n  end\n  base = lookup("{s}", order.items[{k}])\n  base + {n}\nend', '  base = user.role == "admin"', "ruby-role-equals-check"),
    "php": ('function total{n}($order, $price) {\n  if ($price > {c}) {\n    return $price * count($order->items);\n  }\n  $base = lookup("{s}", $order->items[{k}]);\n  return $base + {n};\n}', "  $base = $user->hasRole('admin');", "php-has-role-call"),
}
_FIRST = {"php": "<?php\n", "go": "package app\n"}


def _blocks(ext: str) -> str:
    """n, path and block of every order, in SQL of both engines."""
    code, decision, _ = _BLOCK[ext]
    lines = code.split("\n")
    quoted = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "''").replace("\t", "  ") + "'"

    def put(s: str) -> str:
        values = {"{n}": "CAST(o_orderkey AS STRING)", "{c}": "CAST(o_custkey AS STRING)", "{k}": "CAST(o_custkey % 7 AS STRING)", "{s}": "o_orderstatus"}
        parts = [values.get(x) or quoted(x) for x in re.split(r"(\{[ncks]\})", s) if x]
        return "concat(" + ", ".join(parts) + ")" if parts else "''"

    fifth = f"CASE WHEN o_orderkey % 1009 = 7 THEN {put(decision)} ELSE {put(lines[4])} END"
    block = "concat(" + ", chr(10), ".join(fifth if i == 4 else put(x) for i, x in enumerate(lines)) + ")"
    return f"SELECT o_orderkey AS n, concat('app/m', CAST(o_custkey % 97 AS STRING), '/f', CAST(o_custkey % 5 AS STRING), '.{ext}') AS path, {block} AS block FROM orders"


def plain_blocks(spark: SparkSession, sf_dir: str, ext: str) -> DataFrame:
    """SOURCE_FILES of functions, few of which decide on access."""
    sql = _blocks(ext)
    rows = spark.sql(sql.replace("{", "{{").replace("}", "}}").replace("FROM orders", "FROM {orders}"), orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))
    files = _dealt(rows).groupBy("path").agg(F.sort_array(F.collect_list(F.struct("n", "block"))).alias("x"))
    return files.select("path", F.concat(F.lit(_FIRST.get(ext, "")), F.array_join(F.col("x.block"), "\n")).alias("content"))


def _register_plain(ext: str) -> None:
    rule, head = _BLOCK[ext][2], _FIRST.get(ext, "").count("\n")

    @query(f"scan_plain_{ext}", f"WITH x AS (SELECT o_orderkey AS n, concat('app/m', CAST(o_custkey % 97 AS STRING), '/f', CAST(o_custkey % 5 AS STRING), '.{ext}') AS file FROM orders), y AS (SELECT *, 7 * (row_number() OVER (PARTITION BY file ORDER BY n) - 1) + {head + 5} AS line_start FROM x) SELECT file, CAST(line_start AS BIGINT) AS line_start, '{rule}' AS pattern_rule FROM y WHERE n % 1009 = 7")
    def found(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = scan.Scan(plain_blocks(spark, sf_dir, ext), [r for r in rules.builtin() if _LANGUAGE[ext] in r.languages])
        return s.findings.select("file", "line_start", "pattern_rule")


for _ext in _BLOCK:
    _register_plain(_ext)
