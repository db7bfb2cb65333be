"""Scans over code that is dealt from tables made by hand: an example of each rule and its near misses, and every form of import
and assignment. ``events`` says which piece stands where, so SQL knows what must be found without any parser."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portcullis import rules
from portcullis.operators import policies, scan, semantic
from portcullis.plans import derived as D
from portcullis.plans.derived import frame
from portcullis.registry import query
from portcullis.rules import examples

W = lambda **t: "WITH " + ", ".join(f"{k} AS ({v})" for k, v in t.items()) + "\n"
EXTENSION = {"typescript": "ts", "javascript": "js", "java": "java", "python": "py", "go": "go", "csharp": "cs", "kotlin": "kt", "ruby": "rb", "php": "php"}
_STEM = "concat(event_type, '/f', CAST(user_id % 25 AS STRING))"


def _values(rows: list[tuple]) -> str:
    text = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(text(v) for v in r) + ")" for r in rows) + ")"


# every rule

_EXAMPLES = {**examples.EXAMPLES, "javascript": examples.EXAMPLES["typescript"]}
_OUTSIDE = {r.id for r in rules.builtin() if r.externalized}


def rule_code(spark: SparkSession, sf_dir: str, language: str) -> DataFrame:
    """SOURCE_FILES: the head of a file, then the examples that the events ask for, by event_id."""
    pieces = spark.createDataFrame([(k, code) for k, (code, _, _) in enumerate(_EXAMPLES[language])], "k bigint, code string")
    rows = frame(spark, sf_dir, f"SELECT {_STEM} AS stem, event_id, event_id % {len(_EXAMPLES[language])} AS k FROM events").join(F.broadcast(pieces), "k")
    files = rows.groupBy("stem").agg(F.array_sort(F.collect_list(F.struct("event_id", "code"))).alias("x"))
    head = [F.lit(examples.HEADS[language])] if examples.HEADS[language] else []
    content = F.concat_ws("\n", *head, F.transform("x", lambda e: e["code"]))
    # few rows that take long: without a number of partitions, adaptive execution would put them into one
    return files.repartition(3 * spark.sparkContext.defaultParallelism, "stem").select(F.concat(F.lit("src/"), "stem", F.lit(f".{EXTENSION[language]}")).alias("path"), content.alias("content"))


def _rule_hits(language: str) -> str:
    """file, line_start, line_end, pattern_rule of all that is to be found, from how many lines each example has and what is in it."""
    sizes = [(k, code.count("\n") + 1) for k, (code, _, _) in enumerate(_EXAMPLES[language])]
    found = [(k, *h) for k, (code, hits, _) in enumerate(_EXAMPLES[language]) for h in examples.hits(code, hits) if language != "javascript" or h[0] not in examples.TYPESCRIPT_ONLY]
    return f"""s(k, n) AS {_values(sizes)}, h(k, rule, a, b) AS {_values(found)},
p AS (SELECT stem, s.k, sum(n) OVER (PARTITION BY stem ORDER BY event_id) - n + {int(bool(examples.HEADS[language]))} AS before FROM (SELECT {_STEM} AS stem, event_id, event_id % {len(sizes)} AS k FROM events) e JOIN s ON s.k = e.k),
x AS (SELECT 'src/' || stem || '.{EXTENSION[language]}' AS file, CAST(before + a AS BIGINT) AS line_start, CAST(before + b AS BIGINT) AS line_end, rule AS pattern_rule, rule IN ({", ".join(repr(r) for r in sorted(_OUTSIDE))}) AS outside FROM p JOIN h ON h.k = p.k)"""


def _register(language: str) -> None:
    own = lambda: [r for r in rules.builtin() if language in r.languages]

    @query(f"scan_rules_{EXTENSION[language]}", f"WITH {_rule_hits(language)} SELECT file, line_start, line_end, pattern_rule FROM x WHERE NOT outside")
    def found(spark: SparkSession, sf_dir: str) -> DataFrame:
        return scan.Scan(rule_code(spark, sf_dir, language), own()).findings.select("file", "line_start", "line_end", "pattern_rule")

    if any(language in r.languages and r.externalized for r in rules.builtin()):

        @query(f"scan_rules_points_{EXTENSION[language]}", f"WITH {_rule_hits(language)} SELECT DISTINCT file, line_start FROM x WHERE outside")
        def points(spark: SparkSession, sf_dir: str) -> DataFrame:
            return scan.Scan(rule_code(spark, sf_dir, language), own()).enforcement_points


for _language in _EXAMPLES:
    _register(_language)

# imports and assignments

#: Language, what stands above, the call, its rule, the call's line in the file, whether a policy module is behind it.
_TS_FORMS = [
    ('import guard from "../authz/client";', True), ('import { guard } from "@acme/policy";', True), ('import { check as guard } from "./opa";', True), ('import { guard as check } from "./opa";', False),
    ('import * as guard from "cedar-wasm";', True), ('const guard = require("./enforce");', True), ('const { guard } = require("./authz");', True), ('const { check: guard } = require("./authz");', True),
    ('import guard, { other } from "./policy";', True), ('import { guard } from "./util";', False), ('import {\n  other,\n  guard,\n} from "../verifiedpermissions";', True),
    ('import { Engine } from "./policy";\nconst guard = new Engine();', True), ('import { Engine } from "./policy";\nlet guard;\nguard = Engine.make();', True),
    ('import { Engine } from "./policy";\nconst o = { guard: Engine, x: 1 };', True), ('import { Engine } from "./policy";\nclass A { guard = Engine.make(); }', True),
    ('import { Engine } from "./util";\nconst guard = new Engine();', False), ('import { Engine } from "./policy";\nconst a = Engine.of();\nconst b = a;\nconst guard = f(b);', True),
    ('// import guard from "../authz/client";\nconst s = "import guard from \'./authz\'";', False),
]
_FORMS = {
    ("typescript", 'guard.can("edit");', "ts-permission-check-call"): [*_TS_FORMS, ('import guard = require("./rego");', True)],
    ("javascript", 'guard.can("edit");', "ts-permission-check-call"): _TS_FORMS,
    ("go", 'func f() { ok := guard.Can("edit") }', "go-permission-check-call"): [
        ('import "acme/opa/guard"', True), ('import guard "acme/opa"', True), ('import (\n\t"fmt"\n\tguard "x/policy"\n)', True), ('import . "x/policy"', False), ('import _ "x/policy"', False), ('import guard "x/util"', False),
        ('import "x/authz"\nvar guard = authz.New()', True), ('import "x/authz"\nfunc g() { guard := authz.New() }', True), ('import "x/authz"\nfunc g() { guard, err := authz.New(), nil }', True), ('import "x/authz"\nfunc g() { err, guard := authz.New(), nil }', False),
        ('import "x/authz"\nfunc g() { a, guard := authz.Both() }', True), ('import "x/authz"\nfunc g() { s := S{guard: authz.New()} }', True), ('import "x/authz"\nfunc g() { var guard E; guard = authz.New() }', True),
    ],
    ("python", 'guard.can("edit")', "py-permission-check-call"): [
        ("import opa.guard", False), ("import opa as guard", True), ("import opa.guard as guard", True), ("from authz import guard", True), ("from authz import check as guard", True), ("from authz import guard as check", False),
        ("from authz import (\n    other,\n    guard,\n)", True), ("from authz import *", False), ("from util import guard", False), ("from authz import Engine\nguard = Engine()", True), ("from authz import Engine\nother, guard = 1, Engine()", True),
        ("from authz import Engine\nguard, other = 1, Engine()", False), ("from authz import Engine\nif (guard := Engine()): pass", True), ("from authz import Engine\nself.guard = Engine()", True), ('"""\nfrom authz import guard\n"""', False),
    ],
    ("java", 'class B { void f() { guard.isPermitted("doc:read"); } }', "java-shiro-is-permitted"): [
        ("import acme.authz.guard;", True), ("import static acme.policy.Engine.guard;", True), ("import acme.policy.*;", False), ("import acme.util.guard;", False), ("import acme.authz.Engine;\nclass A { Engine guard = new Engine(); }", True),
        ("import acme.authz.Engine;\nclass A { A() { this.guard = Engine.make(); } }", True), ("import acme.authz.Engine;\nclass A { void g() { var guard = Engine.make(1, 2); } }", True), ("import acme.util.Engine;\nclass A { Engine guard = new Engine(); }", False),
    ],
    ("csharp", 'class B { void F() { guard.IsInRole("x"); } }', "csharp-is-in-role-call"): [
        ("using guard = Acme.Authz.Engine;", True), ("using Acme.Authz;", False), ("using guard = Acme.Util.Engine;", False), ("using Engine = Acme.Opa.Engine;\nclass A { Engine guard; }", True), ("using Engine = Acme.Opa.Engine;\nclass A { void G(Engine guard) { } }", True),
        ("using Engine = Acme.Opa.Engine;\nclass A { void G() { var guard = Engine.Make(); } }", True), ("using Engine = Acme.Opa.Engine;\nclass A { A(Engine e) { this.guard = e; } }", True), ("using Engine = Acme.Opa.Engine;\nclass A { Other guard; }", False),
    ],
    ("php", "$guard->hasRole('x');", "php-has-role-call"): [
        ("use Acme\\Policy\\Check as guard;", True), ("use function Acme\\authz\\guard;", True), ("use Acme\\Opa\\{Other, guard};", True), ("use Acme\\Opa\\{guard as other};", False), ("use Acme\\Util\\guard;", False), ("use Acme\\Authz\\Engine;\n$guard = new Engine(1, 2);", True),
        ("use Acme\\Authz\\Engine;\nfunction f(Engine $guard) { }", True), ("use Acme\\Authz\\Engine;\nclass A { private $guard = Engine::class; }", True), ("use Acme\\Authz\\Engine;\n$other = new Engine();", False),
    ],
    ("kotlin", 'val ok = guard.hasRole("ADMIN")', "kotlin-has-role-call"): [("import acme.policy.guard", False)],
    ("ruby", 'ok = guard.roles.include?("x")', "ruby-role-collection-include"): [("require 'policy'", False)],
}


def _forms() -> list[tuple[int, str, str, str, int, bool]]:
    """k, extension, content, rule, line of the call, enforced."""
    out = []
    for (language, call, rule), forms in _FORMS.items():
        head = examples.HEADS[language] + "\n" if examples.HEADS[language] else ""
        out += [(len(out) + i, EXTENSION[language], f"{head}{above}\n{call}\n", rule, (head + above).count("\n") + 2, bound) for i, (above, bound) in enumerate(forms)]
    return out


def form_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SOURCE_FILES: a file of each form for each stem; the Go ones have folders of their own."""
    forms = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(ext).alias("ext"), F.lit(content).alias("content")) for k, ext, content, _, _, _ in _forms()])
    stems = frame(spark, sf_dir, f"SELECT DISTINCT {_STEM} AS stem FROM events").repartition(3 * spark.sparkContext.defaultParallelism, "stem")
    return stems.select("stem", F.explode(forms).alias("f")).select(F.concat(F.lit("k"), "f.k", F.lit("/"), "stem", F.lit("."), "f.ext").alias("path"), "f.content")


@query("scan_import_forms", f"WITH f(k, ext, rule, line, bound) AS {_values([(k, ext, rule, line, bound) for k, ext, _, rule, line, bound in _forms()])}, s AS (SELECT DISTINCT {_STEM} AS stem FROM events) SELECT 'k' || k || '/' || stem || '.' || ext AS file, CAST(line AS BIGINT) AS line_start, rule AS pattern_rule, bound AS enforced FROM s, f")
def scan_import_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every form of import and assignment: what it binds is left to a policy engine."""
    s = scan.Scan(form_code(spark, sf_dir), rules.builtin())
    return s.routed.select("file", "line_start", F.col("rule_id").alias("pattern_rule"), "enforced")


# rules as data


@query("grammar_variants", W(p=D.PATHS) + "SELECT DISTINCT language, is_tsx FROM (SELECT CASE WHEN regexp_extract(path, '[^/]*$') = 'Rakefile' THEN 'ruby' WHEN lower(path) LIKE '%.ts' OR lower(path) LIKE '%.tsx' THEN 'typescript' WHEN lower(path) LIKE '%.go' THEN 'go' WHEN lower(path) LIKE '%.php' THEN 'php' WHEN lower(path) LIKE '%.kts' THEN 'kotlin' END AS language, lower(path) LIKE '%.tsx' AS is_tsx FROM p) WHERE language IS NOT NULL")
def grammar_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The languages of a tree, TSX apart from TypeScript."""
    return scan.variants(frame(spark, sf_dir, D.PATHS))


_TESTS = [(r.id, t, v, x.expect_match) for r in rules.builtin() for t, x in enumerate(r.tests) for v in scan.VARIANTS.get(x.language or r.languages[0], (x.language or r.languages[0],))]


@query("rules_test", f"SELECT rule_id, test, variant, expected, expected AS found FROM {_values(_TESTS)} t(rule_id, test, variant, expected)")
def rules_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each test of each rule in each grammar variant (one parser reads both): what is found, against what the examples say."""
    return scan.test_rules(spark, rules.builtin()).select("rule_id", "test", "variant", "expected", "found")


#: Rules of two sources: of an id that both have, the second one's counts.
_RULES = "SELECT concat('rule-', CAST(event_id % 997 AS STRING)) AS id, concat('d', CAST(min(event_id) AS STRING)) AS description, min(event_id) % 3 AS l, min(event_id) % 8 AS c FROM events WHERE user_id % 2 = {} GROUP BY 1"
_RULE_OF = "CASE l WHEN 0 THEN 'kotlin' WHEN 1 THEN 'typescript' ELSE 'go' END AS language, CASE c WHEN 0 THEN 'rbac' WHEN 1 THEN 'abac' WHEN 2 THEN 'middleware' WHEN 3 THEN 'business_rule' WHEN 4 THEN 'ownership' WHEN 5 THEN 'feature_gate' WHEN 6 THEN 'route' ELSE 'custom' END AS category"


def _rule_list(spark: SparkSession, sf_dir: str, which: int) -> list[rules.Rule]:
    """At most 997 ids."""
    rows = frame(spark, sf_dir, f"SELECT id, description, {_RULE_OF} FROM ({_RULES.format(which)}) t ORDER BY id").collect()
    both = lambda x: ("typescript", "javascript") if x == "typescript" else (x,)
    return [rules.Rule(r["id"], both(r["language"]), r["category"], "high", r["description"], "(identifier) @match") for r in rows]


@query("merge_rules", f"WITH a AS ({_RULES.format(0)}), b AS ({_RULES.format(1)}), m AS (SELECT coalesce(a.id, b.id) AS id, coalesce(b.description, a.description) AS description, a.id IS NULL AS new FROM a FULL JOIN b ON a.id = b.id) SELECT id, description, CAST(row_number() OVER (ORDER BY new, id) - 1 AS INTEGER) AS place FROM m")
def merge_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule of the same id takes the old one's place, a new one is added at the end."""
    merged = rules.merge(_rule_list(spark, sf_dir, 0), _rule_list(spark, sf_dir, 1))
    return scan.rules_table(spark, merged).select(F.col("rule_id").alias("id"), "description", F.col("rule_ord").alias("place"))


@query("list_rules", f"WITH a AS (SELECT id, {_RULE_OF} FROM ({_RULES.format(0)}) t) SELECT id FROM a WHERE language = 'typescript' AND category IN ('rbac', 'route')")
def list_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JavaScript rules of two categories."""
    table = scan.rules_table(spark, _rule_list(spark, sf_dir, 0))
    return scan.listed(table, "javascript", ["rbac", "route"]).select(F.col("rule_id").alias("id"))


@query("template_by_engine", W(f=D.FINDINGS) + "SELECT seq, CASE WHEN seq % 3 > 0 THEN 'r-' || category END AS rego, CASE WHEN seq % 3 < 2 THEN 'c-' || category END AS cedar FROM f")
def template_by_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The policy text of an engine among a finding's outputs, which have one, the other or both."""
    one = lambda engine: F.array(F.struct(F.lit(engine).alias("engine"), F.concat(F.lit(engine[0] + "-"), "category").alias("content")))
    outputs = F.when(F.col("seq") % 3 == 0, one("cedar")).when(F.col("seq") % 3 == 1, F.concat(one("cedar"), one("rego"))).otherwise(one("rego"))
    return frame(spark, sf_dir, D.FINDINGS).select("seq", policies.output_for(outputs, "rego").alias("rego"), policies.output_for(outputs, "cedar").alias("cedar"))


#: Verdicts about findings, a third of them without a seed, one in ten rejected.
_VERDICTS = f"SELECT seq, file, 'typescript' AS language, line_start, line_end, window_start, window_end, category, confidence, is_false_positive, CASE WHEN seq % 3 > 0 THEN original_finding_id END AS original_finding_id FROM ({D.SEMANTIC}) t"


@query("semantic_findings", W(f=D.FINDINGS, v=_VERDICTS) + """SELECT v.file, v.line_start, v.line_end, v.category, CASE WHEN f.seq IS NOT NULL AND f.line_start <= v.line_end AND v.line_start <= f.line_end THEN f.pattern_rule || '-semantic' ELSE 'semantic-' || v.category END AS pattern_rule,
CASE WHEN v.line_start > 0 AND v.line_end >= v.line_start AND v.line_start <= 90 THEN array_to_string(list_transform(range(v.line_start, greatest(least(v.line_end, 90), v.line_start) + 1), lambda i: 'l' || i), chr(10)) ELSE '' END AS code_snippet
FROM v LEFT JOIN f ON CAST(f.seq AS STRING) = v.original_finding_id WHERE NOT v.is_false_positive""")
def semantic_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts as findings: the seed's rule if they touch it, the file's lines as snippet."""
    found = frame(spark, sf_dir, D.FINDINGS).withColumn("id", F.col("seq").cast("string"))
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(90)), lambda i: F.concat(F.lit("l"), i)), "\n")
    files = frame(spark, sf_dir, f"SELECT DISTINCT file AS path FROM ({D.FINDINGS}) t").select("path", text.alias("content"))
    looks = frame(spark, sf_dir, _VERDICTS).withColumns({"source_snippet": F.lit(""), "description": F.lit("d")})
    return semantic.as_findings(looks, found, files).select("file", "line_start", "line_end", "category", "pattern_rule", "code_snippet")
