"""Files that are parsed in parts give what they give whole, and take memory by the part."""

import random
import sys
import tracemalloc

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from portcullis import model, rules
from portcullis.functions import paths
from portcullis.operators import scan
from portcullis.operators.scan import PIECE, Matcher, Scan, in_parts, parsed
from portcullis.plans.rule_scans import _FORMS
from portcullis.plans.scans import _BLOCK, _FIRST, _HEAD, _LANGUAGE, _LINE, _PLAIN
from portcullis.rules import examples
from portcullis.syntax import parse, parse_parts
from portcullis.syntax.imports import _IMPORTS, _assignments, assignments, closed_runs, is_policy_path, policy_imports
from portcullis.syntax.lexer import token_runs, tokens

MATCHER = Matcher(rules.builtin())
PIECES = {**examples.EXAMPLES, "javascript": examples.EXAMPLES["typescript"]}
ODD = ["(", ")", "{", "}", "[", "]", '"', "'", "`", ";", "\n", "\n\n\n", ",", ":", "<", "=>", "/", "end\n", "<<~A\n", "#", "$", "@", "=", "\\", "é", "/*", '"""', "import ", "from ", "${", "#{", "if ", "class A "]


def sources(language):
    """The examples in a row, in random orders, and with pieces left out and put in."""
    rng = random.Random(language)
    head = examples.HEADS[language] + "\n" if examples.HEADS[language] else ""
    codes = [code for code, _, _ in PIECES[language]]
    codes += [above + "\n" + call for (x, call, _), forms in _FORMS.items() if x == language for above, _ in forms]
    yield head + "\n".join(codes)
    for _ in range(60):
        text = "\n".join(rng.choices(codes, k=rng.randrange(1, 12)))
        for _ in range(rng.choice([0, 0, 1, 3])):
            i = rng.randrange(len(text) + 1)
            text = text[:i] + rng.choice(ODD) + text[i + rng.choice([0, 0, 1, 5]) :]
        yield head + text


def flat(nodes):
    return [(f, n.kind, n.start, n.end, n.named, flat(n.children)) for f, n in nodes]


def told(t):
    return (t.kind, t.text, t.start, t.end, t.inner, t.mark, [(a, b, [told(x) for x in ts]) for a, b, ts in t.parts or []])


@pytest.mark.parametrize("language", sorted(PIECES))
def test_parts_are_the_whole(language):
    for source in sources(language):
        given = tokens(source, language)
        whole = flat(parse(source, language).children)
        for most in (1, 7, 40):
            assert [told(t) for run in token_runs(source, language, most) for t in run] == [told(t) for t in given], source
            got = [n for part in parse_parts(source, language, token_runs(source, language, most), most) for n in flat(part.children)]
            assert got == whole, source


@pytest.mark.parametrize("language", sorted(PIECES))
def test_matches_of_parts(language):
    key = lambda x: (x["rule_ord"], x["match_seq"])
    for source in sources(language):
        each = []
        for most in (sys.maxsize, 60, 5):
            found = sorted((x for piece in MATCHER.pieces(source, language, None, None, most) for x in piece), key=key)
            assert len({x["match_seq"] for x in found}) == len(found)
            each.append([{k: v for k, v in x.items() if k != "match_seq"} for x in found])
        assert each[0] == each[1] == each[2], source
        for x in each[0]:
            at = source.split("\n")[x["line_start"] - 1 : x["line_end"]]
            assert x["code_snippet"].split("\n")[0] in at[0] and x["code_snippet"].split("\n")[-1] in at[-1]


def test_builtin_rules_match_within_statements():
    assert all(in_parts(r.compiled()) for r in rules.builtin())
    across = [rules.Rule("pair", ("typescript",), "rbac", "high", "d", '((expression_statement) @a . (expression_statement) @match)'), rules.Rule("all", ("typescript",), "rbac", "high", "d", "(program) @match")]
    assert not any(in_parts(Matcher([r]).by_language["typescript"][0][2]) for r in across if Matcher([r]).by_language)


@pytest.mark.parametrize("language", sorted(_IMPORTS))
def test_imports_and_assignments_of_runs(language):
    for source in sources(language):
        given = tokens(source, language)
        if stray(given):
            continue  # names of "} = require(..)" without its opening brace are those behind the last brace of the run
        for most in (1, 20):
            runs = list(closed_runs(source, language, most))
            assert [t.start for run in runs for t in run] == [t.start for t in given]
            assert {n for run in runs for n in _IMPORTS[language](source, run)} == _IMPORTS[language](source, given), source
            assert {x for run in runs for x in _assignments(source, language, run)} == set(_assignments(source, language, given)), source
        assert set(assignments(source, language)) == set(assignments(source, language, given))
        assert policy_imports(source, language) == policy_imports(source, language, given)


@pytest.mark.parametrize("language", sorted(_IMPORTS))
def test_runs_for_imports_are_short(language):
    """All examples 20 times over: also where only blocks end, as in files of classes."""
    source = examples.HEADS[language] + "\n" + "\n".join([code for code, _, _ in PIECES[language]] * 20)
    assert max(len(run) for run in closed_runs(source, language, 200)) < 800


def stray(ts):
    depth = 0
    for t in ts:
        depth += (t.text in ("(", "[", "{")) - (t.text in (")", "]", "}")) if t.kind == "op" else 0
        if depth < 0:
            return True
    return False


def plain(ext, n):
    code, decision, _ = _BLOCK[ext]
    lines = code.split("\n")
    put = lambda s, i: s.replace("{n}", str(i)).replace("{c}", "9").replace("{k}", "3").replace("{s}", "O")
    return _FIRST.get(ext, "") + "\n".join(put("\n".join([*lines[:4], decision if i % 3 == 0 else lines[4], *lines[5:]]), i) for i in range(n))


@pytest.mark.parametrize("ext", sorted(_BLOCK))
def test_memory_does_not_grow_with_the_file(ext):
    """Four times the file takes little more, parsed by parts of 2,000 tokens."""
    language, peaks = _LANGUAGE[ext], []
    for n in (250, 1000):
        source = plain(ext, n)
        tracemalloc.start()
        found = sum(len(piece) for piece in MATCHER.pieces(source, language, None, None, 2000))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert found >= n // 3
    assert peaks[1] < 2 * peaks[0], peaks


def test_a_large_file_gives_several_rows(spark):
    """With the findings of all of them, the bindings of its imports and the assignments at its end."""
    n = 3 * PIECE
    lines = ['import { authorize } from "../authz/client";', *(f'hasRole("r{i}");' for i in range(n)), *(f"const a{i} = {i};" for i in range(n)), "const guard = authorize.make();", 'guard.can("edit");']
    source = "\n".join(lines)
    go = "package p\nfunc f() {\n}\n" + "".join(f'func f{i}() {{ ok = HasRole("a{i}") }}\n' for i in range(n)) + 'func g() { gate := e.New()\n ok = gate.Can("a") }\n'
    files = spark.createDataFrame([("a.ts", source), ("p/a.go", go), ("p/b.go", 'package p\nimport e "x/authz"\n')], model.SOURCE_FILES)
    rows = parsed(files.withColumn("language", paths.language(F.col("path"))), rules.builtin()).select("file", F.size("matches").alias("m"), "names", F.size("edges").alias("e")).collect()
    assert max(max(r["m"], r["e"]) for r in rows) <= PIECE
    assert sorted(r["file"] for r in rows if r["names"] is not None) == ["a.ts", "p/a.go", "p/b.go"]
    s = Scan(files, rules.builtin())
    assert s.findings.where("file = 'a.ts'").count() == n and s.findings.where("file = 'p/a.go'").count() == n
    assert sorted(tuple(r) for r in s.enforcement_points.collect()) == [("a.ts", len(lines)), ("p/a.go", go.count("\n"))]
    assert len(list(MATCHER.pieces(source, "typescript"))) == 4


def test_large_files_cross_to_a_worker_one_by_one(spark, monkeypatch):
    """Four files of 0.6 MB in one partition come in batches of at most two; the session's setting stays as it was."""
    schema, key = scan._SCHEMA, "spark.sql.execution.arrow.maxBytesPerBatch"

    def counted(files, rules, all_edges=False):
        def run(batches):
            for b in batches:
                rows = [{"file": f, "language": "typescript", "matches": [], "names": [f"n{b.num_rows}"], "edges": []} for f in b.column("path").to_pylist()]
                yield pa.RecordBatch.from_pylist(rows, schema)

        return files.select("path", "content", "language").mapInArrow(run, scan.PARSED)

    monkeypatch.setattr(scan, "parsed", counted)
    before = spark.conf.get(key)
    files = spark.range(0, 4, 1, 1).select(F.concat(F.lit("f"), "id", F.lit(".ts")).alias("path"), F.repeat(F.lit("x = 1;"), 100_000).alias("content"))
    names = {r["name"] for r in Scan(files, []).bindings.collect()}
    assert names <= {"n1", "n2"}, names
    assert spark.conf.get(key) == before
    spark.conf.set(key, "4k")
    try:
        assert {r["name"] for r in Scan(files, []).bindings.collect()} <= {"n1", "n2"} and spark.conf.get(key) == "4k"
    finally:
        spark.conf.set(key, before)


def ruled(language):
    """A file of n examples, as rule_code() deals them."""
    codes = [code for code, _, _ in PIECES[language]]
    return language, lambda n: "\n".join([examples.HEADS[language] or "", *(codes[i % len(codes)] for i in range(n))])


def lined(ext):
    """A file of n events, as code() makes it."""
    lines = lambda n: duckdb.sql(f"SELECT {_LINE[ext]} FROM (SELECT range AS event_id, range % 7 AS k FROM range({n})) ORDER BY event_id").fetchall()
    return _LANGUAGE[ext], lambda n: "\n".join([_HEAD[ext][0], *(x for (x,) in lines(n))])


def blocks(ext):
    """A file of n orders, as plain_blocks() makes it."""
    return _LANGUAGE[ext], lambda n: plain(ext, n)


def ordered(n):
    """A file of n orders, as plain_code() makes it."""
    rows = duckdb.sql(f"WITH orders AS (SELECT range AS o_orderkey, range % 97 AS o_custkey, 'O' AS o_orderstatus FROM range({n})) SELECT line FROM ({_PLAIN}) ORDER BY n").fetchall()
    return "\n".join(x for (x,) in rows)


lines_of_orders = "typescript", ordered
QUERIES = {
    "scan_rules_points_py": ruled("python"),
    "scan_plain_code": lines_of_orders,
    "select_candidates": lined("ts"),
    "scan_go_points": lined("go"),
    "scan_plain_java": blocks("java"),
    "scan_plain_py": blocks("py"),
    "scan_ts_points": lined("ts"),
    "scan_plain_ts": blocks("ts"),
    "scan_plain_cs": blocks("cs"),
    "scan_plain_kt": blocks("kt"),
    "scan_rules_points_cs": ruled("csharp"),
    "scan_rules_js": ruled("javascript"),
    "scan_java_findings": lined("java"),
    "scan_rules_java": ruled("java"),
    "scan_rules_points_go": ruled("go"),
    "scan_rules_points_java": ruled("java"),
    "scan_rules_php": ruled("php"),
}  # the queries' code


@pytest.mark.parametrize("name", QUERIES)
def test_files_of_a_query_take_memory_by_the_part(name):
    """Four times the file takes little more, for matches, imports and, where they bind something, assignments."""
    language, source = QUERIES[name]
    peaks = []
    for n in (300, 1200):
        text = source(n)
        tracemalloc.start()
        found = sum(len(piece) for piece in MATCHER.pieces(text, language, None, None, 1000))
        runs = lambda: closed_runs(text, language, 1000) if language in _IMPORTS and is_policy_path(text) else ()  # noqa: B023, E731
        if any([_IMPORTS[language](text, run) for run in runs()]):
            for run in runs():
                _assignments(text, language, run)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert found > n // 1009
    assert peaks[1] < 2 * peaks[0], peaks
