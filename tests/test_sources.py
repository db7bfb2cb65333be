import io
import json

import pytest

from portcullis import model, rules
from portcullis.functions.policy_check import validate, validate_template
from portcullis.operators.scan import Scan
from portcullis.rules.spec import RuleError, load_directory, merge, parse_rule
from portcullis.sources import config, findings_json, sinks
from portcullis.sources.files import exclusion_patterns, glob_pattern, ignore_rules, source_files

RULE = """[rule]
id = "{id}"
languages = ["typescript"]
category = "rbac"
confidence = "high"
description = "d"
query = '(call_expression function: (identifier) @fn) @match'
{more}
"""


@pytest.fixture
def tree(tmp_path):
    files = {
        "src/orders.ts": 'import { authorize } from "../authz/client";\nauthorize("orders:read");\nif (user.role === "admin") { f(); }\n',
        "src/util.py": "@login_required\ndef f(request):\n    return 1\n", "web/app.ts": 'hasRole("staff");\n', "vendor/x.ts": 'hasRole("x");\n', "src/.hidden/y.ts": 'hasRole("y");\n',
        "internal/authz/z.ts": 'hasRole("z");\n', "build/out.ts": 'hasRole("b");\n', "notes.txt": "hasRole", ".gitignore": "build/\n*.gen.ts\n!keep.gen.ts\n", "a.gen.ts": 'hasRole("g");\n', "keep.gen.ts": 'hasRole("k");\n',
    }
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(content)
    (tmp_path / "bad.ts").write_bytes(b"hasRole(\xff);")
    return tmp_path


def scanned(spark, tree, **k):
    return Scan(source_files(spark, str(tree), ["vendor/**"], ignore_rules(tree)), rules.builtin(), **k)


def test_a_tree_is_scanned_without_hidden_ignored_excluded_and_broken_files(spark, tree):
    s = scanned(spark, tree)
    found = {(r["file"], r["line_start"], r["pattern_rule"], r["surface"]) for r in s.findings.collect()}
    assert found == {("src/orders.ts", 3, "ts-role-check-conditional", "backend"), ("src/util.py", 1, "py-login-required-decorator", "backend"), ("web/app.ts", 1, "ts-has-role-call", "frontend"), ("keep.gen.ts", 1, "ts-has-role-call", "backend")}
    assert [tuple(r) for r in s.enforcement_points.collect()] == [("src/orders.ts", 2)]
    r = s.summary().first()
    assert (r["findings"], r["files"], r["enforcement_points"], r["externalized_pct"], r["n_middleware"]) == (4, 4, 1, 20, 1)


def test_both_readers_find_the_same_files(spark, tree):
    (tree / "src/__init__.py").write_text("has_role('a')\n")
    rules_ = ignore_rules(tree)
    local = {r["path"]: r["content"] for r in source_files(spark, str(tree), ["vendor/**"], rules_).collect()}
    other = {r["path"]: r["content"] for r in source_files(spark, f"file://{tree}", ["vendor/**"], rules_).collect()}
    assert local == other
    assert set(other) == {"src/__init__.py", "src/orders.ts", "src/util.py", "web/app.ts", "internal/authz/z.ts", "keep.gen.ts"}


def test_filters_leave_enforcement_points_alone(spark, tree):
    s = scanned(spark, tree, least="high", categories=["rbac"], languages=["typescript"])
    assert {r["pattern_rule"] for r in s.findings.collect()} == {"ts-role-check-conditional", "ts-has-role-call"}
    assert s.enforcement_points.count() == 1


def test_policy_texts_are_rendered(spark, tree):
    row = scanned(spark, tree).findings.where("file = 'web/app.ts'").first()
    out = {x["engine"]: x["content"] for x in row["policy_outputs"]}
    assert 'input.user.role in {"staff"}' in out["rego"] and 'principal.role == "staff"' in out["cedar"]
    assert len(row["id"]) == 64


@pytest.mark.parametrize(("glob", "yes", "no"), [
    ("vendor/**", ["vendor/a.ts", "vendor/b/c.ts"], ["x/vendor/a.ts", "vendors/a.ts"]), ("*.gen.ts", ["a.gen.ts", "x/y.gen.ts"], ["a.gents"]), ("build/", ["build/x", "a/build/y"], ["build"]),
    ("/top.ts", ["top.ts"], ["a/top.ts"]), ("a/**/b.ts", ["a/b.ts", "a/x/y/b.ts"], ["b.ts"]), ("x?.[tj]s", ["xa.ts", "d/xb.js"], ["x.ts", "xa.cs"]),
])
def test_globs(glob, yes, no):
    import re

    p = re.compile(glob_pattern(glob))
    assert all(p.search(x) for x in yes) and not any(p.search(x) for x in no)
    assert exclusion_patterns(["ok/**", "[z-a]"]) == [glob_pattern("ok/**")]


def test_rule_files(tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "a/b/one.toml").write_text(RULE.format(id="x-one", more='[rule.predicates.fn]\nmatch = "^f$"\n[rule.rego_template]\ntemplate = "old"\n[[rule.policy_templates]]\nengine = "rego"\ntemplate = "new"\n[rule.cedar_template]\ntemplate = "c"\n'))
    (tmp_path / "skip.txt").write_text("no rule")
    (tmp_path / "link.toml").symlink_to(tmp_path / "a/b/one.toml")
    (r,) = load_directory(tmp_path)
    assert (r.id, r.template("rego"), r.template("cedar"), r.predicates) == ("x-one", "new", "c", (("fn", "match", "^f$"),))
    assert load_directory(tmp_path / "none") == []
    other = parse_rule(RULE.format(id="ts-has-role-call", more=""))
    merged = merge(rules.builtin(), [other, r])
    assert [x.id for x in merged].index("ts-has-role-call") == [x.id for x in rules.builtin()].index("ts-has-role-call")
    assert merged[-1] is r and len(merged) == 109 and other in merged


@pytest.mark.parametrize("more", [
    '[rule.predicates.fn]\nmatch = "a"\neq = "b"\n', "[rule.predicates.fn]\n", '[rule.predicates.fn]\nmatch = "("\n', '[[rule.cross_predicates]]\nkind = "any_match"\ncaptures = []\nmatch = "a"\n',
    '[[rule.cross_predicates]]\nkind = "all_match"\ncaptures = ["a", "a"]\nmatch = "a"\n', '[[rule.cross_predicates]]\nkind = "some"\ncaptures = ["a"]\nmatch = "a"\n',
])
def test_bad_rules_are_refused(more):
    with pytest.raises(RuleError):
        parse_rule(RULE.format(id="bad", more=more))


def test_rules_name_captures_that_exist():
    with pytest.raises(RuleError, match="nope"):
        parse_rule(RULE.format(id="bad", more='[rule.predicates.nope]\neq = "a"\n')).compiled()
    with pytest.raises(RuleError, match="match"):
        parse_rule(RULE.format(id="bad", more="").replace(" @match", "")).compiled()


def finding(**k):
    return {"id": "i", "file": "src/a.ts", "line_start": 3, "line_end": 3, "code_snippet": 'hasRole("admin")', "language": "typescript", "category": "rbac", "confidence": "high", "description": "d", "pattern_rule": "r"} | k


def test_findings_json_in_old_and_new_forms(spark, tmp_path):
    a, b = tmp_path / "report.json", tmp_path / "bare.json"
    a.write_text(json.dumps({"findings": [finding(rego_stub="old"), finding(id="j", surface="frontend", policy_outputs=[{"engine": "rego", "content": "new"}, {"engine": "rego", "content": "again"}], rego_stub="old", cedar_stub="c")]}, indent=2))
    b.write_text(json.dumps([finding(id="k")]))
    rows = {r["id"]: r for p in (a, b) for r in findings_json.read(spark, str(p)).collect()}
    out = {k: [(x["engine"], x["content"]) for x in r["policy_outputs"]] for k, r in rows.items()}
    assert out == {"i": [("rego", "old")], "j": [("rego", "new"), ("cedar", "c")], "k": []}
    assert {k: (r["surface"], r["pass"]) for k, r in rows.items()} == {"i": ("backend", "structural"), "j": ("frontend", "structural"), "k": ("backend", "structural")}
    assert findings_json.read(spark, str(b)).columns == model.schema(model.FINDINGS).names
    back = json.loads(findings_json.to_json(findings_json.read(spark, str(b))).first()["json"])
    assert back["file"] == "src/a.ts" and "provenance" not in back


def test_reports(spark, tree):
    s = scanned(spark, tree)
    out = io.StringIO()
    sinks.report_json(s.findings, s.enforcement_points, str(tree), out)
    r = json.loads(out.getvalue())
    assert r["headline"] == {"externalized_pct": 20, "externalized": 1, "embedded_findings": 4, "total_enforcement_points": 5}
    assert [f["file"] for f in r["findings"]] == ["keep.gen.ts", "src/orders.ts", "src/util.py", "web/app.ts"]
    assert r["summary"]["by_category"] == {"rbac": 3, "middleware": 1} and r["summary"]["by_confidence"] == {"high": 4} and r["summary"]["files_with_findings"] == 4
    out = io.StringIO()
    sinks.report_text(s.findings, s.enforcement_points, out)
    lines = out.getvalue().split("\n")
    assert lines[0] == "Externalization: 20% (1 externalized / 5 enforcement points)"
    assert "  web/app.ts:1  [RBAC]  high  [frontend]" in lines and '       1 | hasRole("staff")' in lines
    assert lines[-2] == "Summary: 4 findings in 4 files (4 high)"
    out = io.StringIO()
    sinks.report_text(s.findings.limit(0), s.enforcement_points.limit(0), out)
    assert out.getvalue() == "No authorization patterns found.\n"


def test_policy_files_are_written_below_their_folder_only(spark, tmp_path):
    rows = [finding(), finding(id="j", line_start=9, confidence="medium", category="ownership"), finding(id="k", file="../../esc.ts", confidence="low"), finding(id="l", file="lib/b-c/1x.py", category="custom")]
    f = spark.createDataFrame([tuple(r.get(n) if n != "policy_outputs" else [] for n in model.schema(model.FINDINGS).names) for r in rows], model.FINDINGS)
    for engine in model.ENGINES:
        log = io.StringIO()
        assert sinks.write_policies(f, engine, str(tmp_path / engine), "app", log) == 3
        assert f"Generated 3 {engine} files from 4 findings." in log.getvalue() and "WARN" not in log.getvalue()
    text = (tmp_path / "rego/a.rego").read_text()
    assert "package app.a\n" in text and text.count("default allow") == 1 and "# [2] src/a.ts:9 | Ownership | medium\n" in text and "# TODO: verify this policy" in text
    assert "package app.b_c._1x\n" in (tmp_path / "rego/b-c/1x.rego").read_text()
    assert (tmp_path / "rego/esc.rego").exists() and (tmp_path / "cedar/app/a.cedar").exists()
    (tmp_path / "link").mkdir()
    (tmp_path / "link/a.rego").symlink_to(tmp_path / "elsewhere")
    with pytest.raises(sinks.SinkError):
        sinks.write_policies(f, "rego", str(tmp_path / "link"), "app")


def test_policy_checks():
    assert validate("cedar", "") == (True, None)
    for bad in ("permit (principal, action, resource)", "permit (principal);", "permit (principal, action, resource) when { };", "allow;", 'permit (principal, action, resource) when { a == "x };'):
        assert not validate("cedar", bad)[0]
    for bad in ("allow if { true }", "package a\nallow if {", "package a\nallow if { x == }", "package a\ndefault allow\n", 'package a\nx := "open', "package a\nallow if { }"):
        assert not validate("rego", bad)[0]
    assert validate("rego", "package a.b\n\nimport rego.v1\n\ndefault allow := false\n\nallow if {\n    input.x[_] == {1, 2}\n}\n")[0]
    assert all(validate_template(e, t)[0] for r in rules.builtin() for e, t in r.templates)


def test_settings(tmp_path):
    assert config.load(tmp_path / "none") == config.Config()
    path = config.write_default(tmp_path)
    c = config.load(path)
    assert c.scan.exclude[0] == "vendor/**" and c.extract.package_prefix == "app.authz"
    with pytest.raises(FileExistsError):
        config.write_default(tmp_path)
    path.write_text("[scan\n")
    with pytest.raises(config.ConfigError):
        config.load(path)


def test_commands(spark, tree, tmp_path, capsys, monkeypatch):
    from portcullis import cli

    monkeypatch.chdir(tmp_path)
    out = tmp_path / "r.json"
    assert cli.main(["scan", str(tree), "-f", "json", "-o", str(out), "-e", "vendor/**"]) == 0
    assert cli.main(["extract", "-i", str(out), "--output-dir", str(tmp_path / "p"), "--engine", "cedar"]) == 0
    assert (tmp_path / "p/app/app.cedar").exists() or list((tmp_path / "p").rglob("*.cedar"))
    assert cli.main(["extract", "-i", str(out), "--output-dir", str(tmp_path / "q"), "--min-confidence", "high"]) == 0
    capsys.readouterr()
    assert cli.main(["rules", "list"]) == 0 and capsys.readouterr().out.count("\n") == 108
    assert cli.main(["rules", "validate"]) == 0 and "108 rules, 0 errors" in capsys.readouterr().out
    assert cli.main(["rules", "test"]) == 0 and "tests, 0 failed" in capsys.readouterr().out
    assert cli.main([str(tree)]) == 0 and "Externalization: " in capsys.readouterr().out
    assert cli.main(["scan", str(tree), "--model", "m"]) == 1
    assert cli.main(["init", str(tmp_path / "tree2")]) == 1


def test_stream_of_files(spark, tree, tmp_path):
    from portcullis.streaming import scan_stream

    source = tmp_path / "in"
    spark.createDataFrame([("a.ts", 'hasRole("x");'), ("b.py", "has_role('y')")], model.SOURCE_FILES).write.parquet(str(source))
    got = []
    stream = spark.readStream.schema(model.SOURCE_FILES).parquet(str(source))
    q = scan_stream(stream, rules.builtin(), lambda f, p, n: got.extend(r["pattern_rule"] for r in f.collect()), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert sorted(got) == ["py-has-role-call", "ts-has-role-call"]


def test_table_function(spark):
    from portcullis.functions.table_functions import register

    register(spark, rules.builtin())
    spark.createDataFrame([("a.ts", "x\nhasRole('a');", "typescript")], "path string, content string, language string").createOrReplaceTempView("code_files")
    rows = spark.sql("SELECT path, rule_id, line_start, captures['role_value'] AS v FROM code_files, LATERAL match_rules(content, language)").collect()
    assert [tuple(r) for r in rows] == [("a.ts", "ts-has-role-call", 2, "'a'")]


