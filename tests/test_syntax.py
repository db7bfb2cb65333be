import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from portcullis import model, rules
from portcullis.operators.scan import Matcher, render
from portcullis.syntax import Query, QueryError, parse
from portcullis.rules import RuleError, examples
from portcullis.syntax.kinds import kinds
from portcullis.syntax.imports import assignments, policy_imports

PIECES = ["a", "role", "if", "class", "def", "end", "function", "(", ")", "[", "]", "{", "}", ".", "?.", "->", "::", ",", ";", ":", "=", "==", "=>", "\n", " ", '"x"', "'y'", "`z`", "@", "#", "$v", ":s", "<", ">", "!", "?", "&", "new", "return", "1", '"', "/*", "//", "\\", "é", "import", "use", "from"]


@pytest.mark.parametrize("language", model.LANGUAGES)
@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=60))
def test_any_text_is_parsed(language, pieces):
    text = " ".join(pieces)
    tree = parse(text, language)
    for node in tree.walk():
        assert 0 <= node.start <= node.end <= len(text)
        for _, c in node.children:  # the scan looks for what a rule needs in the text of the outermost node
            assert node.start <= c.start and c.end <= node.end or c.kind == "heredoc_body", (node.kind, c.kind)
        assert not node.named or node.kind in kinds(language), node.kind
    policy_imports(text, language)
    assignments(text, language)


@pytest.mark.parametrize("language", model.LANGUAGES)
def test_deep_and_long_texts(language):
    parse("(" * 3000 + "f(1)" + ")" * 3000, language)
    parse("f(" * 3000, language)
    parse("a." * 5000 + "b", language)
    parse("!" * 3000 + "a", language)
    parse("x = " * 3000 + "1", language)
    parse("if (a) { } else " * 3000, language)
    parse("@A(" * 3000 + "{" * 3000, language)
    parse("a ? b : " * 3000, language)
    parse("f(1);\n" * 5000, language)


def found(query, source, language="typescript"):
    return [{k: source[n.start : n.end] for k, n in m.items()} for m in Query(query).matches(parse(source, language))]


def test_queries():
    s = 'f("a", b, "c"); o.g(1);'
    call = "(call_expression function: (identifier) @f arguments: (arguments {})) @match"
    assert [m["x"] for m in found(call.format("(string) @x"), s)] == ['"a"', '"c"']
    assert [m["x"] for m in found(call.format(". (string) @x"), s)] == ['"a"']
    assert [m["x"] for m in found(call.format("(string) @x ."), s)] == ['"c"']
    assert [(m["x"], m["y"]) for m in found(call.format("(_) @x . (_) @y"), s)] == [('"a"', "b"), ("b", '"c"')]
    assert [m["x"] for m in found(call.format("[(identifier) (string)] @x"), s)] == ['"a"', "b", '"c"']
    assert found("(member_expression object: (_) @o property: (property_identifier) @p) @match", s) == [{"o": "o", "p": "g", "match": "o.g"}]
    assert found('(binary_expression operator: ["==" "==="] @op) @match', "a === b; a != b") == [{"op": "===", "match": "a === b"}]
    assert len(found("(call !receiver method: (identifier) @m) @match", "a.f(1)\ng(2)\n", "ruby")) == 1
    assert found("(call method: (identifier) @m arguments: (argument_list (identifier) @a (simple_symbol)? @s)) @match", "f(x)\nf(x, :y)\n", "ruby") == [{"m": "f", "a": "x", "match": "f(x)"}, {"m": "f", "a": "x", "s": ":y", "match": "f(x, :y)"}]
    for bad in ("", "(a", "(a) )", "(a (#eq? @x 1))", "(a (b)*)"):
        with pytest.raises(QueryError):
            Query(bad)


@pytest.mark.parametrize(("language", "integer", "real"), [
    ("typescript", "number", "number"), ("javascript", "number", "number"), ("python", "integer", "float"), ("go", "int_literal", "float_literal"), ("ruby", "integer", "float"),
    ("java", "decimal_integer_literal", "decimal_floating_point_literal"), ("csharp", "integer_literal", "real_literal"), ("kotlin", "number_literal", "float_literal"), ("php", "integer", "float"),
])
def test_numbers(language, integer, real):
    source = ("<?php " if language == "php" else "") + "f(12, 1.5, x1, 2e-3)"
    of = lambda kind: [m["x"] for m in found(f"({kind}) @x", source, language)]
    assert of(integer) == (["12"] if integer != real else ["12", "1.5", "2e-3"])
    assert of(real)[-2:] == ["1.5", "2e-3"] and "12" not in of("identifier")
    rules.Rule("r", (language,), "rbac", "high", "d", f"({real}) @match").compiled()


def test_groups_and_runs():
    s = 'f("a", b, "c", "d", e); g(b, "x"); h();'
    args = "(call_expression function: (identifier) @f arguments: (arguments {}))"
    seen = lambda inner: [(m["f"], m.get("x"), m.get("y")) for m in found(args.format(inner), s)]
    assert seen("((string) @x . (identifier) @y)") == [("f", '"a"', "b"), ("f", '"d"', "e")]
    assert seen("((string) @x . (identifier) @y)?") == [("f", '"a"', "b"), ("f", '"d"', "e"), ("g", None, None), ("h", None, None)]
    assert seen("(string)+ @x") == [("f", '"d"', None), ("g", '"x"', None)]
    assert seen("(string)+ @x . (string) @y") == [("f", '"c"', '"d"')]
    assert seen("(string)+ @x (identifier) @y") == [("f", '"d"', "e")]
    assert seen(". [(string) (identifier)]+ @x .") == [("f", "e", None), ("g", '"x"', None)]
    assert seen("((identifier) @x . (string) @y)+") == [("f", "b", '"c"'), ("g", "b", '"x"')]
    assert seen("((string)+ @x)?") == [("f", '"d"', None), ("g", '"x"', None), ("h", None, None)]
    assert found("((number) @x . (string) @y)", "f(1, 'a', 2, 'b'); g('c', 3)") == [{"x": "1", "y": "'a'"}, {"x": "2", "y": "'b'"}]
    assert found("(number)+ @x", "f(1, 2); g(3)") == [{"x": "2"}, {"x": "3"}]
    assert found("((call_expression) @x)", "f(1)") == [{"x": "f(1)"}]
    for bad in ("((a) (b)) @x", "((a) .)", "[(a)+ (b)]", "(x f: ((a) (b)))", "((a) (#eq? @x 1))", "((a) (b)", "()"):
        with pytest.raises(QueryError):
            Query(bad)


def test_long_runs_take_linear_time():
    assert found("(arguments (number)+ @x (string))", "f(" + "1, " * 20000 + "2)") == []


def test_one_annotation_with_two_texts_is_two_matches():
    s = 'class A { @Secured({"A"}) @RolesAllowed("B") void f() { } }'
    m = Matcher(rules.builtin())
    assert [x["rule_id"] for x in m.matches(s, "java")] == ["java-roles-allowed"]
    s = "class A {\n  @org.x.Secured(\"A\")\n  void f() { }\n}"
    (x,) = m.matches(s, "java")
    assert (x["rule_id"], x["provenance"], x["line_start"], x["line_end"]) == ("java-spring-secured", "org.x", 2, 2)


def test_declarations_are_no_calls():
    m = Matcher(rules.builtin())
    assert not m.matches("class A { boolean isProjectAdmin(User u) { return true; } abstract boolean hasOrgAccess(User u); }", "java")
    assert not m.matches("class A {\n  hasRole(x: string): boolean { return true; }\n}", "typescript")
    assert not m.matches("class A { bool IsInRole(string r) => true; }", "csharp")
    assert not m.matches("fun hasRole(r: String): Boolean { return true }", "kotlin")
    assert not m.matches("def has_role(x):\n    return x\n", "python")
    assert not m.matches("# has_role('a')\n'''has_role(\"b\")'''\n", "python")


@pytest.mark.parametrize(("language", "text", "bound", "free"), [
    ("typescript", 'import d, {a as b, c} from "../authz/x"; import * as ns from "./policy"; const {m: n} = require("./rego"); import {u} from "./utils";', {"d", "b", "c", "ns", "n"}, {"a", "m", "u"}),
    ("go", 'package m\nimport (\n "a/authz"\n p "x/policy"\n _ "opa"\n . "rego"\n "fmt"\n)\n', {"authz", "p"}, {"fmt", "_", "."}),
    ("python", "import authz.core as ac, os\nimport opa.client\nfrom policy import x as y, z\nfrom a.opa import *\n", {"ac", "opa", "y", "z"}, {"os", "*", "x"}),
    ("java", "import com.authz.Engine; import static x.policy.Y.check; import q.opa.*; import a.B;", {"Engine", "check"}, {"*", "B"}),
    ("csharp", "using Pol = A.Policy.Thing; using X.Policy;", {"Pol"}, {"Policy"}),
    ("php", "<?php use App\\Policy\\A as B; use function x\\authz\\check; use P\\opa\\{C, D as E}; use X\\Y;", {"B", "check", "C", "E"}, {"A", "D", "Y"}),
    ("kotlin", "import authz.Engine\n", set(), {"Engine"}), ("ruby", "require 'authz'\n", set(), set()),
])
def test_policy_imports(language, text, bound, free):
    got = policy_imports(text, language)
    assert got == bound and not got & free


@pytest.mark.parametrize(("language", "text", "edges"), [
    ("go", "func f() {\n a, b := authz.New(), other()\n c, d := both()\n var e = a\n s := S{Engine: a}\n x.y = e\n}", {("a", "authz.New()"), ("b", "other()"), ("c", "both()"), ("d", "both()"), ("e", "a"), ("Engine", "a"), ("y", "e")}),
    ("python", "self.e = y.make(1, 2)\na, b = y, os\nif (n := z()): pass\n", {("e", "y.make(1, 2)"), ("a", "y"), ("b", "os"), ("n", "z()")}),
    ("java", "class A { private final Engine e = new Engine(1, 2); A() { this.f = e; } }", {("e", "new Engine(1, 2)"), ("f", "e")}),
    ("csharp", "class A { IAuthz _a; A(Pol p) { _a = p; var z = _a.Get(1, 2); } }", {("_a", "IAuthz"), ("p", "Pol"), ("_a", "p"), ("z", "_a.Get(1, 2)")}),
    ("php", "<?php class Q { private B $b = null; function f(B $g) { $this->h = $g; $x = new E(1, 2); } }", {("b", "B"), ("g", "B"), ("h", "$g"), ("x", "new E(1, 2)")}),
    ("typescript", "const e = b.make(); this.f = e; const o = {eng: e, y: 2};", {("e", "b.make()"), ("f", "e"), ("eng", "e")}),
])
def test_assignments(language, text, edges):
    assert edges <= set(assignments(text, language))


def test_render():
    c = {"role_value": '"admin"', "roles": '"a, b"'}
    assert render("{{role_value}} {{roles_set}} {{nope}}", c, "rego") == 'admin "a", "b" {{nope}}'
    assert render("[{{cedar_roles_set}}]", {"role_value": "'x,y'"}, "cedar") == '["x", "y"]'


def test_markup_in_code():
    s = 'const P = () => { return <div><b>x</b> {hasRole("a")} <i>y</i> {user.roles.includes("b")}</div>; };\nif (user.role === "c") { f(<A x={1}/>); }\nconst r = /hasRole("z")/;\n'
    got = [(x["rule_id"], x["captures"]) for x in Matcher(rules.builtin()).matches(s, "typescript")]
    assert sorted(dict(c)["role_value"] for _, c in got) == ['"a"', '"b"', '"c"']


@pytest.mark.parametrize("language", model.LANGUAGES)
def test_kinds_of_all_examples_are_known(language):
    text = "\n".join(examples.source(language, code) for code, _, _ in examples.EXAMPLES["typescript" if language == "javascript" else language])
    assert {n.kind for n in parse(text, language).walk() if n.named} <= kinds(language)


@pytest.mark.parametrize(("language", "query"), [
    ("typescript", "(import_statement) @match"), ("typescript", "(return_statement) @match"), ("python", "(if_statement) @match"), ("python", "(call function: (no_such_thing)) @match"), ("go", "(function_declaration) @match"), ("ruby", "[(call) (call_expression)] @match"),
])
def test_kinds_that_no_tree_has_are_refused(language, query):
    rule = rules.Rule("r", (language,), "rbac", "high", "d", query)
    with pytest.raises(RuleError, match="have no nodes of kind"):
        rule.compiled()
    assert "r" in Matcher([rule]).refused
