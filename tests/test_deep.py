import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from portcullis import rules
from portcullis.deep import prompt
from portcullis.deep import run as deep
from portcullis.deep.settings import Settings, build, is_local, mode
from portcullis.deep.transports import Answer, BadAnswer, Http, Skip, Subprocess, read_findings, strip_fence, unwrap
from portcullis.operators.scan import Scan
from portcullis.sources.config import Config, ConfigError, Deep

GOOD = {"line_start": 4, "line_end": 5, "category": "ownership", "confidence": "high", "description": "d", "reasoning": "r", "is_false_positive": False}
CODE = "import express from 'express';\nfunction a(post, user) {\n  // here\n  if (post.ownerId === user.id) {\n    edit(post);\n  }\n}\n" + "\n" * 40 + "function checkPermission(u) {\n  return u;\n}\n"


@pytest.fixture(scope="module")
def scanned(spark):
    files = spark.createDataFrame([("src/a.ts", CODE), ("src/plain.ts", "x = 1;\n")], "path string, content string")
    return Scan(files, rules.builtin()).findings.cache(), files


def run(scanned, answers, **k):
    asked = []

    def ask(user):
        asked.append(user)
        a = answers(user) if callable(answers) else answers
        if isinstance(a, Exception):
            raise a
        return Answer(a, 1000, 0)

    out = deep.run(*scanned, Settings("http", **k), ask)
    return sorted((r["pattern_rule"], r["line_start"], r["line_end"], r["pass"]) for r in out.collect()), asked


def test_candidates_and_requests(scanned):
    _, asked = run(scanned, [])
    assert len(asked) == 2
    assert "Lines: 1-19" in asked[0] and "A structural rule flagged this region as Ownership (medium)" in asked[0] and "- Express: " in asked[0] and "   4:   if (post.ownerId" in asked[0]
    assert "checkPermission" in asked[1] and "flagged" not in asked[1]


def test_answers_replace_add_and_reject(scanned):
    first = lambda user: "flagged" in user
    assert run(scanned, [])[0] == [("ts-ownership-check", 4, 4, "structural")]
    assert run(scanned, lambda u: [GOOD] if first(u) else [])[0] == [("ts-ownership-check-semantic", 4, 5, "semantic")]
    assert run(scanned, lambda u: [GOOD | {"line_start": 6, "line_end": 99, "category": "rbac"}] if first(u) else [])[0] == [("semantic-rbac", 6, 19, "semantic"), ("ts-ownership-check", 4, 4, "structural")]
    assert run(scanned, lambda u: [GOOD | {"is_false_positive": True}] if first(u) else [])[0] == []
    assert run(scanned, lambda u: [GOOD | {"line_start": 0}, GOOD | {"line_start": 30, "line_end": 31}] if first(u) else [])[0] == [("ts-ownership-check", 4, 4, "structural")]


def test_troubles_skip_and_costs_stop(scanned):
    assert run(scanned, Skip("x"))[0] == [("ts-ownership-check", 4, 4, "structural")]
    with pytest.raises(ConfigError):
        run(scanned, ConfigError("no"))
    found, asked = run(scanned, [GOOD], rate_in=2.0, max_cost=1.0)
    assert len(asked) == 1 and found == [("ts-ownership-check-semantic", 4, 5, "semantic")]
    assert len(run(scanned, [], rate_in=2.0, max_cost=2.0)[1]) == 2
    assert len(run(scanned, [], max_candidates=1)[1]) == 1


def test_answers_are_checked():
    assert read_findings("```json\n" + json.dumps({"findings": [GOOD]}) + "\n```") == [GOOD]
    for bad in ("", "[]", "{}", json.dumps({"findings": [GOOD | {"category": "x"}]}), json.dumps({"findings": [GOOD | {"line_start": "1"}]}), json.dumps({"findings": [{}]})):
        with pytest.raises(BadAnswer):
            read_findings(bad)
    assert strip_fence("```\nx```") == "x" and unwrap('{"type": "result", "result": "y"}') == "y" and unwrap('{"type": "z"}') == '{"type": "z"}' and unwrap("no") == "no"
    for bad in ({"is_error": True, "result": "y"}, {"subtype": "error", "result": "y"}, {}):
        with pytest.raises(BadAnswer):
            unwrap(json.dumps({"type": "result"} | bad))


@pytest.fixture
def server():
    seen, script = [], []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, self.headers.get("Authorization"), body))
            code, text = script.pop(0)
            self.send_response(code)
            self.end_headers()
            self.wfile.write(text.encode())

        def log_message(self, *_):
            pass

    s = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}/v1", seen, script
    s.shutdown()


def chat(content):
    return json.dumps({"choices": [{"message": {"content": content}}], "usage": {"prompt_tokens": 7, "completion_tokens": 3}})


def test_http(server):
    url, seen, script = server
    ask = Http(Settings("http", base_url=url, model="m", api_key="k"))
    good = (200, chat(json.dumps({"findings": [GOOD]})))
    script += [good]
    a = ask("u")
    assert (a.findings, a.input_tokens, a.output_tokens) == ([GOOD], 7, 3)
    assert seen[0][:2] == ("/v1/chat/completions", "Bearer k") and seen[0][2]["response_format"]["json_schema"]["schema"] == prompt.SCHEMA
    for first in ((400, ""), (422, ""), (200, "no json"), (200, chat("prose"))):
        seen.clear()
        script += [first, good]
        assert ask("u").findings == [GOOD] and ["response_format" in x[2] for x in seen] == [True, False]
    for code, kind in ((401, ConfigError), (403, ConfigError), (404, ConfigError), (429, Skip), (500, Skip)):
        script += [(code, "")]
        with pytest.raises(kind):
            ask("u")
    script += [(200, chat("prose"))] * 2
    with pytest.raises(BadAnswer):
        ask("u")
    with pytest.raises(Skip):
        Http(Settings("http", base_url="http://127.0.0.1:9", model="m"))("u")


def test_subprocess(tmp_path):
    ask = lambda cmd, t=20: Subprocess(Settings("subprocess", agent_cmd=cmd, agent_timeout=t))("question")
    (tmp_path / "a.json").write_text(json.dumps({"findings": [GOOD]}))
    (tmp_path / "b.json").write_text(json.dumps({"type": "result", "result": json.dumps({"findings": []})}))
    assert ask(f"cat > {tmp_path}/in; cat {tmp_path}/a.json").findings == [GOOD]
    assert json.loads((tmp_path / "in").read_text())["user"] == "question"
    assert ask(f"cat > /dev/null; cat {tmp_path}/b.json").findings == []
    for cmd in ("cat > /dev/null; exit 3", "cat > /dev/null; echo prose"):
        with pytest.raises(Skip):
            ask(cmd)
    with pytest.raises(Skip, match="within"):
        ask("sleep 30", 1)


def test_settings():
    c = lambda **k: Config(deep=Deep(**k))
    assert mode(c()) == "http" and mode(c(agent_cmd="x")) == "subprocess" and mode(c(mode="Subprocess ")) == "subprocess" and mode(c(agent_cmd="x"), base_url="http://a") == "http"
    for bad in (lambda: mode(c(), "http://a", "x"), lambda: mode(c(mode="z")), lambda: mode(c(agent_cmd="x", base_url="y")), lambda: build(c(base_url="ftp://a", model="m")), lambda: build(c(base_url="http://a")), lambda: build(c(base_url="http://a", model="m", max_cost=-1.0)), lambda: build(c(mode="subprocess"))):
        with pytest.raises(ConfigError):
            bad()
    s = build(c(base_url="http://localhost:1/v1", model=" m ", cost_per_1k_input=0.5), max_cost=2.0)
    assert (s.mode, s.model, s.max_cost, s.rate_in, s.max_candidates, s.max_prompt_chars, s.max_concurrent) == ("http", "m", 2.0, 0.5, 50, 16_000, 4)
    assert is_local("HTTP://LOCALHOST:1") and not is_local("https://x.com")


def test_server(spark, tmp_path):
    import io

    from portcullis.server import TOOLS, Server, template_variables

    (tmp_path / "a.ts").write_text('hasRole("admin");\n')
    s = Server(spark, str(tmp_path))
    call = lambda name, **a: s.line(json.dumps({"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": name, "arguments": a}}))["result"]
    assert call("scan_authz")["structuredContent"]["findings"][0]["pattern_rule"] == "ts-has-role-call"
    assert call("scan_authz", path="../")["isError"] and call("scan_authz", languages="x")["isError"] and call("nope")["isError"] and call("get_rule", id="nope")["isError"]
    assert call("get_finding_context", file="a.ts", language="typescript", line_start=1, line_end=1)["structuredContent"]["snippet"] == 'hasRole("admin");'
    assert len(call("list_rules", language="kotlin")["structuredContent"]["rules"]) == 8
    assert call("get_rule", id="ts-has-role-call")["structuredContent"]["predicates"][0]["kind"] == "match"
    out = call("suggest_policy", engine="cedar", category="rbac", confidence="medium", code_snippet='hasRole("admin")', rule_id="ts-has-role-call")["structuredContent"]
    assert out["cedar"].startswith("// TODO: verify this policy\npermit") and 'principal.role == "admin"' in out["policy"]
    rego = call("suggest_rego", category="rbac", confidence="high", code_snippet='x("a:b")')["structuredContent"]["rego"]
    assert '"a:b" in input.user.permissions' in rego and call("validate_rego", policy="package a\n\n" + rego)["structuredContent"]["valid"]
    assert not call("validate_policy", engine="cedar", policy="permit")["structuredContent"]["valid"]
    assert "flagged this region as RBAC (low)" in call("analyze_snippet", file="a.py", language="python", line_start=3, line_end=3, snippet="x", seed_finding={"id": "i", "category": "rbac", "confidence": "low"})["structuredContent"]["user"]
    ask = lambda method, **p: s.line(json.dumps({"jsonrpc": "2.0", "id": "q", "method": method, "params": p}))
    assert ask("initialize")["result"]["protocolVersion"] == "2024-11-05" and ask("ping")["result"] == {}
    assert [t["name"] for t in ask("tools/list")["result"]["tools"]] == list(TOOLS) and len(TOOLS) == 9
    assert len(ask("resources/list")["result"]["resources"]) == 2 + 8 + 108
    for uri in ("prompt://system", "prompt://schema", "category://rbac", "rule://py-has-role-call"):
        assert ask("resources/read", uri=uri)["result"]["contents"][0]["text"]
    assert ask("resources/read", uri="rule://x")["error"]["code"] == -32602 and ask("what")["error"]["code"] == -32601 and s.line("{")["error"]["code"] == -32700 and s.line('{"id": 1}')["error"]["code"] == -32600
    out = io.StringIO()
    s.serve(io.StringIO('\n{"jsonrpc": "2.0", "method": "notifications/x"}\nbad\n{"jsonrpc": "2.0", "id": 2, "method": "ping"}\n'), out)
    assert [json.loads(x).get("id") for x in out.getvalue().splitlines()] == [None, 2]
    assert template_variables("f('a,b', \"c\")")["roles_set"] == '"a", "b", "c"' and template_variables("x") == {}
