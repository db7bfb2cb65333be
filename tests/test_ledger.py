"""Calls from tasks: each request once, and what is asked under a cost cap as if one by one."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from portcullis import rules
from portcullis.deep import ledger as L
from portcullis.deep import run as deep
from portcullis.deep.settings import Settings
from portcullis.deep.transports import Answer, Http, Skip, Subprocess
from portcullis.operators.scan import Scan
from portcullis.sources.config import ConfigError

GOOD = {"line_start": 2, "line_end": 2, "category": "ownership", "confidence": "high", "description": "d", "reasoning": "r", "is_false_positive": False}


@pytest.fixture
def server():
    """Answers each request with a finding, 100 tokens for each line of it; counts requests by their text."""
    seen: dict[str, int] = {}

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            user = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["messages"][1]["content"]
            seen[user] = seen.get(user, 0) + 1
            code = 503 if "skipme" in user else 401 if "stopme" in user else 200
            self.send_response(code)
            self.end_headers()
            self.wfile.write(json.dumps({"choices": [{"message": {"content": json.dumps({"findings": [GOOD]})}}], "usage": {"prompt_tokens": 100 * len(user.split()), "completion_tokens": 10}}).encode())

        def log_message(self, *_):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}/v1", seen
    s.shutdown()


def test_a_repeated_task_reads_instead_of_asking(tmp_path):
    calls = []

    def ask(request):
        calls.append(request)
        if request == "skip":
            raise Skip("busy")
        if request == "stop":
            raise ConfigError("no key")
        return Answer([GOOD], 5, 6)

    a, b = L.Ledger(str(tmp_path)), L.Ledger(str(tmp_path))
    want = {"findings": [GOOD], "input_tokens": 5, "output_tokens": 6}
    assert a.asked(ask, "x") == b.asked(ask, "x") == a.asked(ask, "x") == want and calls == ["x"]
    assert a.asked(ask, "skip") == b.asked(ask, "skip") == {"skip": "busy"} and calls == ["x", "skip"]
    assert a.asked(ask, "stop") == {"error": "no key"} and b.get("stop") is None
    assert b.put("x", {"skip": "later"}) == want  # the first entry stays
    assert len(list(tmp_path.iterdir())) == 2


def test_waves_ask_what_one_by_one_would(spark, server, tmp_path):
    url, seen = server
    requests = [(i, " ".join(["word"] * (i % 5 + 1)) + f" {i}") for i in range(1, 13)] + [(13, "skipme 13")]
    for n, (cap, rate_in, rate_out, most) in enumerate([(None, 1.0, 0.0, 4), (2.0, 1.0, 0.0, 4), (0.0, 1.0, 0.0, 4), (1.1, 1.0, 5.0, 4), (40.0, 1.0, 0.0, 3), (1.5, 0.0, 0.0, 4)]):
        s = Settings("http", base_url=url, model="m", max_cost=cap, rate_in=rate_in, rate_out=rate_out, max_concurrent=most)
        seen.clear()
        want = list(L.one_by_one(requests, s, Http(s)))
        serial = dict(seen)
        seen.clear()
        assert list(L.ask_all(spark, requests, s, Http(s), str(tmp_path / f"l{n}"))) == want
        assert seen == serial and set(seen.values()) == {1}
        assert list(L.ask_all(spark, requests, s, Http(s), str(tmp_path / f"l{n}"))) == want and seen == serial  # all from the ledger
    with pytest.raises(ConfigError, match="401"):
        list(L.ask_all(spark, [(1, "stopme")], s, Http(s), str(tmp_path / "stop")))
    assert L.wave(Settings("http", max_concurrent=8), 0, ["a"] * 20) == 8 and L.wave(Settings("http", rate_in=1.0, max_cost=100.0, max_concurrent=8), 99_999_999, ["a"] * 20) == 1


def test_a_deep_pass_from_tasks(spark, server, tmp_path):
    url, seen = server
    files = spark.createDataFrame([(f"src/f{i}.ts", f"function a(post, user) {{\n  if (post.ownerId === user.id) {{ edit({i}); }}\n}}\n") for i in range(5)], "path string, content string")
    found = Scan(files, rules.builtin()).findings
    s = Settings("http", base_url=url, model="m")
    out = deep.run(found, files, s, Http(s)).collect()
    assert {(r["file"], r["pass"]) for r in out} == {(f"src/f{i}.ts", "semantic") for i in range(5)} and len(seen) == 5 and set(seen.values()) == {1}
    answer = tmp_path / "a.json"
    answer.write_text(json.dumps({"findings": [GOOD]}))
    s = Settings("subprocess", agent_cmd=f"cat > /dev/null; echo x >> {tmp_path}/calls; cat {answer}")
    assert len(deep.run(found, files, s, Subprocess(s)).collect()) == 5 and (tmp_path / "calls").read_text().count("x") == 5
    assert not deep.on_workers(spark, s, lambda user: Answer([]))
