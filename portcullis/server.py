"""The tools of the engine over JSON-RPC lines (Model Context Protocol, 2024-11-05)."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any, TextIO

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from portcullis import model, pages, rules
from portcullis.deep import prompt
from portcullis.functions import text
from portcullis.functions.policy_check import validate
from portcullis.operators import policies, scan
from portcullis.sources.config import Config
from portcullis.sources.files import source_files
from portcullis.sources.sinks import VERSION

PROTOCOL = "2024-11-05"
PARSE_ERROR, INVALID_REQUEST, METHOD_NOT_FOUND, INVALID_PARAMS = -32700, -32600, -32601, -32602


class ToolError(ValueError):
    pass


class ParamsError(ValueError):
    pass


_TEXT, _LANGUAGE = {"type": "string"}, {"type": "string", "enum": list(model.LANGUAGES)}
_CATEGORY, _CONFIDENCE, _ENGINE = {"type": "string", "enum": list(model.CATEGORIES)}, {"type": "string", "enum": list(model.CONFIDENCES)}, {"type": "string", "enum": list(model.ENGINES)}
_LINE = {"type": "integer", "minimum": 1}
#: name -> (description, properties, required)
TOOLS: dict[str, tuple[str, dict, list[str]]] = {
    "scan_authz": ("Scan a folder below scan_root: findings, and how many decisions are left to a policy engine.", {"path": _TEXT, "languages": {"type": "array", "items": _LANGUAGE}, "categories": {"type": "array", "items": _CATEGORY}, "cursor": _TEXT, "page_size": {"type": "integer", "minimum": 1}, "min_confidence": _CONFIDENCE}, []),
    "get_finding_context": ("The lines around a finding and the file's first lines.", {"file": _TEXT, "language": _LANGUAGE, "line_start": _LINE, "line_end": _LINE, "max_chars": {"type": "integer", "minimum": 200}}, ["file", "language", "line_start", "line_end"]),
    "list_rules": ("The pattern rules.", {"language": _LANGUAGE, "category": _CATEGORY}, []),
    "get_rule": ("One rule in full.", {"id": _TEXT}, ["id"]),
    "suggest_rego": ("A Rego policy for a finding.", {"category": _CATEGORY, "confidence": _CONFIDENCE, "code_snippet": _TEXT, "rule_id": _TEXT}, ["category", "confidence", "code_snippet"]),
    "validate_rego": ("Check Rego text.", {"policy": _TEXT}, ["policy"]),
    "suggest_policy": ("A policy for a finding.", {"engine": _ENGINE, "category": _CATEGORY, "confidence": _CONFIDENCE, "code_snippet": _TEXT, "rule_id": _TEXT}, ["category", "confidence", "code_snippet"]),
    "validate_policy": ("Check policy text.", {"engine": _ENGINE, "policy": _TEXT}, ["policy"]),
    "analyze_snippet": ("The request of a deep pass for a snippet, to put to a model of your own.", {"file": _TEXT, "language": _LANGUAGE, "line_start": _LINE, "line_end": _LINE, "snippet": _TEXT, "imports": {"type": "array", "items": _TEXT}, "seed_finding": {"type": "object"}}, ["file", "language", "line_start", "line_end", "snippet"]),
}
_KINDS = {"string": str, "integer": int, "array": list, "object": dict}


def template_variables(snippet: str) -> dict[str, str]:
    """Values for a rule's placeholders, from the string literals of a snippet: the first one, and all as sets."""
    import re

    found = re.findall(r"""["']([^"']+)["']""", snippet)
    if not found:
        return {}
    out = dict.fromkeys(("role_value", "plan_value", "perm_value", "permission", "attribute", "value"), found[0])
    out["roles"] = out["plans"] = "{" + ", ".join(f'"{x}"' for x in found) + "}"
    items = [x.strip() for s in found for x in s.split(",") if x.strip()]
    out["roles_set"] = out["cedar_roles_set"] = ", ".join(f'"{x}"' for x in items)
    return out


class Server:
    def __init__(self, spark: SparkSession, scan_root: str = ".", rules_dir: str | None = None, config: Config | None = None) -> None:
        self.spark, self.root, self.config = spark, Path(scan_root).resolve(), config or Config()
        self.rules = rules.load(self.config.rules.additional, rules_dir)

    def inside(self, path: str | None) -> Path:
        p = (self.root / (path or "")).resolve()
        if not p.is_relative_to(self.root):
            raise ToolError(f"{path} is outside of the scan root")
        if not p.exists():
            raise ToolError(f"no such path: {path}")
        return p

    def arguments(self, name: str, given: Any) -> dict:
        _, known, required = TOOLS[name]
        if not isinstance(given, dict):
            raise ToolError(f"arguments of {name} are an object")
        for k, v in given.items():
            spec = known.get(k)
            if spec is None:
                continue
            if v is not None and (not isinstance(v, _KINDS[spec["type"]]) or isinstance(v, bool)) or "enum" in spec and v is not None and v not in spec["enum"]:
                raise ToolError(f"{name}: {k} can't be {v!r}")
        if missing := [k for k in required if given.get(k) is None]:
            raise ToolError(f"{name} needs {', '.join(missing)}")
        return given

    def call(self, name: str, given: Any) -> dict:
        """The result of a tool, in MCP's form; a tool's trouble is a result too."""
        try:
            if name not in TOOLS:
                raise ToolError(f"unknown tool: {name}")
            value = getattr(self, name)(self.arguments(name, given or {}))
        except (ToolError, OSError) as e:
            return {"content": [{"type": "text", "text": str(e)}], "isError": True}
        return {"content": [{"type": "text", "text": json.dumps(value, ensure_ascii=False)}], "structuredContent": value, "isError": False}

    # tools

    def scan_authz(self, a: dict) -> dict:
        """The first page of the findings in order, with a cursor if there are more; given that, the next page without another scan."""
        if (cursor := a.get("cursor")) is None:
            path = self.inside(a.get("path"))
            s = scan.Scan(source_files(self.spark, str(path), self.config.scan.exclude, ignore=True), self.rules, a.get("min_confidence") or self.config.scan.min_confidence, a.get("categories") or [], a.get("languages") or [])
            ordered = s.findings.withColumn("__components", model.path_order(F.col("file")))
            cursor = pages.write(ordered, ["__components", "line_start", "id"], a.get("page_size") or pages.ROWS)
            out = {"findings": [], "enforcement_points": s.enforcement_points.count()}
            if cursor is None:
                return out
        else:
            out = {"findings": []}
        try:
            rows, after = pages.read(self.spark, cursor)
        except pages.CursorError as e:
            raise ToolError(str(e)) from e
        names = [c for c in rows.columns if c != "__components"]
        out["findings"] = [json.loads(r["j"]) for r in rows.select(F.to_json(F.struct(*names)).alias("j")).collect()]  # at most a page
        return out | ({"next_cursor": after} if after else {})

    def get_finding_context(self, a: dict) -> dict:
        content = self.inside(a["file"]).read_text(encoding="utf-8")
        one = self.spark.createDataFrame([(content, a["line_start"], a["line_end"])], "content string, a bigint, b bigint")
        x = one.select(text.context(F.col("content"), F.col("a"), F.col("b"), a.get("max_chars") or 16_000).alias("x")).first()["x"]
        return {"file": a["file"], "language": a["language"], **x.asDict()}

    def list_rules(self, a: dict) -> dict:
        kept = [r for r in self.rules if a.get("language") in (None, *r.languages) and a.get("category") in (None, r.category)]
        return {"rules": [{"id": r.id, "languages": list(r.languages), "category": r.category, "confidence": r.confidence, "description": r.description, "template_engines": [e for e, _ in r.templates]} for r in kept]}

    def rule(self, id_: str) -> rules.Rule | None:
        return next((r for r in self.rules if r.id == id_), None)

    def get_rule(self, a: dict) -> dict:
        r = self.rule(a["id"])
        if r is None:
            raise ToolError(f"no rule with id: {a['id']}")
        return {
            "id": r.id, "languages": list(r.languages), "category": r.category, "confidence": r.confidence, "description": r.description, "externalized": r.externalized, "query": r.query,
            "predicates": [{"capture": c, "kind": k, "value": v} for c, k, v in r.predicates], "cross_predicates": [{"kind": k, "captures": list(c), "match": v} for k, c, v in r.cross],
            "policy_templates": [{"engine": e, "template": t} for e, t in r.templates], "tests": [{"input": t.input, "language": t.language, "expect_match": t.expect_match} for t in r.tests],
        }

    def suggest_rego(self, a: dict) -> dict:
        return self.suggest_policy({**a, "engine": "rego"})

    def suggest_policy(self, a: dict) -> dict:
        engine = a.get("engine") or "rego"
        rule = self.rule(a["rule_id"]) if a.get("rule_id") else None
        template = rule.template(engine) if rule else None
        one = self.spark.createDataFrame([(a["category"], a["confidence"], a["code_snippet"])], "category string, confidence string, code_snippet string")
        if template is not None:
            import re

            values = template_variables(a["code_snippet"])
            raw = ("roles_set",) if engine == "rego" else tuple(k for k in values if k.endswith("_set"))
            body = F.lit(re.sub(r"\{\{(\w+)\}\}", lambda m: (values[m[1]] if m[1] in raw else scan.strip_quotes(values[m[1]])) if m[1] in values else m[0], template))
        else:
            body = policies.default_stub(engine, F.col("category"), F.col("code_snippet"))
        wrapped = one.select(text.by_confidence(body, F.col("confidence"), engine).alias("p")).first()["p"]
        return {"engine": engine, "policy": wrapped, engine: wrapped}

    def validate_rego(self, a: dict) -> dict:
        return self.validate_policy({**a, "engine": "rego"})

    def validate_policy(self, a: dict) -> dict:
        valid, error = validate(a.get("engine") or "rego", a["policy"])
        return {"valid": valid, "error": error}

    def analyze_snippet(self, a: dict) -> dict:
        seed = a.get("seed_finding") or {}
        c = self.spark.createDataFrame([(1, a["file"], a["language"], a["line_start"], a["line_end"], a["snippet"], a.get("imports") or [], seed.get("id"))], "candidate int, file string, language string, line_start bigint, line_end bigint, source_snippet string, imports array<string>, original_finding_id string")
        f = self.spark.createDataFrame([(seed["id"], seed.get("category"), seed.get("confidence"))] if seed.get("id") else [], "id string, category string, confidence string")
        return {"system": prompt.SYSTEM, "user": prompt.requests(c, f).first()["user"], "schema": prompt.SCHEMA}

    # resources

    def resources(self) -> list[dict]:
        out = [{"uri": "prompt://system", "name": "The system part of requests", "mimeType": "text/plain"}, {"uri": "prompt://schema", "name": "The schema of answers", "mimeType": "application/json"}]
        out += [{"uri": f"category://{c}", "name": name, "description": prompt.CATEGORY_NOTES[c][0], "mimeType": "application/json"} for c, name in model.CATEGORIES.items()]
        return out + [{"uri": f"rule://{r.id}", "name": r.id, "description": r.description, "mimeType": "application/json"} for r in self.rules]

    def resource(self, uri: str) -> dict:
        kind, _, name = uri.partition("://")
        if uri == "prompt://system":
            return {"uri": uri, "mimeType": "text/plain", "text": prompt.SYSTEM}
        if uri == "prompt://schema":
            body: Any = prompt.SCHEMA
        elif kind == "category" and name in model.CATEGORIES:
            body = {"category": name, "display_name": model.CATEGORIES[name], "description": prompt.CATEGORY_NOTES[name][0], "examples": [r.id for r in self.rules if r.category == name][:5]}
        elif kind == "rule" and self.rule(name):
            body = self.get_rule({"id": name})
        else:
            raise ParamsError(f"unknown resource: {uri}")
        return {"uri": uri, "mimeType": "application/json", "text": json.dumps(body, indent=2, ensure_ascii=False)}

    # protocol

    def result(self, method: str, params: dict) -> dict | None:
        """None: there is no such method."""
        if method == "initialize":
            return {"protocolVersion": PROTOCOL, "capabilities": {"tools": {"listChanged": False}, "resources": {"listChanged": False, "subscribe": False}}, "serverInfo": {"name": "portcullis", "version": VERSION}}
        if method == "ping":
            return {}
        if method == "tools/list":
            return {"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": p, "required": r, "additionalProperties": False}} for n, (d, p, r) in TOOLS.items()]}
        if method == "tools/call":
            if not isinstance(params.get("name"), str):
                raise ParamsError("tools/call needs a name")
            return self.call(params["name"], params.get("arguments"))
        if method == "resources/list":
            return {"resources": self.resources()}
        if method == "resources/read":
            if not isinstance(params.get("uri"), str):
                raise ParamsError("resources/read needs a uri")
            return {"contents": [self.resource(params["uri"])]}
        return None

    def line(self, line: str) -> dict | None:
        """The answer to a line; None to notifications and blank lines."""
        if not line.strip():
            return None
        fail = lambda id_, code, message: {"jsonrpc": "2.0", "id": id_, "error": {"code": code, "message": message}}
        try:
            request = json.loads(line)
        except ValueError as e:
            return fail(None, PARSE_ERROR, f"parse error: {e}")
        if not isinstance(request, dict) or request.get("jsonrpc") != "2.0" or not isinstance(request.get("method"), str):
            return fail(request.get("id") if isinstance(request, dict) else None, INVALID_REQUEST, "not a request of JSON-RPC 2.0")
        if "id" not in request:
            return None
        params = request.get("params")
        try:
            if params is not None and not isinstance(params, dict):
                raise ParamsError("params are an object")
            out = self.result(request["method"], params or {})
        except ParamsError as e:
            return fail(request["id"], INVALID_PARAMS, str(e))
        if out is None:
            return fail(request["id"], METHOD_NOT_FOUND, f"unknown method: {request['method']}")
        return {"jsonrpc": "2.0", "id": request["id"], "result": out}

    def serve(self, lines: TextIO, out: TextIO) -> None:
        for line in lines:
            answer = self.line(line)
            if answer is not None:
                out.write(json.dumps(answer, ensure_ascii=False, separators=(",", ":")) + "\n")
                out.flush()
