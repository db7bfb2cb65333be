"""Ways to put a request to a model. Skip: this candidate is left out. ConfigError: the whole pass stops."""

from __future__ import annotations

import json
import os
import re
import signal
import subprocess
import urllib.error
import urllib.request
from dataclasses import dataclass
from typing import Protocol

from portcullis import model
from portcullis.deep.prompt import SCHEMA, SYSTEM
from portcullis.deep.settings import Settings
from portcullis.sources.config import ConfigError


class Skip(Exception):
    """A passing trouble or an answer that can't be used."""


class BadAnswer(Skip):
    pass


@dataclass
class Answer:
    findings: list[dict]
    input_tokens: int = 0
    output_tokens: int = 0


class Analyzer(Protocol):
    def __call__(self, user: str) -> Answer: ...


def strip_fence(s: str) -> str:
    s = s.strip()
    if s.startswith("```"):
        s = s.partition("\n")[2] if "\n" in s else s[3:]
    return s.rstrip().removesuffix("```").strip()


def preview(s: str) -> str:
    b = s.encode()
    return s if len(b) <= 200 else b[:200].decode(errors="ignore") + "..."


_FIELDS = {"line_start": int, "line_end": int, "category": str, "confidence": str, "description": str, "reasoning": str, "is_false_positive": bool}


def read_findings(content: str) -> list[dict]:
    """The findings of an answer; every field must be there and of its kind."""
    try:
        found = json.loads(strip_fence(content))["findings"]
        out = [{k: x[k] for k in _FIELDS} for x in found]
    except (ValueError, KeyError, TypeError) as e:
        raise BadAnswer(f"no findings in {preview(content)!r}") from e
    for x in out:
        ok = all(type(x[k]) is t for k, t in _FIELDS.items()) and min(x["line_start"], x["line_end"]) >= 0
        if not ok or x["category"] not in model.CATEGORIES or x["confidence"] not in model.CONFIDENCES:
            raise BadAnswer(f"a finding of the wrong form: {preview(json.dumps(x))}")
    return out


class Http:
    """POST base_url/chat/completions; once more without the schema if that, or the answer, isn't taken."""

    def __init__(self, settings: Settings) -> None:
        self.s = settings

    def __call__(self, user: str) -> Answer:
        try:
            return self._once(user, True)
        except BadAnswer:
            return self._once(user, False)

    def _once(self, user: str, with_schema: bool) -> Answer:
        body = {"model": self.s.model, "temperature": self.s.temperature, "messages": [{"role": "system", "content": SYSTEM}, {"role": "user", "content": user}]}
        if with_schema:
            body["response_format"] = {"type": "json_schema", "json_schema": {"name": "findings", "strict": True, "schema": SCHEMA}}
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.s.api_key}"} if self.s.api_key else {})
        request = urllib.request.Request(f"{self.s.base_url.rstrip('/')}/chat/completions", json.dumps(body).encode(), headers)
        try:
            with urllib.request.urlopen(request, timeout=self.s.request_timeout) as response:
                raw = response.read()
        except urllib.error.HTTPError as e:
            if e.code in (400, 422) and with_schema:
                raise BadAnswer(f"the schema was refused ({e.code})") from e
            if e.code == 429 or e.code >= 500:
                raise Skip(f"HTTP {e.code}") from e
            raise ConfigError(f"HTTP {e.code} from {self.s.base_url}") from e
        except (OSError, TimeoutError) as e:
            raise Skip(f"no answer: {e}") from e
        try:
            answer = json.loads(raw)
            content = answer["choices"][0]["message"]["content"]
            usage = answer.get("usage") or {}
            return Answer(read_findings(content), int(usage.get("prompt_tokens", 0)), int(usage.get("completion_tokens", 0)))
        except (ValueError, KeyError, IndexError, TypeError, AttributeError) as e:
            raise BadAnswer(f"not an answer: {e!r}") from e


def unwrap(s: str) -> str:
    """What stands in an agent's result envelope, or s itself."""
    try:
        e = json.loads(s)
    except ValueError:
        return s
    if not isinstance(e, dict) or e.get("type") != "result":
        return s
    if e.get("is_error") or e.get("subtype", "success") != "success" or not isinstance(e.get("result"), str):
        raise BadAnswer("the agent reports an error")
    return e["result"]


class Subprocess:
    """A shell command that reads a JSON request on stdin and answers on stdout; its process group ends with the time."""

    def __init__(self, settings: Settings) -> None:
        self.s = settings

    def __call__(self, user: str) -> Answer:
        p = subprocess.Popen(["sh", "-c", self.s.agent_cmd], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.PIPE, text=True, start_new_session=True)
        try:
            out, err = p.communicate(json.dumps({"system": SYSTEM, "user": user, "schema": SCHEMA}), timeout=self.s.agent_timeout)
        except subprocess.TimeoutExpired as e:
            os.killpg(p.pid, signal.SIGKILL)
            p.wait()
            raise Skip(f"no answer within {self.s.agent_timeout} s") from e
        if p.returncode:
            raise Skip(f"exit {p.returncode}: {preview(re.sub(r'[\r\n]+', ' ', err))}")
        return Answer(read_findings(unwrap(out.strip())))


def analyzer(settings: Settings) -> Analyzer:
    return Http(settings) if settings.mode == "http" else Subprocess(settings)
