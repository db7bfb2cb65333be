"""Settings of a deep pass: arguments before the settings file before defaults."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from urllib.parse import urlsplit

from portcullis.sources.config import Config, ConfigError


@dataclass
class Settings:
    mode: str
    base_url: str = ""
    model: str = ""
    agent_cmd: str = ""
    api_key: str | None = field(default=None, repr=False)
    max_cost: float | None = None
    rate_in: float = 0.0
    rate_out: float = 0.0
    request_timeout: int = 120
    agent_timeout: int = 600
    max_candidates: int = 50
    max_concurrent: int = 4
    temperature: float = 0.0
    max_prompt_chars: int = 16_000
    excludes: list[str] = field(default_factory=list)
    languages: list[str] = field(default_factory=list)


def is_local(base_url: str) -> bool:
    low = base_url.lower()
    return any(f"://{h}" in low for h in ("localhost", "127.0.0.1", "[::1]", "0.0.0.0"))


def mode(config: Config, base_url: str | None = None, agent_cmd: str | None = None) -> str:
    """http or subprocess: by the arguments, by the file's mode, by what else the file has."""
    if agent_cmd and base_url:
        raise ConfigError("agent_cmd and base_url choose different transports: give one")
    if agent_cmd or base_url:
        return "subprocess" if agent_cmd else "http"
    if given := (config.deep.mode or "").strip().lower():
        if given not in ("http", "subprocess"):
            raise ConfigError(f"mode is http or subprocess, not {given!r}")
        return given
    has_agent, has_url = bool((config.deep.agent_cmd or "").strip()), bool((config.deep.base_url or "").strip())
    if has_agent and has_url:
        raise ConfigError("the settings have base_url and agent_cmd: set mode too")
    return "subprocess" if has_agent else "http"


def _amount(name: str, x: float | None) -> float | None:
    if x is not None and not (math.isfinite(x) and x >= 0):
        raise ConfigError(f"{name} is a finite number from 0 up, not {x!r}")
    return x


def build(config: Config, base_url=None, model=None, agent_cmd=None, api_key=None, max_cost=None, excludes=(), languages=()) -> Settings:
    d = config.deep
    out = Settings(mode(config, base_url, agent_cmd), api_key=api_key or None)
    out.max_cost = _amount("max_cost", max_cost if max_cost is not None else d.max_cost)
    out.rate_in, out.rate_out = _amount("cost_per_1k_input", d.cost_per_1k_input) or 0.0, _amount("cost_per_1k_output", d.cost_per_1k_output) or 0.0
    out.excludes, out.languages = [*config.scan.exclude, *excludes], list(languages)
    if out.mode == "http":
        out.base_url, out.model = base_url or d.base_url or "", (model or d.model or "").strip()
        if not out.base_url or urlsplit(out.base_url).scheme not in ("http", "https") or not urlsplit(out.base_url).netloc:
            raise ConfigError(f"base_url is needed, with http or https, not {out.base_url!r}")
        if not out.model:
            raise ConfigError("model is needed")
        out.max_concurrent = 4 if is_local(out.base_url) else 1
    else:
        out.agent_cmd = (agent_cmd or d.agent_cmd or "").strip()
        if not out.agent_cmd:
            raise ConfigError("agent_cmd is needed")
        out.agent_timeout = d.agent_timeout_secs or out.agent_timeout
    return out
