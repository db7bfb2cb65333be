"""Settings from a TOML file."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path

FILE = ".portcullis.toml"

DEFAULT = """[scan]
exclude = ["vendor/**", "node_modules/**", "target/**"]
# languages = ["java", "python"]
# min_confidence = "medium"

# [deep]
# mode = "http"                    # or "subprocess"
# base_url = "http://localhost:11434/v1"
# model = "name-of-a-model"
# agent_cmd = "command that reads a request on stdin"
# agent_timeout_secs = 600
# max_cost = 5.0                   # dollars; needs the rates below
# cost_per_1k_input = 0.0
# cost_per_1k_output = 0.0

[extract]
package_prefix = "app.authz"
output_dir = "./policies/generated"

# [rules]
# additional = ["./rules"]
"""


class ConfigError(ValueError):
    pass


@dataclass
class Scan:
    exclude: list[str] = field(default_factory=list)
    languages: list[str] = field(default_factory=list)
    min_confidence: str | None = None


@dataclass
class Deep:
    mode: str | None = None
    base_url: str | None = None
    model: str | None = None
    agent_cmd: str | None = None
    agent_timeout_secs: int | None = None
    max_cost: float | None = None
    cost_per_1k_input: float | None = None
    cost_per_1k_output: float | None = None


@dataclass
class Extract:
    package_prefix: str | None = None
    output_dir: str | None = None


@dataclass
class Rules:
    additional: list[str] = field(default_factory=list)


@dataclass
class Config:
    scan: Scan = field(default_factory=Scan)
    deep: Deep = field(default_factory=Deep)
    extract: Extract = field(default_factory=Extract)
    rules: Rules = field(default_factory=Rules)


def load(path: str | Path) -> Config:
    """Defaults if there is no file; unknown keys are passed over."""
    path = Path(path)
    if not path.exists():
        return Config()
    try:
        given = tomllib.loads(path.read_text(encoding="utf-8"))
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(f"{path}: {e}") from e
    parts = {}
    for part in fields(Config):
        kind = part.default_factory
        known = {f.name for f in fields(kind)}
        parts[part.name] = kind(**{k: v for k, v in given.get(part.name, {}).items() if k in known})
    return Config(**parts)


def write_default(folder: str | Path) -> Path:
    """A new settings file; one that is there is never overwritten."""
    path = Path(folder) / FILE
    with path.open("x", encoding="utf-8") as f:
        f.write(DEFAULT)
    return path
