"""Rules and their TOML form."""

from __future__ import annotations

import os
import re
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from portcullis import model
from portcullis.syntax import Query, QueryError
from portcullis.syntax.kinds import kinds

KINDS = ("match", "eq", "not_match", "not_eq")
DEEPEST = 10


class RuleError(ValueError):
    pass


@dataclass(frozen=True)
class Test:
    input: str
    expect_match: bool
    language: str | None = None


@dataclass(frozen=True)
class Rule:
    id: str
    languages: tuple[str, ...]
    category: str
    confidence: str
    description: str
    query: str
    predicates: tuple[tuple[str, str, str], ...] = ()  # capture, kind, value
    cross: tuple[tuple[str, tuple[str, ...], str], ...] = ()  # kind, captures, regex
    templates: tuple[tuple[str, str], ...] = ()  # engine, text; one for each engine
    tests: tuple[Test, ...] = field(default=(), repr=False)
    externalized: bool = False
    provenance: str | None = None
    #: all that the query asks for within a block of statements is named in a predicate, so blocks without such names needn't be parsed
    named_blocks: bool = False

    def template(self, engine: str) -> str | None:
        return next((t for e, t in self.templates if e == engine), None)

    def compiled(self) -> Query:
        """The query, once it is known to have all captures that the rule names, and to ask only for nodes that there can be."""
        try:
            q = Query(self.query)
        except QueryError as e:
            raise RuleError(f"{self.id}: {e}") from e
        named = {"match", *(c for c, _, _ in self.predicates), *(c for _, cs, _ in self.cross for c in cs), *([self.provenance] if self.provenance else [])}
        if missing := sorted(named - q.capture_names):
            raise RuleError(f"{self.id}: the query has no capture {', '.join(missing)}")
        for language in self.languages:
            if unknown := sorted(q.kinds - kinds(language)):
                raise RuleError(f"{self.id}: trees of {language} have no nodes of kind {', '.join(unknown)}")
        return q


def unicode_pattern(pattern: str) -> re.Pattern:
    """Unanchored; Python's classes are Unicode's already."""
    return re.compile(pattern)


def _regex(where: str, pattern: str) -> str:
    try:
        unicode_pattern(pattern)
    except re.error as e:
        raise RuleError(f"{where}: {pattern!r} is no regular expression: {e}") from e
    return pattern


def parse_rule(text: str, source: str = "rule") -> Rule:
    """A rule from the text of a TOML file."""
    try:
        r = tomllib.loads(text)["rule"]
        id_, languages, query = r["id"], tuple(r["languages"]), r["query"]
        category, confidence, description = r["category"], r["confidence"], r["description"]
    except (tomllib.TOMLDecodeError, KeyError, TypeError) as e:
        raise RuleError(f"{source}: {e!r}") from e
    for name, value, known in (("category", category, model.CATEGORIES), ("confidence", confidence, model.CONFIDENCES), *(("language", x, model.LANGUAGES) for x in languages)):
        if value not in known:
            raise RuleError(f"{id_}: unknown {name} {value!r}")
    predicates = []
    for capture, conditions in r.get("predicates", {}).items():
        own = [(k, v) for k, v in conditions.items() if k in KINDS]
        if len(own) != 1 or len(conditions) != 1:
            raise RuleError(f"{id_}: predicate {capture!r} must set exactly one of {', '.join(KINDS)}")
        kind, value = own[0]
        predicates.append((capture, kind, _regex(f"{id_}: {capture}", value) if kind.endswith("match") else value))
    cross = []
    for i, c in enumerate(r.get("cross_predicates", [])):
        captures = tuple(c.get("captures", ()))
        if c.get("kind") not in ("any_match", "all_match"):
            raise RuleError(f"{id_}: cross predicate {i} is neither any_match nor all_match")
        if not captures or len(set(captures)) != len(captures):
            raise RuleError(f"{id_}: cross predicate {i} needs captures, each once")
        cross.append((c["kind"], captures, _regex(f"{id_}: cross predicate {i}", c.get("match", ""))))
    templates: dict[str, str] = {}
    for t in r.get("policy_templates", []):
        templates.setdefault(t["engine"], t["template"])
    for engine in model.ENGINES:  # the older form: one block for each engine
        if old := r.get(f"{engine}_template"):
            templates.setdefault(engine, old["template"])
    tests = tuple(Test(t["input"], t["expect_match"], t.get("language")) for t in r.get("tests", []))
    return Rule(id_, languages, category, confidence, description, query, tuple(predicates), tuple(cross), tuple(templates.items()), tests, r.get("externalized", False), r.get("provenance_capture"))


def load_directory(folder: str | os.PathLike) -> list[Rule]:
    """The rules of a directory's .toml files, DEEPEST levels down, without links, in the order of their paths. None if there is no directory."""
    root = Path(folder)
    if not root.is_dir():
        return []
    found = []
    for at, folders, files in os.walk(root, followlinks=False):
        level = len(Path(at).relative_to(root).parts)
        folders[:] = sorted(d for d in folders if not os.path.islink(os.path.join(at, d))) if level < DEEPEST - 1 else []
        found += [Path(at, f) for f in files if f.endswith(".toml") and not os.path.islink(os.path.join(at, f))]
    return [parse_rule(p.read_text(encoding="utf-8"), str(p)) for p in sorted(found)]


def merge(base: list[Rule], more: list[Rule]) -> list[Rule]:
    """A rule of the same id takes the old one's place; others are added at the end."""
    out = {r.id: r for r in base}
    out.update({r.id: r for r in more})
    return list(out.values())


def load(directories: list[str] = (), rules_dir: str | None = None) -> list[Rule]:
    """Built-in rules, then those of the configured directories, then those of rules_dir."""
    from portcullis.rules import builtin

    rules = builtin()
    for d in [*directories, *([rules_dir] if rules_dir else [])]:
        rules = merge(rules, load_directory(d))
    return rules
