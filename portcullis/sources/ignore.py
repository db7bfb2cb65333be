"""Globs of ignore files and excludes as regular expressions, and the ignore files of a tree."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable
from dataclasses import dataclass
from pathlib import Path


def glob_pattern(glob: str) -> str:
    """An ignore-file pattern as a regular expression over paths relative to the pattern's folder.

    ``/`` at the start or inside anchors it; ``**`` spans folders; a trailing ``/`` means a folder. What matches a folder
    matches all below it."""
    g = glob.rstrip("/")
    anchored = "/" in g
    g = g.removeprefix("/")
    out, i = "", 0
    while i < len(g):
        if g.startswith("**/", i):
            out += "(?:.*/)?"
            i += 3
        elif g.startswith("/**", i) and i + 3 == len(g):
            out += "/.*"
            i += 3
        elif g.startswith("**", i):
            out += ".*"
            i += 2
        elif g[i] == "*":
            out += "[^/]*"
            i += 1
        elif g[i] == "?":
            out += "[^/]"
            i += 1
        elif g[i] == "[" and (end := g.find("]", i + 2)) > 0:
            body = g[i + 1 : end]
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]"
            i = end + 1
        elif g[i] == "\\" and i + 1 < len(g):
            out += re.escape(g[i + 1])
            i += 2
        else:
            out += re.escape(g[i])
            i += 1
    start = "^" if anchored else "(?:^|.*/)"
    tail = "/.*$" if glob.endswith("/") else "(?:/.*)?$"
    return start + out + tail


def exclusion_patterns(globs: list[str]) -> list[str]:
    """Patterns of exclude globs; ones that are no globs are left out."""
    out = []
    for g in globs:
        try:
            p = glob_pattern(g)
            re.compile(p)
        except (re.error, IndexError):
            continue
        out.append(p)
    return out


def _below(glob: str, folders: tuple[str, ...]) -> str | None:
    """What a pattern of an ignore file says within folders below it; None if it says nothing there."""
    if "/" not in glob.rstrip("/"):
        return glob  # holds at any depth
    parts = glob.removeprefix("/").split("/")
    for name in folders:
        if parts[0] == "**":
            return "/".join(parts)
        if len([x for x in parts if x]) < 2 or not re.search(glob_pattern(parts[0]), name):
            return None
        parts = parts[1:]
    return "/" + "/".join(parts)


#: How a pattern ends that stands for a folder or a file and all below it, and one that stands for a folder.
_ANY, _FOLDER = "(?:/.*)?$", "/.*$"


@dataclass(frozen=True)
class Rule:
    """file: what matches a file's path, folder: what matches a folder's own path."""

    file: re.Pattern
    folder: re.Pattern
    keeps: bool


def compiled(rules: Iterable[tuple[str, bool]]) -> tuple[Rule, ...]:
    """Rules (pattern, keeps); ones that are no patterns are left out."""
    out = []
    for pattern, keeps in rules:
        own = pattern.removesuffix(_ANY) if pattern.endswith(_ANY) else pattern.removesuffix(_FOLDER)
        try:
            out.append(Rule(re.compile(pattern), re.compile(own + "$"), keeps))
        except re.error:
            continue
    return tuple(out)


def from_lines(lines: Iterable[str], prefix: str = "", folders: tuple[str, ...] = ()) -> list[tuple[str, bool]]:
    """(pattern, keeps) of an ignore file's lines. prefix: the path of its folder, if it lies in the tree; folders: those from the file's
    folder down to the tree, if it lies above."""
    out = []
    for line in lines:
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        keeps = line.startswith("!")
        glob = _below(line[1:] if keeps else line, folders)
        if glob is not None:
            try:
                p = glob_pattern(glob)
            except IndexError:
                continue
            own = p.removeprefix("^").replace("(?:^|.*/)", "(?:.*/)?", 1) if prefix else p.removeprefix("^")
            out.append((("^" + re.escape(prefix) if prefix or p.startswith("^") else "") + own, keeps))
    return out


def _file(f: Path, **place) -> list[tuple[str, bool]]:
    return from_lines(f.read_text(encoding="utf-8", errors="replace").splitlines(), **place) if f.is_file() else []


def above(root: str | os.PathLike) -> list[tuple[str, bool]]:
    """Of the ignore files that hold for a local tree but lie outside of it, least weight first: the user's own file, the repository's
    exclude file, the .gitignore files of the folders above up to the repository's root."""
    top = Path(root).resolve()
    repository = next((x for x in (top, *top.parents) if (x / ".git").exists()), None)
    if repository is None:
        return []
    folders = top.relative_to(repository).parts
    config = Path(os.environ.get("XDG_CONFIG_HOME") or Path.home() / ".config")
    out = _file(config / "git" / "ignore", folders=folders) + _file(repository / ".git" / "info" / "exclude", folders=folders)
    for x in [x for x in reversed(top.parents) if x == repository or repository in x.parents]:
        out += _file(x / ".gitignore", folders=top.relative_to(x).parts)
    return out


def ignore_rules(root: str | os.PathLike) -> list[tuple[str, bool]]:
    """(pattern, keeps) of all ignore files that hold for a local tree, those of the tree from the outside in; of the patterns that match a
    path the last one counts. It walks the tree on this machine; the reader of trees doesn't need it."""
    top = Path(root).resolve()
    out = above(top)
    for at, folders, _ in os.walk(top):
        folders[:] = sorted(d for d in folders if not d.startswith("."))
        relative = Path(at).relative_to(top).as_posix()
        out += _file(Path(at) / ".gitignore", prefix="" if relative == "." else relative + "/")
    return out
