"""Names that imports of policy modules bind, and assignments as (name, text of the right side), from tokens."""

from __future__ import annotations

from collections.abc import Iterator

from portcullis.functions.paths import POLICY_INDICATORS
from portcullis.syntax.lexer import ID, NEWLINE, NUMBER, OP, RUN, STRING, VARIABLE, Token, token_runs


def is_policy_path(path: str) -> bool:
    low = path.lower()
    return any(x in low for x in POLICY_INDICATORS)


def _inner(text: str, t: Token) -> str:
    return text[t.inner[0] : t.inner[1]]


def _close(ts: list[Token], i: int) -> int:
    """Where the bracket at i closes."""
    depth = 0
    for j in range(i, len(ts)):
        if ts[j].kind == OP:
            depth += (ts[j].text in ("(", "[", "{")) - (ts[j].text in (")", "]", "}"))
            if depth == 0:
                return j
    return len(ts) - 1


def _named(ts: list[Token], mark: str) -> list[str]:
    """a, b as c -> a, c; with mark ':' a: c."""
    out, i = [], 0
    while i < len(ts):
        if ts[i].kind == ID and ts[i].text != "type":
            name = ts[i].text
            if i + 2 < len(ts) and ts[i + 1].text == mark and ts[i + 2].kind == ID:
                name = ts[i + 2].text
                i += 2
            out.append(name)
            while i < len(ts) and ts[i].text != ",":
                i += 1
        i += 1
    return out


def _typescript(text: str, ts: list[Token]) -> set[str]:
    out: set[str] = set()
    for i, t in enumerate(ts):
        if t.text == "import" and t.kind == ID:
            j = i + 1
            names: list[str] = []
            while j < len(ts) and ts[j].kind != STRING and ts[j].text not in (";", "("):
                x = ts[j]
                if x.text == "{":
                    k = _close(ts, j)
                    names += _named(ts[j + 1 : k], "as")
                    j = k
                elif x.text == "*" and j + 2 < len(ts) and ts[j + 1].text == "as":
                    names.append(ts[j + 2].text)
                    j += 2
                elif x.kind == ID and x.text not in ("from", "type"):
                    names.append(x.text)
                elif x.text == "=":
                    break
                j += 1
            if j < len(ts) and ts[j].kind == STRING and is_policy_path(_inner(text, ts[j])):
                out.update(names)
        if t.text == "require" and i + 2 < len(ts) and ts[i + 1].text == "(" and ts[i + 2].kind == STRING and is_policy_path(_inner(text, ts[i + 2])) and i > 1 and ts[i - 1].text == "=":
            if ts[i - 2].kind == ID:
                out.add(ts[i - 2].text)
            elif ts[i - 2].text == "}":
                j = i - 2
                while j >= 0 and ts[j].text != "{":
                    j -= 1
                out.update(_named(ts[j + 1 : i - 2], ":"))
    return out


def _go(text: str, ts: list[Token]) -> set[str]:
    out: set[str] = set()
    for i, t in enumerate(ts):
        if t.text != "import" or t.kind != ID or i + 1 >= len(ts):
            continue
        if ts[i + 1].text == "(":
            specs = ts[i + 2 : _close(ts, i + 1)]
        else:
            end = next((j for j in range(i, len(ts)) if ts[j].kind == NEWLINE), len(ts))
            specs = ts[i + 1 : end]
        for j, s in enumerate(specs):
            if s.kind == STRING and is_policy_path(path := _inner(text, s)):
                before = specs[j - 1] if j and specs[j - 1].kind != NEWLINE and specs[j - 1].end <= s.start else None
                alias = before.text if before is not None and (before.kind == ID or before.text == ".") else None
                if alias not in (".", "_"):
                    out.add(alias or path.rsplit("/", 1)[-1])
    return out


def _python(text: str, ts: list[Token]) -> set[str]:
    out: set[str] = set()
    i = 0
    while i < len(ts):
        t = ts[i]
        first = i == 0 or ts[i - 1].kind == NEWLINE or ts[i - 1].text in (";", ":")
        if t.text == "from" and first:
            j = i + 1
            while j < len(ts) and ts[j].text != "import":
                j += 1
            module = "".join(x.text for x in ts[i + 1 : j])
            k = j + 1
            end = _close(ts, k) if k < len(ts) and ts[k].text == "(" else next((x for x in range(k, len(ts)) if ts[x].kind == NEWLINE or ts[x].text == ";"), len(ts))
            if is_policy_path(module):
                out.update(_named([x for x in ts[k:end] if x.text not in ("(", ")") and x.kind != NEWLINE], "as"))
            i = end
        elif t.text == "import" and first:
            end = next((x for x in range(i, len(ts)) if ts[x].kind == NEWLINE or ts[x].text == ";"), len(ts))
            part: list[Token] = []
            for x in [*ts[i + 1 : end], None]:
                if x is None or x.text == ",":
                    words = [p.text for p in part]
                    if words and is_policy_path("".join(words[: words.index("as")] if "as" in words else words)):
                        out.add(words[-1] if "as" in words else words[0])
                    part = []
                else:
                    part.append(x)
            i = end
        i += 1
    return out


def _java(text: str, ts: list[Token]) -> set[str]:
    out: set[str] = set()
    for i, t in enumerate(ts):
        if t.text == "import" and t.kind == ID:
            j = i + 1
            while j < len(ts) and ts[j].text != ";":
                j += 1
            parts = [x.text for x in ts[i + 1 : j] if x.text != "static"]
            if parts and parts[-1] != "*" and is_policy_path("".join(parts)):
                out.add(parts[-1])
    return out


def _csharp(text: str, ts: list[Token]) -> set[str]:
    out: set[str] = set()
    for i, t in enumerate(ts):
        if t.text == "using" and i + 2 < len(ts) and ts[i + 1].kind == ID and ts[i + 2].text == "=":
            j = i + 3
            while j < len(ts) and ts[j].text != ";":
                j += 1
            if is_policy_path("".join(x.text for x in ts[i + 3 : j])):
                out.add(ts[i + 1].text)
    return out


def _php(text: str, ts: list[Token]) -> set[str]:
    out: set[str] = set()
    for i, t in enumerate(ts):
        if t.text != "use" or i and ts[i - 1].text == ")":
            continue
        j = i + 1
        while j < len(ts) and ts[j].text not in (";", "("):
            j += 1
        run = [x for x in ts[i + 1 : j] if x.text not in ("function", "const")]
        prefix = ""
        if any(x.text == "{" for x in run):
            k = next(k for k, x in enumerate(run) if x.text == "{")
            prefix = "".join(x.text for x in run[:k])
            run = [x for x in run[k + 1 :] if x.text != "}"]
        part: list[str] = []
        for x in [*run, None]:
            if x is None or x.text == ",":
                path = "".join(part[: part.index("as")] if "as" in part else part)
                if part and is_policy_path(prefix + path):
                    out.add(part[-1])
                part = []
            else:
                part.append(x.text)
    return out


_IMPORTS = {"typescript": _typescript, "javascript": _typescript, "go": _go, "python": _python, "java": _java, "csharp": _csharp, "php": _php}


#: Languages in which a block that closes ends what stands before it, and the words of their imports, which end at a semicolon.
_BLOCKS = {"java": "import", "csharp": "using", "php": "use"}


def closed_runs(text: str, language: str, most: int = RUN) -> Iterator[list[Token]]:
    """The tokens in runs of ``most`` and more, which end where no import or assignment goes on: outside of brackets, at a semicolon, at
    a block that isn't part of either, or at the end of a line, where lines count, whose last token is a value. (Only what a brace that closes nothing belongs to is sought in its run.)"""
    out: list[Token] = []
    depth, module = 0, False  # module: behind a from of Python whose import is still to come
    word, named, assigned = _BLOCKS.get(language), False, False  # named: in an import, assigned: in an assignment outside of brackets
    for run in token_runs(text, language, most):
        for t in run:
            last = out[-1] if out else None
            out.append(t)
            if t.kind == OP:
                if t.text in ("(", "[", "{"):
                    depth += 1
                elif t.text in (")", "]", "}"):
                    depth = max(0, depth - 1)
                elif t.text == ";":
                    named, assigned = False, assigned and depth > 0
                elif t.text == "=" and not depth:
                    assigned = True
            elif t.kind == ID and t.text == word:
                named = True
            elif t.kind == ID and language == "python" and t.text in ("from", "import"):
                module = t.text == "from" and (last is None or last.kind == NEWLINE or last.text in (";", ":"))
            if len(out) < most or depth or module:
                continue
            if (t.text == ";" or word and t.text == "}" and not named and not assigned) if language not in _LINES else t.kind == NEWLINE and last is not None and (last.kind in (ID, NUMBER, STRING) or last.text in (")", "]", "}")):
                yield out
                out = []
    if out:
        yield out


def policy_imports(text: str, language: str, given: list[Token] | None = None) -> set[str]:
    """Names bound by imports of policy modules; Kotlin and Ruby have none."""
    if language not in _IMPORTS or not is_policy_path(text):
        return set()  # no import can name a policy module
    return {name for ts in (closed_runs(text, language) if given is None else [given]) for name in _IMPORTS[language](text, ts)}


_LINES = {"go", "python", "kotlin", "ruby"}
_KEYWORDS = {"const", "let", "var", "val", "static", "final", "private", "public", "protected", "readonly", "return", "export", "if", "for", "while", "case", "else", "new", "await", "type", "import", "using", "internal"}


def _parts(ts: list[Token]) -> list[list[Token]]:
    """Split at commas outside brackets."""
    out: list[list[Token]] = [[]]
    depth = 0
    for t in ts:
        if t.kind == OP:
            depth += (t.text in ("(", "[", "{")) - (t.text in (")", "]", "}"))
            if t.text == "," and depth == 0:
                out.append([])
                continue
        out[-1].append(t)
    return [p for p in out if p]


def _names(part: list[Token]) -> list[str]:
    """What a left side binds: the last name of a path, or the names of a pattern in brackets."""
    cut = next((i for i, t in enumerate(part) if t.text == ":" and part[0].text not in ("{", "[")), len(part))
    part = part[:cut]
    if part and part[0].text in ("{", "[", "("):
        return [t.text for t in part if t.kind == ID]
    named = [t.text.lstrip("$@") for t in part if t.kind in (ID, VARIABLE) and t.text not in _KEYWORDS]
    return named[-1:]


def _run(ts: list[Token], i: int, language: str, stop: tuple[str, ...]) -> int:
    """The end of the expression that starts at i."""
    depth = 0
    for j in range(i, len(ts)):
        t = ts[j]
        if t.kind == NEWLINE and depth == 0 and language in _LINES and j > i:
            return j
        if t.kind == OP:
            if t.text in (")", "]", "}") and depth == 0 or depth == 0 and t.text in stop:
                return j
            depth += (t.text in ("(", "[", "{")) - (t.text in (")", "]", "}"))
    return len(ts)


def assignments(text: str, language: str, given: list[Token] | None = None) -> list[tuple[str, str]]:
    """(name, right side): declarations, assignments, keyed values; in C# and PHP also names with their declared types."""
    return list(dict.fromkeys(x for part in assignment_parts(text, language, given) for x in part))


def assignment_parts(text: str, language: str, given: list[Token] | None = None) -> Iterator[list[tuple[str, str]]]:
    """assignments() of one run of tokens after the other."""
    if language in _IMPORTS:
        for ts in closed_runs(text, language) if given is None else [given]:
            yield _assignments(text, language, ts)


def _assignments(text: str, language: str, ts: list[Token]) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    span = lambda a, b: text[ts[a].start : ts[b - 1].end] if b > a else ""
    for i, t in enumerate(ts):
        if t.kind != OP:
            continue
        if t.text in ("=", ":="):
            pair = language in ("go", "python")  # sides may be lists
            depth, a = 0, i
            while a > 0:
                x = ts[a - 1]
                if x.kind == NEWLINE or x.kind == OP and (x.text in (";", "=>") or x.text == "," and not pair and depth == 0):
                    break
                if x.kind == OP and x.text in (")", "]", "}"):
                    if depth == 0 and x.text == "}" and language in ("java", "csharp", "php"):
                        break
                    depth += 1
                elif x.kind == OP and x.text in ("(", "[", "{"):
                    if depth == 0:
                        break
                    depth -= 1
                a -= 1
            end = _run(ts, i + 1, language, (";",) if pair and (a == 0 or ts[a - 1].text != "(") else (";", ","))
            left, right = _parts(ts[a:i]), _parts(ts[i + 1 : end])
            if len(left) == len(right) and len(left) > 1:
                out += [(n, text[r[0].start : r[-1].end]) for p, r in zip(left, right, strict=True) for n in _names(p)]
            else:
                out += [(n, span(i + 1, end)) for p in left for n in _names(p)]
        elif t.text == ":" and i and ts[i - 1].kind == ID and language in ("typescript", "javascript", "go"):
            end = _run(ts, i + 1, language, (";", ",", "="))
            if end > i + 1 and (end >= len(ts) or ts[end].text != "="):
                out.append((ts[i - 1].text, span(i + 1, end)))
        elif language == "csharp" and t.text in (";", ",", ")") and i > 1 and ts[i - 1].kind == ID and ts[i - 2].kind == ID and ts[i - 2].text not in _KEYWORDS:
            out.append((ts[i - 1].text, ts[i - 2].text))
    if language == "php":
        out += [(v.text.lstrip("$"), k.text) for k, v in zip(ts, ts[1:], strict=False) if k.kind == ID and v.kind == VARIABLE and k.text not in _KEYWORDS]
    return [(n, r) for n, r in dict.fromkeys(out) if n and r and n != r]
