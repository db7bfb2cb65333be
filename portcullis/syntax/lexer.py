"""Tokens of source text. Nothing is an error: a character that fits nowhere is an operator of its own.

Code inside of strings (interpolation) is read as tokens too, and kept with the string's token; so are the bodies of
here-documents, which stand on the lines after their openers. Of PHP files, only what is inside of PHP tags is read."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

#: Token kinds.
ID, NUMBER, STRING, OP, NEWLINE, VARIABLE, SYMBOL = "id", "number", "string", "op", "newline", "variable", "symbol"

#: Code in strings is read this many levels deep; deeper, a string is text only.
DEEPEST_STRING = 30
#: Places in one text where a string or code in it may fail to close before code in all further ones is text only; keeps broken texts linear.
MOST_UNCLOSED = 64
#: Tokens that are held at once of a text that is read in runs.
RUN = 20_000


class Token:
    __slots__ = ("kind", "text", "start", "end", "inner", "mark", "parts")

    def __init__(self, kind: str, text: str, start: int, end: int, inner: tuple[int, int] = (0, 0), mark: str = "", parts: list[tuple[int, int, list[Token]]] | None = None) -> None:
        self.kind, self.text, self.start, self.end = kind, text, start, end
        #: of strings: where the content starts and ends, and which delimiter it has
        self.inner, self.mark = inner, mark
        #: of strings with code inside: start, end and tokens of each piece
        self.parts = parts


@dataclass(frozen=True)
class Lexicon:
    line_comments: tuple[str, ...] = ("//",)
    block_comments: tuple[tuple[str, str], ...] = (("/*", "*/"),)
    #: opening delimiter -> (closing delimiter, backslash escapes); longest first
    strings: tuple[tuple[str, str, bool], ...] = (('"', '"', True), ("'", "'", True))
    newlines: bool = False
    identifier: str = r"[^\W\d]\w*"
    extra: str = ""  # patterns of its own, with the token kind or the name of their reader as group
    regexes: bool = False
    #: a pattern of what begins code in a string, by the string's opening delimiter
    holes: tuple[tuple[str, str], ...] = ()


_PHP_HOLE = r"\{(?=\$)|\$\{|\$[^\W\d]\w*"
_KOTLIN_HOLE = r"\$\{|\$[^\W\d]\w*"
LEXICONS = {
    "typescript": Lexicon(strings=(('"', '"', True), ("'", "'", True), ("`", "`", True)), identifier=r"[#$\w][$\w]*", regexes=True, holes=(("`", r"\$\{"),)),
    "java": Lexicon(strings=(('"""', '"""', True), ('"', '"', True), ("'", "'", True))),
    "csharp": Lexicon(
        strings=(('$"""', '"""', False), ('$@"', '"', False), ('@$"', '"', False), ('@"', '"', False), ('$"', '"', True), ('"""', '"""', False), ('"', '"', True), ("'", "'", True)), identifier=r"@?[^\W\d]\w*",
        holes=(('$"""', r"\{"), ('$@"', r"\{"), ('@$"', r"\{"), ('$"', r"\{")),
    ),
    "go": Lexicon(strings=(("`", "`", False), ('"', '"', True), ("'", "'", True)), newlines=True),
    "kotlin": Lexicon(strings=(('"""', '"""', False), ('"', '"', True), ("'", "'", True)), newlines=True, holes=(('"""', _KOTLIN_HOLE), ('"', _KOTLIN_HOLE))),
    "php": Lexicon(
        line_comments=("//", "#"), identifier=r"[^\W\d]\w*", holes=(('"', _PHP_HOLE), ("<<<", _PHP_HOLE)),
        extra=r"(?P<variable>\$+[^\W\d]\w*)|(?P<closing>\?>)|(?P<heredoc><<<[ \t]*(?:\"\w+\"|'\w+'|[^\W\d]\w*)\r?\n)",
    ),
    "python": Lexicon(line_comments=("#",), block_comments=(), newlines=True, strings=(('"""', '"""', True), ("'''", "'''", True), ('"', '"', True), ("'", "'", True)), holes=tuple((q, r"\{") for q in ('"""', "'''", '"', "'"))),
    "ruby": Lexicon(
        line_comments=("#",), block_comments=(("\n=begin", "\n=end"),), newlines=True, strings=(('"', '"', True), ("'", "'", True), ("`", "`", True)), identifier=r"[^\W\d]\w*(?:[?!](?![=~]))?",
        extra=(
            r"(?P<variable>@@?[^\W\d]\w*|\$\w+)|(?P<symbol>(?<![:\w]):(?:[^\W\d]\w*[?!=]?(?![=>])|\"[^\"\n]*\"|[-+*/<>=!~^&|%\[\]]+))"
            r"|(?P<heredoc><<[~-]?(?:\"[^\"\n]+\"|'[^'\n]+'|`[^`\n]+`|[^\W\d]\w*))|(?P<percent>%(?:[wWiIqQrxs](?=[^\w\s])|(?=[(\[{|!])))"
        ),
        regexes=True, holes=tuple((q, r"#\{") for q in ('"', "`", "/", "<<", "%")),
    ),
}
LEXICONS["javascript"] = LEXICONS["typescript"]

_OPS = sorted(
    "=== !== == != <= >= && || ?? ?. ?: ?-> => -> :: := <- ++ -- += -= *= /= %= ??= ||= &&= |= &= ^= **= ** << >> ... .. =~ !~ <=> !! <<= >>=".split(), key=len, reverse=True,
)
#: What may stand before a regular expression or a literal: else a slash divides.
_BEFORE_REGEX = set("return if elsif unless when while until and or not then else case in typeof do puts".split())
_BRACKETS = {"(": ")", "[": "]", "{": "}", "<": ">"}
_OPEN_TAG = re.compile(r"<\?(?:php\b|=|(?=\s))", re.I)


def _string(language: str, opened: str, closed: str, escapes: bool) -> str:
    o, c = re.escape(opened), re.escape(closed)
    if len(closed) > 1:
        body = rf"(?:\\.|(?!{c}).)*" if escapes else f"(?:(?!{c}).)*"
    elif escapes:
        body = rf"(?:\\.|[^\\{c}{chr(92) + 'n' if _one_line(language, closed) else ''}])*"
    else:
        body = '(?:""|[^"])*' if closed == '"' else f"[^{c}]*"
    return f"{o}{body}(?:{c})?"


def _one_line(language: str, closed: str) -> bool:
    """A string that isn't closed on its line ends there."""
    return closed in "\"'" and language not in ("php", "ruby")


@lru_cache
def _master(language: str) -> tuple[re.Pattern, dict[str, tuple[str, str, bool]]]:
    """One pattern for all tokens; of strings, the delimiters by the name of their group."""
    x = LEXICONS[language]
    parts, marks = [r"(?P<space>[^\S\n]+|\\\n)"], {}
    if language == "ruby":
        parts.append(r"(?P<blockend>\n__END__\r?(?:\n.*|\Z))")
    for s, e in x.block_comments:
        if s[0] == "\n":
            parts.append(f"(?P<block{len(parts)}>{re.escape(s)}.*?(?:{re.escape(e)}|\\Z))")
    parts.append(r"(?P<newline>\n)")
    for s in x.line_comments:
        rest = r"(?:(?!\?>)[^\n])*" if language == "php" else r"[^\n]*"
        parts.append(f"(?P<line{len(parts)}>{re.escape(s)}{'(?!' + re.escape('[') + ')' if language == 'php' and s == '#' else ''}{rest})")
    for s, e in x.block_comments:
        if s[0] != "\n":
            parts.append(f"(?P<block{len(parts)}>{re.escape(s)}.*?(?:{re.escape(e)}|\\Z))")
    if x.extra:
        parts.append(x.extra)
    prefix = "[rRbBuUfF]{0,2}" if language == "python" else ""
    for i, (opened, closed, escapes) in enumerate(x.strings):
        marks[f"string{i}"] = (opened, closed, escapes)
        parts.append(f"(?P<string{i}>{prefix}{_string(language, opened, closed, escapes)})")
    parts += [r"(?P<number>0[xX]\w+|\d(?:[eE][+-]\d|\w|\.\d)*)", f"(?P<id>{x.identifier})"]  # no name begins with a digit
    if x.regexes:
        parts.append(r"(?P<regex>/(?![*/ ])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*)")
    parts.append("(?P<op>" + "|".join(re.escape(o) for o in _OPS) + "|.)")
    return re.compile("|".join(parts), re.S), marks


@lru_cache
def _stops(hole: str, closed: str, escapes: bool, one_line: bool, opened: str = "") -> re.Pattern:
    """What is to be looked at inside of a string: group open, close, hole, or anything else that is passed over."""
    parts = [r"\\."] if escapes else []
    if not escapes and closed == '"':
        parts.append('""')
    if opened:
        parts.append(f"(?P<open>{re.escape(opened)})")
    if closed:
        parts.append(f"(?P<close>{re.escape(closed)}{chr(124) + chr(92) + 'n' if one_line else ''})")
    if hole:
        parts += [r"\{\{"] if hole == r"\{" else []
        parts.append(f"(?P<hole>{hole})")
    return re.compile("|".join(parts), re.S)


def tokens(text: str, language: str) -> list[Token]:
    return _Lexer(text, language).all()


def token_runs(text: str, language: str, most: int = RUN, after: Token | None = None, first: int | None = None) -> Iterator[list[Token]]:
    """tokens() in runs of some ``most``; bodies of here-documents are read by the end of a run. after: the token to go on behind.
    first: of how many tokens the first run is; each is of twice as many as the one before, up to ``most``."""
    lexer = _Lexer(text, language)
    i, last = (lexer.begin(), []) if after is None else (after.end, [after])
    size = most if first is None else min(first, most)
    while i < len(text):
        out, i = lexer.read(i, "", last, size + len(last))
        if len(out) > len(last):
            yield out[len(last) :]
        last = out[-1:]
        size = min(most, 2 * size)


class _Lexer:
    def __init__(self, text: str, language: str) -> None:
        self.text, self.language = text, language
        self.pattern, self.marks = _master(language)
        self.lexicon = LEXICONS[language]
        self.holes = dict(self.lexicon.holes)
        self.waiting: list[tuple[Token, str, bool, bool]] = []  # here-documents whose bodies begin on the next line
        self.no_end: set[str] = set()
        self.unclosed = 0
        self.depth = 0

    def all(self) -> list[Token]:
        return self.read(self.begin(), "")[0]

    def begin(self) -> int:
        """Where the first token may stand."""
        if self.language == "php":
            return self.tag(0)
        if self.language == "ruby" and self.text.startswith("=begin"):
            at = self.text.find("\n=end")
            return len(self.text) if at < 0 else at + 5
        return 0

    def tag(self, i: int) -> int:
        """Past the next tag that opens PHP."""
        m = _OPEN_TAG.search(self.text, i)
        return m.end() if m else len(self.text)

    def read(self, i: int, until: str, last: list[Token] = (), most: int = sys.maxsize) -> tuple[list[Token], int]:
        """Tokens from i on, and where they end: at the end of the text, or at the bracket that closes code in a string.

        until: the operators outside of brackets at which the code ends; the end is -1 if there is none. last: the token before i, if there
        is one, which is given back as the first; most: how many are enough."""
        text, language, match, marks = self.text, self.language, self.pattern.match, self.marks
        newlines, holes = self.lexicon.newlines, self.holes
        out: list[Token] = [*last]
        put = out.append
        n, level = len(text), 0
        while i < n and (len(out) < most or self.waiting):
            m = match(text, i)
            kind, end = m.lastgroup, m.end()
            if kind == "space":
                pass
            elif kind == "id":
                put(Token(ID, m[0], i, end))
            elif kind == "op":
                x = m[0]
                if until:
                    if level == 0 and x in until.split(" ") and not (x == "!" and not (text[end : end + 1] in "rsa" and text[end + 1 : end + 2] in ":}")):
                        return out, i
                    level += (x in "([{") - (x in ")]}")
                put(Token(OP, x, i, end))
            elif kind == "newline":
                if newlines:
                    put(Token(NEWLINE, "\n", i, end))
                    if self.waiting:
                        end = self.bodies(end)
            elif kind in marks:
                opened, closed, escapes = marks[kind]
                last = out[-1] if out else None
                if opened == "'" and last is not None and last.kind == ID and last.end == i and language in ("typescript", "javascript") and last.text not in _BEFORE_REGEX:
                    end = i + 1  # as in don't, inside of markup
                    put(Token(OP, "'", i, end))
                else:
                    put(self.string(m, i, opened, closed, escapes, holes))
                    end = out[-1].end
            elif kind[:4] in ("line", "bloc"):
                pass
            elif kind == "number":
                put(Token(NUMBER, m[0], i, end))
            elif kind == "regex":
                put(self.slash(m, i, out[-1] if out else None))
                end = out[-1].end
            elif kind == "closing":
                end = self.tag(end)
                put(Token(OP, ";", i, i + 2))
            elif kind == "heredoc":
                t = self.php_heredoc(m, i) if language == "php" else self.ruby_heredoc(m, i, out[-1] if out else None)
                if t is None:
                    t = Token(OP, "<<", i, i + 2)
                put(t)
                end = t.end
            elif kind == "percent":
                t = self.percent(m, i, out[-1] if out else None) or Token(OP, "%", i, i + 1)
                put(t)
                end = t.end
            else:
                put(Token(kind, m[0], i, end))
            i = end
        return out, -1 if until else i

    # strings

    def string(self, m: re.Match, i: int, opened: str, closed: str, escapes: bool, holes: dict[str, str]) -> Token:
        text, end = self.text, m.end()
        a = text.index(opened, i) + len(opened)
        hole = holes.get(opened)
        if hole is not None and self.language == "python" and "f" not in text[i : a - len(opened)].lower():
            hole = None
        if hole is not None and re.compile(hole).search(text, a, end):
            found = self.scan(a, _stops(hole, closed, escapes, _one_line(self.language, closed) and len(closed) == 1 and escapes), closed)
            if found is not None:
                inner, end, parts = found
                return Token(STRING, text[i:end], i, end, (a, inner), opened, parts)
        whole = m[0].endswith(closed) and end - len(closed) >= a
        return Token(STRING, m[0], i, end, (a, end - len(closed) if whole else end), opened)

    def scan(self, i: int, stops: re.Pattern, closed: str, limit: int | None = None) -> tuple[int, int, list[tuple[int, int, list[Token]]]] | None:
        """From i to the close: where the content and the string end, and the code in it. None if it or code in it doesn't close."""
        text, level, parts = self.text, 0, []
        limit = len(text) if limit is None else limit
        while (m := stops.search(text, i, limit)) is not None:
            kind, i = m.lastgroup, m.end()
            if kind == "open":
                level += 1
            elif kind == "close":
                if level == 0:
                    return m.start(), i if m[0] == closed else m.start(), parts
                level -= 1
            elif kind == "hole":
                part = self.hole(m)
                if part is None or part[1] > limit:
                    return None
                parts.append(part)
                i = part[1]
        return (limit, limit, parts) if not closed else None

    def hole(self, m: re.Match) -> tuple[int, int, list[Token]] | None:
        """The code that begins here: start, end, tokens."""
        text, start, i = self.text, m.start(), m.end()
        if m[0][-1].isalnum() or m[0][-1] == "_":  # a plain name
            if self.language == "kotlin":
                return start, i, [Token(ID, m[0][1:], start + 1, i)]
            out = [Token(VARIABLE, m[0], start, i)]
            if more := re.compile(r"(\??->)([^\W\d]\w*)").match(text, i):
                out += [Token(OP, more[1], i, more.end(1)), Token(ID, more[2], more.start(2), more.end())]
                i = more.end()
            return start, i, out
        if self.depth >= DEEPEST_STRING or self.unclosed >= MOST_UNCLOSED:
            return None
        until = {"python": "} : := :: !", "csharp": "} : ,"}.get(self.language, "}")
        waiting, self.waiting = self.waiting, []
        self.depth += 1
        toks, end = self.read(i, until)
        self.depth -= 1
        self.waiting = waiting
        if end >= 0 and text[end] != "}":  # how it is to be printed
            depth = 0
            for x in re.compile(r"[{}\n]").finditer(text, end):
                if x[0] == "}" and depth == 0:
                    end = x.start()
                    break
                depth += (x[0] == "{") - (x[0] == "}")
                if x[0] == "\n":
                    end = -1
                    break
            else:
                end = -1
        if end < 0:
            self.unclosed += 1
            return None
        return start, end + 1, toks

    def slash(self, m: re.Match, i: int, last: Token | None) -> Token:
        """A regular expression, or a division."""
        text = self.text
        closes = last is not None and last.text == "<" and last.end == i  # </name> of markup in code
        begins = last is None or last.kind in (OP, NEWLINE) and last.text not in (")", "]", "}") or last.text in _BEFORE_REGEX
        if not begins and self.language == "ruby" and last.kind == ID and last.end < i and not text[i + 1].isspace() and text[i + 1] != "=":
            begins = True  # an argument without parentheses
        if closes or not begins:
            return Token(OP, text[i : i + 2] if text.startswith("/=", i) else "/", i, i + (2 if text.startswith("/=", i) else 1))
        parts = None
        if "/" in self.holes and "#{" in m[0] and (found := self.scan(i + 1, _stops(self.holes["/"], "/", True, True), "/")) is not None and found[1] > found[0]:
            inner, end, parts = found
            return Token(STRING, text[i:end], i, end, (i + 1, inner), "/", parts)
        return Token(STRING, m[0], i, m.end(), (i + 1, m.end() - 1), "/", parts)

    def php_heredoc(self, m: re.Match, i: int) -> Token | None:
        text, name = self.text, m[0][3:].strip()
        raw = name[0] == "'"
        last = None if name in self.no_end else re.compile(rf"^[ \t]*{re.escape(name.strip(chr(34) + chr(39)))}\b", re.M).search(text, m.end())
        if last is None:
            self.no_end.add(name)
            return None
        found = None if raw else self.scan(m.end(), _stops(_PHP_HOLE, "", True, False), "", last.start())
        return Token(STRING, text[i : last.end()], i, last.end(), (m.end(), last.start()), "<<<'" if raw else "<<<", found[2] if found else None)

    def ruby_heredoc(self, m: re.Match, i: int, last: Token | None) -> Token | None:
        """The opener; its body is read when its line ends."""
        text = self.text
        loose = text[i + 2] in "~-"
        name = text[i + 3 if loose else i + 2 : m.end()]
        raw, bare = name[0] == "'", name.strip("\"'`")
        if not loose and (not (name[0] in "\"'`" or name[0].isupper()) or last is not None and (last.kind == NUMBER or last.end == i and last.kind != OP or last.text in (")", "]", "}", "class"))):
            return None
        key = f"{loose}{bare}"
        if key in self.no_end or self.ending(bare, loose).search(text, m.end()) is None:
            self.no_end.add(key)
            return None
        t = Token(STRING, m[0], i, m.end(), (m.end(), m.end()), "<<")
        self.waiting.append((t, bare, loose, raw))
        return t

    @staticmethod
    def ending(name: str, loose: bool) -> re.Pattern:
        return re.compile(rf"^{'[ ' + chr(92) + 't]*' if loose else ''}{re.escape(name)}\r?$", re.M)

    def bodies(self, i: int) -> int:
        """The here-documents whose openers stand on the line before i; where the code goes on."""
        waiting, self.waiting = self.waiting, []
        for t, name, loose, raw in waiting:
            last = self.ending(name, loose).search(self.text, i)
            if last is None:
                continue
            t.inner = (i, max(i, last.start()))
            found = None if raw else self.scan(i, _stops(self.holes["<<"], "", True, False), "", last.start())
            t.parts = found[2] if found else None
            i = last.end() + 1 if last.end() < len(self.text) else last.end()
        return i

    def percent(self, m: re.Match, i: int, last: Token | None) -> Token | None:
        """%w(a b), %q(..), %(..): text with delimiters of one's choice; else a remainder."""
        text, at = self.text, m.end()
        opened = text[at]
        if self.unclosed >= MOST_UNCLOSED:
            return None
        value = last is not None and (last.kind in (NUMBER, STRING, VARIABLE, SYMBOL) or last.text in (")", "]", "}") or last.kind == ID and last.text not in _BEFORE_REGEX)
        if value and not (len(m[0]) > 1 and last.kind == ID and last.end < i and opened in _BRACKETS):
            return None
        closed = _BRACKETS.get(opened, opened)
        kind = m[0][1:] or "Q"
        hole = self.holes["%"] if kind in "WIQrx" else ""
        found = self.scan(at + 1, _stops(hole, closed, True, False, opened if closed != opened else ""), closed)
        if found is None:
            self.unclosed += 1
            return None
        inner, end, parts = found
        return Token(STRING, text[i:end], i, end, (at + 1, inner), "%" + kind.lower(), parts or None)
