"""Runs of plain statements, as patterns: what a parser reads from their start to their end, and nothing past it, is told without tokens.

A run begins where a statement of a file may. Its brackets pair off; strings, templates without code and comments are closed.
Where a function closes, every tree within has ended: each ends at any bracket that closes, and nothing passes over a brace. A
statement that ends at a semicolon has besides none of what takes a parser past a bracket, and nothing that an ``else`` may follow."""

from __future__ import annotations

import re
from functools import lru_cache

#: Brackets within brackets; a statement of more isn't plain.
_LEVELS = 4
#: Words, signs and brackets of a statement outside of functions; a longer one isn't plain.
_LONGEST = 200
#: Words that an operand follows. Where none does, a parser at its deepest level would take what stands there.
_PREFIX = "return|throw|case|typeof|await|void|delete|yield|new|not|in|instanceof|as"
_COMMENT = r"//[^\n]*+|/\*(?:[^*]|\*(?!/))*+\*/"
_STRINGS = r"""\"(?:\\.|[^\\"\n])*+"|(?<![\w$])'(?:\\.|[^\\'\n])*+'|`(?:[^`\\$]|\$(?!\{))*+`"""


def _atom(not_words: str, signs: str, not_after: str, between: str = ",;") -> str:
    """A word with its members, a sign, string or comment, and what often stands behind it. not_after: what may not come after a sign
    or a word that an operand follows; between: what parts statements and operands."""
    open_ = rf"\s*+(?!{not_after})"
    word = rf"(?!(?:{_PREFIX}|{not_words})(?![\w$]))[\w$]++(?:\.[\w$]++)*+(?:\+\+|--)?+\s*+(?:[{between}]\s*+|[{signs}]++{open_})?+"
    return rf"{word}|[{signs}]++{open_}|[{between}]\s*+|\s++|(?:{_PREFIX})(?![\w$]){open_}|(?:{_STRINGS})\s*+(?:[{between}]\s*+)?+|/(?= ){open_}|{_COMMENT}"


def _nested(atom: str, closed: str, levels: int = _LEVELS) -> str:
    """The atom, and brackets of any kind around runs of it."""
    out = atom
    for _ in range(levels):
        out = rf"{atom}|[(\[{{](?:{out})*+{closed}"
    return out


def _paired(atom: str, levels: int = _LEVELS) -> str:
    """The atom, and brackets around runs of it, braces closed by braces."""
    out = atom
    for _ in range(levels):
        out = rf"{atom}|\{{(?:{out})*+\}}|[(\[](?:{out})*+[)\]]"
    return out


@lru_cache
def plain_run(language: str) -> re.Pattern | None:
    """Whole statements in a row; None if there is no such pattern of a language."""
    if language not in ("typescript", "javascript"):
        return None
    free = _atom("function", "-+*%=<>!&|^~?:.", r"[)\]}/]") + r"|function(?![\w$])(?=[\s*]*+[\w$]*+\s*+\()"
    function = rf"(?:(?:export|default|async)\s++)*+function\s++[\w$]++\s*+(?:<[\w\s$,]*+>\s*+)?+\((?:{_nested(free, r'[)\]}]')})*+\)\s*+(?::[\w\s$.<>\[\]|&,]*+)?+\{{(?:{_paired(free)})*+\}}"
    # type arguments, types of results and heads of classes may go past a bracket
    others = "function|class|interface|enum|throws|where"
    closed = r"(?:[)\]](?!\s*+[:/])|\})"
    strict = _nested(_atom(others, "-+*%=>!&|^~?:.", r"[)\]};,/]"), closed)
    first = _atom(others + "|if|else|for|while|do|switch|try|catch|finally|default|with", "-+*%=>!&|^~?:.", r"[)\]};,/]", ",")
    simple = rf"(?=[\w$])(?:{first}|[(\[{{](?:{strict})*+{closed}){{1,{_LONGEST}}}+;"
    one = rf"(?>{function}|{simple})"
    return re.compile(rf"{one}(?:(?:\s++|{_COMMENT})*+{one})*+", re.S)
