"""The kinds of nodes that trees of a language can have.

They are read off the parsers themselves: every text that a method of a language's parser, or one it hands on to, has as a constant.
That is more than the kinds, as operators and fields are among them, but a kind that isn't there has no nodes in any tree."""

from __future__ import annotations

from functools import lru_cache
from types import CodeType

from portcullis.syntax.parser import PARSERS, Parser

#: Kinds that are put together from parts.
_MADE = {"go": {"raw_string_literal_content", "interpreted_string_literal_content"}}


def _texts(code: CodeType) -> set[str]:
    out: set[str] = set()
    stack: list[object] = list(code.co_consts)
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.add(x)
        elif isinstance(x, tuple | frozenset):
            stack += x
        elif isinstance(x, CodeType):
            out |= _texts(x)
    return out


@lru_cache
def kinds(language: str) -> frozenset[str]:
    out: set[str] = set(_MADE.get(language, ()))
    classes = [c for c in PARSERS[language].__mro__ if issubclass(c, Parser)]
    names = {n for c in classes for n in vars(c)}
    for name in names:
        for c in classes:
            if name not in vars(c):
                continue
            x = vars(c)[name]
            x = getattr(x, "__func__", x)
            if isinstance(x, str):
                out.add(x)
                break
            if not hasattr(x, "__code__"):
                break
            out |= _texts(x.__code__) | {d for d in x.__defaults__ or () if isinstance(d, str)}
            used = x.__code__.co_names
            if "super" not in used and "Parser" not in used:  # what it replaces isn't reached
                break
    return frozenset(out)
