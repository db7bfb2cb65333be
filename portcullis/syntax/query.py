"""Pattern queries in the S-expression form of tree queries.

``(kind field: (child) @capture "token" (_) [a b] !field . (x)?)``. Children match in order, other children may stand
between; ``.`` forbids named ones there. Each distinct way to bind the captures is a match.

``((a) . (b))`` are children of one node in a row, at the top of a query those of any node. ``(x)+`` is a run: as many as there are from
its first place on, fewer only where what follows needs it; a capture in it is its last node, as is one given twice."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from dataclasses import field as made

from portcullis.syntax.tree import Node

_TOKEN = re.compile(r';[^\n]*|"(?:\\.|[^"\\])*"|[()\[\]]|@[\w.\-]+|![\w]+|[\w.\-]+:|[?*+](?=[\s)\]@]|$)|#[\w\-?!]+|\.(?=\s|\()|[\w\-]+|\S')


class QueryError(ValueError):
    pass


@dataclass
class Pattern:
    kind: str | None = None  # None: any named node; "" with choices
    literal: bool = False
    any_node: bool = False
    choices: list[Pattern] = made(default_factory=list)
    children: list[Pattern | str] = made(default_factory=list)  # "." is an anchor
    absent: list[str] = made(default_factory=list)
    field: str | None = None
    captures: list[str] = made(default_factory=list)
    group: list[Pattern | str] = made(default_factory=list)  # several children in a row
    optional: bool = False
    repeat: bool = False
    heads: frozenset[str] | None = None  # kinds of the nodes that it can match; None: any


Bindings = tuple[tuple[str, Node], ...]


class Query:
    def __init__(self, source: str) -> None:
        self._words = [w for w in _TOKEN.findall(source) if not w.startswith(";")]
        self._at = 0
        self.patterns: list[Pattern] = []
        while self._at < len(self._words):
            p = self._pattern()
            self.patterns.append(Pattern(group=[p]) if p.repeat and not p.group else p)
        if not self.patterns:
            raise QueryError("an empty query")
        for p in self.patterns:
            _set_heads(p)
        parts = [p.heads for p in self.patterns]
        self.roots = None if None in parts else frozenset().union(*parts)
        #: kinds of named nodes that the query names
        self.kinds: set[str] = set()
        self.capture_names = set()
        for p in self.patterns:
            self._names(p)

    def _names(self, p: Pattern) -> None:
        self.capture_names.update(p.captures)
        if p.kind and not p.literal:
            self.kinds.add(p.kind)
        for q in _inner(p):
            self._names(q)

    def _next(self) -> str:
        if self._at >= len(self._words):
            raise QueryError("the query ends too early")
        self._at += 1
        return self._words[self._at - 1]

    def _peek(self) -> str:
        return self._words[self._at] if self._at < len(self._words) else ""

    def _pattern(self) -> Pattern:
        w = self._next()
        if w.endswith(":") and len(w) > 1:
            p = self._pattern()
            if p.group:
                raise QueryError("a group of several patterns has no field")
            p.field = w[:-1]
            return p
        if w == "(":
            p = Pattern()
            if self._peek() in ("(", "[") or self._peek().startswith('"'):
                p = self._group()
            else:
                kind = self._next()
                if kind.startswith("#"):
                    raise QueryError("predicates stand outside of queries")
                p.kind = None if kind == "_" else kind
                while self._peek() != ")":
                    if self._peek() == ".":
                        p.children.append(self._next())
                    elif self._peek().startswith("!"):
                        p.absent.append(self._next()[1:])
                    elif self._peek().startswith("#"):
                        raise QueryError("predicates stand outside of queries")
                    else:
                        p.children.append(self._pattern())
                self._next()
        elif w == "[":
            p = Pattern(kind="")
            while self._peek() != "]":
                p.choices.append(self._pattern())
                if p.choices[-1].group or p.choices[-1].repeat:
                    raise QueryError("alternatives are single nodes")
            self._next()
        elif w.startswith('"'):
            p = Pattern(kind=w[1:-1].replace('\\"', '"').replace("\\\\", "\\"), literal=True)
        elif w == "_":
            p = Pattern(any_node=True)
        else:
            raise QueryError(f"unexpected {w!r} in a query")
        while True:
            if self._peek() in ("?", "*", "+"):
                quantifier = self._next()
                if quantifier == "*":
                    raise QueryError("the quantifier * is not supported; ((x)+)? is the same")
                p.optional |= quantifier == "?"
                p.repeat |= quantifier == "+"
            elif self._peek().startswith("@"):
                if p.group:
                    raise QueryError("a group of several patterns has no captures of its own")
                p.captures.append(self._next()[1:])
            else:
                return p

    def _group(self) -> Pattern:
        """What is in parentheses up to their end; a group of one is the pattern itself."""
        parts: list[Pattern | str] = []
        while self._peek() != ")":
            parts.append(self._next() if self._peek() == "." else self._pattern())
        self._next()
        if "." in (parts[0], parts[-1]):
            raise QueryError("a group doesn't begin or end with an anchor")
        return parts[0] if len(parts) == 1 else Pattern(group=parts)

    def matches(self, tree: Node | Index, may: Callable[[Node], bool] | None = None) -> Iterator[dict[str, Node]]:
        """All distinct matches, by the place of the matched node in the tree. may: which nodes can be matched at all."""
        index = tree if isinstance(tree, Index) else Index(tree)
        for node in index.of(self.roots):
            if may is not None and not may(node):
                continue
            for p in self.patterns:
                seen = set()
                for b in _match(p, node):
                    key = tuple((name, n.start, n.end, n.kind) for name, n in b)
                    if key not in seen:
                        seen.add(key)
                        yield dict(b)  # of equal names the last wins


class Index:
    """The nodes of a tree by kind, so a query looks only at nodes that its patterns can begin with."""

    def __init__(self, root: Node) -> None:
        self.root = root
        self.by_kind: dict[str, list[tuple[int, Node]]] = {}
        by_kind, stack, i = self.by_kind, [root], 0
        while stack:
            node = stack.pop()
            if (found := by_kind.get(node.kind)) is None:
                found = by_kind[node.kind] = []
            found.append((i, node))
            i += 1
            if node.children:
                stack += [c for _, c in node.children[::-1]]

    def of(self, kinds: frozenset[str] | None) -> list[Node]:
        if kinds is None:
            return list(self.root.walk())
        found = [x for k in kinds for x in self.by_kind.get(k, ())]
        if len(kinds) > 1:
            found.sort(key=lambda x: x[0])
        return [n for _, n in found]


def _inner(p: Pattern) -> list[Pattern]:
    return [*p.choices, *(c for c in (*p.children, *p.group) if c != ".")]


def _roots(p: Pattern) -> frozenset[str] | None:
    """The kinds of nodes that p can match; None: any."""
    if p.choices:
        parts = [_roots(q) for q in p.choices]
        return None if None in parts else frozenset().union(*parts)
    return None if p.any_node or p.kind is None else frozenset([p.kind])


def _set_heads(p: Pattern) -> None:
    p.heads = _roots(p)
    for q in _inner(p):
        _set_heads(q)


def _match(p: Pattern, node: Node) -> Iterator[Bindings]:
    if p.choices:
        inner: Iterator[Bindings] = (b for q in p.choices if q.heads is None or node.kind in q.heads for b in _match(q, node))
    elif p.group:  # at the top of a query
        inner = _children([p], 0, node.children, 0, False)
    elif p.any_node:
        inner = iter([()])
    elif p.literal:
        inner = iter([()] if not node.named and node.kind == p.kind else [])
    elif not node.named or (p.kind is not None and node.kind != p.kind) or any(f in p.absent for f, _ in node.children):
        return
    elif p.children:
        inner = _children(p.children, 0, node.children, 0, False)
    else:
        inner = iter([()])
    own = tuple((c, node) for c in p.captures)
    for b in inner:
        yield own + b


def _children(patterns: list, i: int, children: list[tuple[str | None, Node]], at: int, anchored: bool) -> Iterator[Bindings]:
    """Matches of patterns[i:] among children[at:]; anchored: no named child may be passed over."""
    if i == len(patterns):
        yield ()
        return
    p = patterns[i]
    if p == ".":
        if i == len(patterns) - 1:
            if not any(c.named for _, c in children[at:]):
                yield ()
            return
        yield from _children(patterns, i + 1, children, at, True)
        return
    found = False
    if p.group or p.repeat:
        for end, b in _places(p, children, at, anchored):
            for rest in _children(patterns, i + 1, children, end, False):
                found = True
                yield b + rest
            if found and p.repeat:
                break
    else:
        for j in range(at, len(children)):
            f, c = children[j]
            if (p.field is None or p.field == f) and (p.heads is None or c.kind in p.heads):
                for b in _match(p, c):
                    for rest in _children(patterns, i + 1, children, j + 1, False):
                        found = True
                        yield b + rest
            if anchored and c.named:
                break
    if p.optional and not found:
        yield from _children(patterns, i + 1, children, at, anchored)


def _once(p: Pattern, children: list[tuple[str | None, Node]], at: int, anchored: bool) -> Iterator[tuple[int, Bindings]]:
    """(end, bindings) of the places of one p among children[at:]."""
    if p.group:
        yield from _row(p.group, 0, children, at, anchored)
        return
    for j in range(at, len(children)):
        f, c = children[j]
        if (p.field is None or p.field == f) and (p.heads is None or c.kind in p.heads):
            for b in _match(p, c):
                yield j + 1, b
        if anchored and c.named:
            return


def _places(p: Pattern, children: list[tuple[str | None, Node]], at: int, anchored: bool) -> Iterator[tuple[int, Bindings]]:
    """(end, bindings) of the places of p, of a run the longest first."""
    if not p.repeat:
        yield from _once(p, children, at, anchored)
        return
    ends: list[tuple[int, Bindings]] = []
    last: dict[str, Node] = {}
    place = next(_once(p, children, at, anchored), None)
    while place is not None and place[0] > at:
        at = place[0]
        last |= dict(place[1])
        ends.append((at, tuple(last.items())))
        place = next(_once(p, children, at, False), None)
    yield from reversed(ends)


def _row(patterns: list, i: int, children: list[tuple[str | None, Node]], at: int, anchored: bool) -> Iterator[tuple[int, Bindings]]:
    """(end, bindings) of the places of patterns[i:] in a row."""
    if i == len(patterns):
        yield at, ()
        return
    p = patterns[i]
    if p == ".":
        yield from _row(patterns, i + 1, children, at, True)
        return
    found = False
    for end, b in _places(p, children, at, anchored):
        for last, rest in _row(patterns, i + 1, children, end, False):
            found = True
            yield last, b + rest
        if found and p.repeat:
            break
    if p.optional and not found:
        yield from _row(patterns, i + 1, children, at, anchored)
