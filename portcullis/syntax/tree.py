"""Syntax tree nodes."""

from __future__ import annotations

from collections.abc import Iterator


class Node:
    """kind: the node's type, or its text if it isn't named. children: (field or None, node), in the order of the text."""

    __slots__ = ("kind", "start", "end", "children", "named")

    def __init__(self, kind: str, start: int, end: int, children: list[tuple[str | None, Node]] | None = None, named: bool = True) -> None:
        self.kind, self.start, self.end, self.children, self.named = kind, start, end, children or [], named

    def walk(self) -> Iterator[Node]:
        """This node and all below it, in the order of their starts."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for _, c in reversed(node.children))

    def field(self, name: str) -> Node | None:
        return next((c for f, c in self.children if f == name), None)

    def sexp(self) -> str:
        """For reading and tests: named nodes with their fields."""
        parts = [(f"{f}: " if f else "") + c.sexp() for f, c in self.children if c.named]
        return f"({' '.join([self.kind, *parts])})"
