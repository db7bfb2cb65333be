"""Error-tolerant parsers for nine languages.

One operator-precedence parser for expressions serves all languages; a dialect names the node kinds and says how its
calls, members, strings, annotations and classes look. Statements are read as runs of expressions between separators;
what fits nowhere is passed over, so a file with errors still gives the trees of everything else in it."""

from __future__ import annotations

import re
import sys
from bisect import bisect_left
from collections.abc import Iterator
from typing import Protocol

from portcullis.syntax.lexer import ID, NEWLINE, NUMBER, OP, RUN, STRING, SYMBOL, VARIABLE, Token, token_runs, tokens
from portcullis.syntax.tree import Node

DEEPEST = 120
_FLOAT = re.compile(r"(?!0[xX])(?:.*[.eE].*|.*[fFdDmM])", re.S)
_WORD = re.compile(r"(?:\\.|[^\s\\])+", re.S)
_ESCAPE = re.compile(r"\\(?:u\{[0-9A-Fa-f]*\}|u[0-9A-Fa-f]{4}|x[0-9A-Fa-f]{1,2}|[0-7]{1,3}|\r\n|.)", re.S)

_LEVELS = [
    "= += -= *= /= %= := ??= ||= &&= |= &= ^= **= <<= >>=", "=> ->", "?", "|| ?? ?: or", "&& and", "|", "^", "&", "== != === !== <=> =~ !~ is is_not not_in in !in",
    "< > <= >= instanceof as", ".. ...", "<< >>", "+ -", "* / %", "**",
]
BINARY = {op: i for i, level in enumerate(_LEVELS) for op in level.split()}
RIGHT = {0, 1, 2, 14}
_POSTFIX = {".", "?.", "::", "->", "?->", "&.", "(", "[", "!", "++", "--", "<", "{"}
PREFIX = set("! - + ~ & * ++ -- <- ... .. :: @ typeof await void delete not yield new throw return case".split())

_C_WORDS = set(
    "if else for while do switch case default break continue return try catch finally throw throws new class interface enum struct trait import package export from public private protected "
    "static final abstract async await function def fun func var val let const type void using namespace in of instanceof typeof yield extends implements readonly override virtual sealed "
    "internal partial params ref out get set init where select go defer range chan map object companion data open lateinit suspend inline operator infix unless until when then elsif elif end do "
    "begin rescue ensure module self with as assert lambda not and or is del global nonlocal raise pass echo print require require_once include include_once use foreach endforeach endif match fn goto "
    "clone record synchronized goto static".split()
)

#: Tokens that are read at once where a file begins of which statements are passed over, and behind those.
FIRST, FEW = 1_000, 200
#: Characters between the statements of a part, if some were passed over.
SPAN = 1 << 18


class Passed(Protocol):
    """Statements of a file that needn't be read."""

    def until(self, start: int) -> int:
        """Where those end that begin here; start if there are none. They end with a bracket or a semicolon."""

    def runs(self, after: Token) -> Iterator[list[Token]]:
        """Runs of the tokens behind one."""


class Parser:
    language = ""
    words: set[str] = set()
    string_kind, content_kind, hole_kind = "string", None, "interpolation"
    splits_escapes = True  # text before and after an escape are nodes of their own
    call_kind, arguments_kind, argument_kind = "call_expression", "arguments", None
    member_kind, object_field, member_field, member_name_kind = "member_expression", "object", "property", "property_identifier"
    binary_kind, operator_field = "binary_expression", "operator"
    identifier_kind = "identifier"
    integer_kind, float_kind = "number", "number"
    member_ops = {".", "?.", "::"}
    methods_before_braces = False
    typed_methods = False  # Type name(...); declares a method

    def __init__(self, text: str, given: list[Token] | None = None) -> None:
        self.text = text
        self.tokens = tokens(text, self.language) if given is None else given
        self.n = len(self.tokens)
        self.at = 0
        self.depth = 0
        self.pairs = self.brackets()
        self.no_braces = 0  # in a header whose block begins with a brace
        self.short = False  # something was looked for past the last token

    # tokens

    def peek(self, k: int = 0) -> Token | None:
        i = self.at + k
        if i >= self.n:
            self.short = True
            return None
        return self.tokens[i]

    def text_at(self, k: int = 0) -> str:
        i = self.at + k
        if i >= self.n:
            self.short = True
            return ""
        t = self.tokens[i]
        return "" if t.kind == STRING else t.text

    def kind_at(self, k: int = 0) -> str:
        i = self.at + k
        if i >= self.n:
            self.short = True
            return ""
        return self.tokens[i].kind

    def take(self) -> Token:
        self.at += 1
        return self.tokens[self.at - 1]

    def accept(self, text: str) -> Token | None:
        return self.take() if self.text_at() == text else None

    def skip_newlines(self) -> None:
        while self.kind_at() == NEWLINE:
            self.at += 1

    def brackets(self) -> dict[int, int]:
        """Where each bracket closes that does."""
        out, open_ = {}, []
        for i, t in enumerate(self.tokens):
            if t.kind == OP:
                if t.text in "([{":
                    open_.append(i)
                elif t.text in ")]}" and open_:
                    out[open_.pop()] = i
        return out

    def closing(self, k: int = 0) -> int:
        """How far from here the bracket that opens at k closes; -1 if it doesn't."""
        end = self.pairs.get(self.at + k)
        if end is None:
            self.short = True
            return -1
        return end - self.at

    def skip_brackets(self) -> None:
        """Past a bracketed run."""
        k = self.closing()
        self.at = self.n if k < 0 else self.at + k + 1

    # nodes

    def node(self, kind: str, start: int, children: list[tuple[str | None, Node]]) -> Node:
        end = self.tokens[self.at - 1].end if self.at else start
        return Node(kind, start, max(end, start), children)

    @staticmethod
    def leaf(kind: str, t: Token) -> Node:
        return Node(kind, t.start, t.end)

    @staticmethod
    def sign(t: Token, text: str | None = None) -> Node:
        return Node(text or t.text, t.start, t.end, named=False)

    # statements

    def parse(self) -> Node:
        children = []
        while self.at < self.n:
            children += self.statements(None)
            if self.at < self.n:
                self.at += 1  # a bracket that closes nothing
        return Node("program", 0, len(self.text), children)

    def parts(self, runs: Iterator[list[Token]], most: int, passed: Passed | None = None) -> Iterator[Node]:
        """parse() in parts: each has some of its children, in order. Of the tokens only some ``most``, or those of one statement, are
        held; a statement that looks past those that are there is read anew with more. passed: what needn't be read; few tokens are
        then read at first, as most of them may be passed over."""
        children: list[tuple[str | None, Node]] = []
        ahead = most if passed is None else min(most, FIRST)
        before, more, least = None, True, ahead
        held, mark = 0, 0  # tokens that were read for the children, up to mark
        while more or self.at < self.n:
            if more and self.n - self.at < least:
                held += self.at - mark
                if children and (passed is None or held >= most // 2 or self.tokens[-1].end - children[0][1].start > SPAN):
                    yield Node("program", 0, len(self.text), children)
                    children, held = [], 0
                more = self.fill(runs, max(ahead, least))
                mark = self.at
                least = max(1, ahead // 2)
                ahead = min(most, 2 * ahead)
                continue
            t = self.tokens[self.at]
            if t.kind == NEWLINE or t.kind == OP and t.text in ";,:" or t.kind == OP and t.text in ")]}":
                self.at += 1
                before = None
                continue
            if passed is not None and t.kind == ID and (end := passed.until(t.start)) > t.start:
                held, mark = held + self.at - mark, bisect_left(self.tokens, end, self.at, key=lambda x: x.start)
                self.at = mark
                if self.at == self.n and more:
                    last = Token(OP, self.text[end - 1], end - 1, end)
                    self.tokens, self.n, self.at, self.pairs, mark = [last], 1, 1, {}, 1
                    runs, ahead = passed.runs(last), min(most, FEW)
                    least = ahead
                before = None
                continue
            start, self.short = self.at, False
            node = self.statement(before)
            if more and (self.short or self.at >= self.n):
                self.at, least = start, 2 * (self.n - start)
                continue
            if self.at == start:
                self.at += 1
            if node is not None:
                children.append((None, node))
            before = node
        if children:
            yield Node("program", 0, len(self.text), children)

    def fill(self, runs: Iterator[list[Token]], least: int) -> bool:
        """Drops the tokens that were read, but for the last one, and takes more until ``least`` are ahead; False at the end."""
        dropped = max(0, self.at - 1)
        del self.tokens[:dropped]
        self.at -= dropped
        more = True
        while more and len(self.tokens) - self.at < least:
            run = next(runs, None)
            more = run is not None
            if more:
                self.tokens += self.kept(run)
        self.n = len(self.tokens)
        self.pairs = self.brackets()
        return more

    def kept(self, run: list[Token]) -> list[Token]:
        """The tokens that are read."""
        return run

    def statements(self, until: str | None) -> list[tuple[str | None, Node]]:
        out: list[tuple[str | None, Node]] = []
        before = None  # the node just before in the same statement
        while (t := self.peek()) is not None:
            if t.kind == OP and t.text in ")]}":
                break
            if t.kind == NEWLINE or t.kind == OP and t.text in ";,:":
                self.at += 1
                before = None
                continue
            start = self.at
            node = self.statement(before)
            if self.at == start:
                self.at += 1
                before = None
            if node is not None:
                out.append((None, node))
            before = node if node is not None and self.at > start else None
        return out

    def statement(self, before: Node | None) -> Node | None:
        t = self.peek()
        if t.kind == ID and t.text in self.words:
            handler = getattr(self, f"word_{t.text}", None)
            if handler is not None:
                return handler()
            self.at += 1
            return None
        if t.kind == OP and t.text == "{":
            return self.block()
        if t.kind == ID and self.methods_before_braces and self.text_at(1) == "(" and self.is_method(before):
            return self.method()
        return self.expression()

    def block(self, kind: str = "statement_block") -> Node:
        start = self.take().start
        saved, self.no_braces = self.no_braces, 0
        children = self.guarded()
        self.no_braces = saved
        self.accept("}")
        return self.node(kind, start, children)

    def guarded(self) -> list[tuple[str | None, Node]]:
        """statements(), or nothing past the deepest nesting."""
        if self.depth >= DEEPEST:
            depth = 1
            while self.at < self.n and depth:
                x = self.text_at()
                depth += (x in ("(", "[", "{")) - (x in (")", "]", "}"))
                self.at += depth > 0
            return []
        self.depth += 1
        out = self.statements(None)
        self.depth -= 1
        return out

    def is_method(self, before: Node | None) -> bool:
        """name(...) { ... }, or Type name(...) ..."""
        k = self.closing(1)
        if k < 0:
            return False
        after = self.text_at(k + 1)
        if after in ("{", "throws", "where"):
            return True
        if self.typed_methods and before is not None and before.kind in ("identifier", "binary_expression", "subscript") and after in (";", "=>", ":"):
            return True
        if after == ":" and self.language in ("typescript", "javascript"):
            for i in range(k + 2, k + 40):
                x = self.text_at(i)
                if x == "{":
                    return True
                if x in ("", ";", "=", ",", ")", "?", "&&", "||"):
                    return False
        return False

    method_kind = "method_declaration"

    def method(self) -> Node:
        name = self.take()
        start = name.start
        self.skip_brackets()
        while self.text_at() not in ("{", ";", "=>", "}", ""):
            self.at += 1
        children: list[tuple[str | None, Node]] = [("name", self.leaf(self.name_kind, name))]
        if self.text_at() == "{":
            children.append(("body", self.block()))
        return self.node(self.method_kind, start, children)

    name_kind = "identifier"

    # expressions

    def deeper(self, f, *a) -> Node | None:
        """f(*a) one level down; past the deepest, a token is passed over."""
        if self.depth >= DEEPEST or self.at >= self.n:
            self.at = min(self.n, self.at + 1)
            return None
        self.depth += 1
        try:
            return f(*a)
        finally:
            self.depth -= 1

    def expression(self, least: int = 0) -> Node | None:
        if self.depth >= DEEPEST or self.at >= self.n:
            self.at = min(self.n, self.at + 1)
            return None
        self.depth += 1
        out = self._expression(least)
        self.depth -= 1
        return out

    def _expression(self, least: int) -> Node | None:
        left = self.unary()
        if left is None:
            return None
        while (op := self.operator()) is not None:
            text, width = op
            level = BINARY[text]
            if level < least:
                break
            sign = self.sign(self.peek(), text.replace("_", " "))
            if width > 1:
                sign.end = self.peek(width - 1).end
            self.at += width
            self.skip_newlines()
            if text == "?":
                left = self.conditional(left)
                continue
            right = self.right_side(text, level)
            if right is None:
                break
            left = self.binary(left, sign, right)
        return left

    def right_side(self, op: str, level: int) -> Node | None:
        if self.text_at() == "{" and op in ("=>", "->"):
            return self.block()
        return self.expression(level if level in RIGHT else level + 1)

    def operator(self) -> tuple[str, int] | None:
        """The binary operator that stands here, and its tokens."""
        if self.at >= self.n:
            return None
        t = self.tokens[self.at]
        if t.kind == OP:
            return (t.text, 1) if t.text in BINARY and self.allowed(t.text) else None
        return (t.text, 1) if t.kind == ID and t.text in self.word_operators else None

    word_operators: set[str] = {"instanceof", "in", "as"}

    def allowed(self, op: str) -> bool:
        return True

    def conditional(self, left: Node) -> Node:
        start = left.start
        a = self.expression(1)
        b = None
        if self.accept(":"):
            b = self.expression(1)
        return self.node("ternary_expression", start, [(None, x) for x in (left, a, b) if x is not None])

    def binary(self, left: Node, sign: Node, right: Node) -> Node:
        kind = "assignment_expression" if BINARY[sign.kind.replace(" ", "_")] == 0 else "lambda" if sign.kind in ("=>", "->") else self.binary_kind
        return Node(kind, left.start, max(right.end, self.tokens[self.at - 1].end), [("left", left), (self.operator_field, sign), ("right", right)])

    def unary(self) -> Node | None:
        t = self.peek()
        if t is None:
            return None
        if t.kind in (OP, ID) and t.text in PREFIX and (t.kind == OP or t.text in self.words or t.text in ("typeof", "await", "not")) and self.is_prefix(t):
            self.at += 1
            inner = self.expression(13)
            if inner is None:
                return None
            return self.node("new_expression" if t.text == "new" else "unary_expression", t.start, [(None, self.sign(t)), ("argument", inner)])
        left = self.primary()
        return None if left is None else self.postfix(left)

    def is_prefix(self, t: Token) -> bool:
        return True

    def primary(self) -> Node | None:
        t = self.peek()
        if t.kind == STRING:
            return self.string(self.take())
        if t.kind == NUMBER:
            return self.leaf(self.float_kind if _FLOAT.fullmatch(t.text) else self.integer_kind, self.take())
        if t.kind == VARIABLE:
            return self.leaf("variable_name", self.take())
        if t.kind == SYMBOL:
            return self.leaf("simple_symbol", self.take())
        if t.kind == ID:
            return self.word()
        if t.text == "(":
            return self.bracketed("parenthesized_expression", ")")
        if t.text == "[":
            return self.bracketed("array", "]")
        if t.text == "{" and not self.no_braces:
            return self.braced()
        return None

    def braced(self) -> Node:
        return self.block("object")

    def word(self) -> Node | None:
        t = self.peek()
        if t.text in self.words and t.text not in ("this", "self", "super"):
            handler = getattr(self, f"word_{t.text}", None)
            return handler() if handler is not None else None
        return self.leaf("this" if t.text == "this" else self.identifier_kind, self.take())

    def string(self, t: Token) -> Node:
        kind = self.string_kind_of(t)
        return Node(kind, t.start, t.end, self.contents(t, self.content_kind_of(t, kind)))

    def string_kind_of(self, t: Token) -> str:
        return self.string_kind

    def content_kind_of(self, t: Token, kind: str) -> str | None:
        return self.content_kind

    def contents(self, t: Token, content: str | None) -> list[tuple[str | None, Node]]:
        """Pieces of text, and the code between them."""
        a, b = t.inner
        if t.parts is None:
            return self.pieces(a, b, t, content) if content and b > a else []
        out: list[tuple[str | None, Node]] = []
        for start, end, toks in t.parts:
            if content and start > a:
                out += self.pieces(a, start, t, content)
            inner = self.nested(toks)
            out += [(None, Node(self.hole_kind, start, end, inner))] if self.hole_kind else inner
            a = end
        if content and b > a:
            out += self.pieces(a, b, t, content)
        return out

    def pieces(self, a: int, b: int, t: Token, content: str) -> list[tuple[str | None, Node]]:
        at = self.text.find("\\", a, b) if self.splits_escapes and self.escapes(t) else -1
        if at < 0:
            return [(None, Node(content, a, b))]
        out = []
        for m in _ESCAPE.finditer(self.text, a, b):
            if m.start() > a:
                out.append((None, Node(content, a, m.start())))
            out.append((None, Node("escape_sequence", m.start(), min(b, m.end()))))
            a = min(b, m.end())
        return [*out, (None, Node(content, a, b))] if b > a else out

    def escapes(self, t: Token) -> bool:
        return True

    def nested(self, toks: list[Token]) -> list[tuple[str | None, Node]]:
        """The trees of code in a string."""
        if self.depth >= DEEPEST or not toks:
            return []
        saved = self.tokens, self.n, self.at, self.pairs, self.no_braces, self.short
        self.tokens, self.n, self.at, self.no_braces = toks, len(toks), 0, 0
        self.pairs = self.brackets()
        self.depth += 1
        out: list[tuple[str | None, Node]] = []
        while self.at < self.n:
            out += self.statements(None)
            self.at += 1
        self.depth -= 1
        self.tokens, self.n, self.at, self.pairs, self.no_braces, self.short = saved
        return out

    def bracketed(self, kind: str, closed: str) -> Node:
        start = self.take().start
        saved, self.no_braces = self.no_braces, 0
        children = self.guarded()
        self.no_braces = saved
        self.accept(closed)
        return self.node(kind, start, children)

    def arguments(self) -> Node:
        """(a, b, c) with each argument a child."""
        start = self.take().start
        saved, self.no_braces = self.no_braces, 0
        children: list[tuple[str | None, Node]] = []
        while (t := self.peek()) is not None and not (t.kind == OP and t.text in ")]}"):
            if t.kind == NEWLINE or t.text == "," and t.kind == OP:
                self.at += 1
                continue
            begin = self.at
            a = self.argument()
            if a is not None:
                children.append((None, a))
            if self.at == begin:
                self.at += 1
        self.no_braces = saved
        self.accept(")")
        return self.node(self.arguments_kind, start, children)

    def argument(self) -> Node | None:
        start = self.peek().start
        if self.kind_at() == ID and self.text_at(1) == ":" and self.named_arguments:
            self.at += 2
        x = self.expression()
        if x is None or self.argument_kind is None:
            return x
        return self.node(self.argument_kind, start, [(None, x)])

    named_arguments = False

    def postfix(self, left: Node) -> Node:
        while self.at < self.n:
            t = self.tokens[self.at]
            if t.kind == NEWLINE:
                if self.continues():
                    self.skip_newlines()
                    continue
                break
            if t.kind != OP or t.text not in _POSTFIX:
                break
            if t.text in self.member_ops:
                after = self.peek(1)
                if after is None or after.kind not in (ID, VARIABLE) and after.text not in ("(", "[", "#") and after.kind != NEWLINE:
                    break
                self.at += 1
                self.skip_newlines()
                if self.text_at() in ("(", "["):  # a?.(b), a?.[b]
                    continue
                if self.kind_at() not in (ID, VARIABLE):
                    break
                left = self.member(left, t, self.take())
            elif t.text == "(":
                left = self.call(left)
            elif t.text == "[" and self.indexes(left):
                inner = self.bracketed("arguments", "]")
                left = self.node("subscript", left.start, [("object", left), ("index", inner)])
            elif t.text == "!" and self.language in ("typescript", "javascript") and self.text_at(1) in (".", ")", "[", ";", ","):
                self.at += 1
            elif t.text in ("++", "--"):
                self.at += 1
            elif t.text == "<" and (k := self.type_arguments()):
                self.at += k
            elif t.text == "{" and (built := self.literal_body(left)) is not None:
                left = built
            else:
                break
        return left

    def continues(self) -> bool:
        """The next line goes on with a member."""
        k = 0
        while self.kind_at(k) == NEWLINE:
            k += 1
        return self.text_at(k) in (".", "?.", "&.") and self.kind_at(k + 1) == ID

    def indexes(self, left: Node) -> bool:
        return True

    def literal_body(self, left: Node) -> Node | None:
        return None

    def type_arguments(self) -> int:
        """The width of <A, B<C>> before a call, else 0."""
        depth = 0
        for k in range(0, 40):
            t = self.peek(k)
            if t is None:
                return 0
            if t.text == "<":
                depth += 1
            elif t.text in (">", ">>"):
                depth -= len(t.text)
                if depth <= 0:
                    return k + 1 if self.text_at(k + 1) == "(" else 0
            elif t.kind != ID and t.text not in (",", ".", "?", "[", "]", "extends", "&", "|"):
                return 0
        return 0

    def member(self, left: Node, op: Token, name: Token) -> Node:
        return Node(self.member_kind, left.start, name.end, [(self.object_field, left), (None, self.sign(op)), (self.member_field, self.leaf(self.member_name_kind, name))])

    def call(self, left: Node) -> Node:
        args = self.arguments()
        return self.node(self.call_kind, left.start, [("function", left), ("arguments", args)])

    # shared statements

    def condition(self) -> Node | None:
        if self.text_at() == "(":
            start = self.take().start
            inner = self.guarded()
            self.accept(")")
            return self.node("parenthesized_expression", start, inner)
        return None

    def word_if(self) -> Node:
        start = self.take().start
        children: list[tuple[str | None, Node]] = []
        c = self.condition()
        if c is not None:
            children.append(("condition", c))
        body = self.deeper(self.statement, None) if self.peek() is not None and self.text_at() not in (")", "]", "}") else None
        if body is not None:
            children.append(("consequence", body))
        while self.text_at() in (";", ","):
            self.at += 1
        if self.text_at() == "else":
            self.at += 1
            other = self.deeper(self.statement, None) if self.peek() is not None and self.text_at() not in (")", "]", "}") else None
            if other is not None:
                children.append(("alternative", other))
        return self.node("if_statement", start, children)

    def dotted(self) -> tuple[Token, Token]:
        """The first and last token of a dotted name."""
        first = last = self.take()
        while self.text_at() in (".", "\\", "::") and self.kind_at(1) == ID:
            self.at += 1
            last = self.take()
        return first, last


class TypeScript(Parser):
    language = "typescript"
    words = _C_WORDS - {"type", "get", "set", "init", "select", "map", "range", "go", "object", "data", "open", "when", "use", "record", "match", "module", "end", "begin", "print", "echo", "require", "include", "unless", "until", "then", "with", "self", "val", "fun", "func", "def", "params", "where", "ref", "out", "internal", "partial", "pass", "not", "and", "or", "is", "fn", "operator", "inline", "infix", "ensure", "raise", "global", "clone", "virtual", "override", "chan", "defer", "assert", "lambda", "from", "as", "of", "package", "struct", "trait", "using", "companion"}
    methods_before_braces = True
    method_kind, name_kind = "method_definition", "property_identifier"
    content_kind, hole_kind = "string_fragment", "template_substitution"

    def string_kind_of(self, t: Token) -> str:
        return {"`": "template_string", "/": "regex"}.get(t.mark, "string")

    def content_kind_of(self, t: Token, kind: str) -> str | None:
        return None if kind == "regex" else self.content_kind

    def statement(self, before: Node | None) -> Node | None:
        if self.text_at() == "@" and self.kind_at(1) == ID:
            return self.decorator()
        return super().statement(before)

    def decorator(self) -> Node:
        start = self.take().start
        inner = self.postfix(self.leaf("identifier", self.take()))
        return self.node("decorator", start, [(None, inner)])

    def is_prefix(self, t: Token) -> bool:
        return t.text != "@"

    def word_function(self) -> Node:
        start = self.take().start
        self.accept("*")
        if self.kind_at() == ID:
            self.at += 1
        if self.text_at() == "<":
            while self.text_at() not in ("(", ""):
                self.at += 1
        if self.text_at() == "(":
            self.skip_brackets()
        while self.text_at() not in ("{", ";", "}", ""):
            self.at += 1
        return self.node("function_declaration", start, [("body", self.block())] if self.text_at() == "{" else [])

    def word_class(self) -> Node:
        start = self.take().start
        while self.text_at() not in ("{", ";", "}", ""):
            self.at += 1
        return self.node("class_declaration", start, [("body", self.block("class_body"))] if self.text_at() == "{" else [])

    word_interface = word_class
    word_enum = word_class

    def word_new(self) -> Node | None:
        start = self.take().start
        if self.kind_at() != ID:
            return None
        first, last = self.dotted()
        children: list[tuple[str | None, Node]] = [("constructor", Node("identifier", first.start, last.end))]
        if (k := self.type_arguments()) and self.text_at() == "<":
            self.at += k
        if self.text_at() == "(":
            children.append(("arguments", self.arguments()))
        return self.node("new_expression", start, children)


class JavaScript(TypeScript):
    language = "javascript"


class Java(Parser):
    language = "java"
    words = _C_WORDS - {"type", "get", "set", "init", "select", "map", "range", "go", "object", "data", "open", "when", "use", "match", "module", "end", "begin", "print", "echo", "require", "include", "unless", "until", "then", "with", "self", "val", "fun", "func", "def", "function", "params", "where", "ref", "out", "internal", "partial", "pass", "not", "and", "or", "is", "fn", "operator", "inline", "infix", "ensure", "raise", "global", "clone", "virtual", "override", "chan", "defer", "lambda", "from", "as", "of", "in", "struct", "trait", "using", "let", "await", "async", "typeof", "yield", "del", "export", "namespace", "suspend", "companion", "record", "var", "readonly", "elif", "elsif", "foreach", "rescue", "goto"}
    string_kind, content_kind = "string_literal", "string_fragment"
    integer_kind, float_kind = "decimal_integer_literal", "decimal_floating_point_literal"
    arguments_kind = "argument_list"
    methods_before_braces = typed_methods = True

    def string_kind_of(self, t: Token) -> str:
        return "character_literal" if t.mark == "'" else "string_literal"

    def content_kind_of(self, t: Token, kind: str) -> str | None:
        return None if t.mark == "'" else "multiline_string_fragment" if t.mark == '"""' else "string_fragment"

    def statement(self, before: Node | None) -> Node | None:
        if self.text_at() == "@" and self.kind_at(1) == ID and self.text_at(1) != "interface":
            return self.annotation()
        return super().statement(before)

    def is_prefix(self, t: Token) -> bool:
        return t.text not in ("@", "::", "&", "*")

    def scoped(self, first: Token, last: Token, kind: str = "scoped_identifier") -> Node:
        """a.b.c as nested nodes, or an identifier."""
        at = self.at - 1
        while self.tokens[at] is not first:
            at -= 1
        node = self.leaf("identifier", self.tokens[at])
        while self.tokens[at].start < last.start:
            at += 2
            node = Node(kind, node.start, self.tokens[at].end, [("scope", node), ("name", self.leaf("identifier", self.tokens[at]))])
        return node

    def annotation(self) -> Node:
        start = self.take().start
        first, last = self.dotted()
        children: list[tuple[str | None, Node]] = [("name", self.scoped(first, last))]
        if self.text_at() != "(":
            return self.node("marker_annotation", start, children)
        open_ = self.take().start
        args: list[tuple[str | None, Node]] = []
        while (t := self.peek()) is not None and not (t.kind == OP and t.text in ")]}"):
            if t.text == "," and t.kind == OP:
                self.at += 1
                continue
            begin = self.at
            value = self.deeper(self.element)
            if value is not None:
                args.append((None, value))
            if self.at == begin:
                self.at += 1
        self.accept(")")
        children.append(("arguments", self.node("annotation_argument_list", open_, args)))
        return self.node("annotation", start, children)

    def element(self) -> Node | None:
        start = self.peek().start
        if self.kind_at() == ID and self.text_at(1) == "=":
            key = self.leaf("identifier", self.take())
            self.at += 1
            value = self.deeper(self.element)
            return self.node("element_value_pair", start, [("key", key), *([("value", value)] if value is not None else [])])
        if self.text_at() == "{":
            self.at += 1
            items: list[tuple[str | None, Node]] = []
            while (t := self.peek()) is not None and not (t.kind == OP and t.text in ")]}"):
                begin = self.at
                if t.text != "," or t.kind == STRING:
                    x = self.deeper(self.element)
                    if x is not None:
                        items.append((None, x))
                if self.at == begin:
                    self.at += 1
            self.accept("}")
            return self.node("element_value_array_initializer", start, items)
        if self.text_at() == "@":
            return self.deeper(self.annotation)
        return self.expression(1)

    def member(self, left: Node, op: Token, name: Token) -> Node:
        if op.text == "::":
            return Node("method_reference", left.start, name.end, [(None, left), (None, self.leaf("identifier", name))])
        if self.text_at() == "(" and op.text == ".":
            args = self.arguments()
            return self.node("method_invocation", left.start, [("object", left), (None, self.sign(op)), ("name", self.leaf("identifier", name)), ("arguments", args)])
        return Node("field_access", left.start, name.end, [("object", left), (None, self.sign(op)), ("field", self.leaf("identifier", name))])

    def call(self, left: Node) -> Node:
        args = self.arguments()
        field = "name" if left.kind == "identifier" else "object"
        return self.node("method_invocation", left.start, [(field, left), ("arguments", args)])

    def word_new(self) -> Node | None:
        start = self.take().start
        if self.kind_at() != ID:
            return None
        first, last = self.dotted()
        children: list[tuple[str | None, Node]] = [("type", Node("type_identifier", first.start, last.end))]
        depth = 0
        while self.text_at() in ("<", ">", ">>") or depth and self.text_at() not in ("(", "{", ";", ""):
            depth += (self.text_at() == "<") - len(self.text_at()) * (self.text_at() in (">", ">>"))
            self.at += 1
        if self.text_at() == "(":
            children.append(("arguments", self.arguments()))
            if self.text_at() == "{":
                children.append((None, self.block("class_body")))
        return self.node("object_creation_expression", start, children)

    def type_(self) -> Node | None:
        """A type in a class header."""
        if self.kind_at() != ID:
            return None
        first, last = self.dotted()
        node = Node("type_identifier", first.start, first.end)
        if last is not first:
            node = Node("scoped_type_identifier", first.start, last.end, [(None, Node("type_identifier", first.start, last.start - 1)), (None, Node("type_identifier", last.start, last.end))])
        if self.text_at() == "<":
            depth = 0
            while self.peek() is not None and self.text_at() != "{":
                x = self.take().text
                depth += (x == "<") - (len(x) if x in (">", ">>", ">>>") else 0)
                if depth <= 0:
                    break
            node = self.node("generic_type", node.start, [(None, node)])
        return node

    def word_class(self) -> Node:
        start = self.take().start
        children: list[tuple[str | None, Node]] = []
        if self.kind_at() == ID:
            children.append(("name", self.leaf("identifier", self.take())))
        while self.peek() is not None and self.text_at() not in ("{", ";", "}"):
            if self.text_at() == "extends":
                begin = self.take().start
                x = self.type_()
                if x is not None:
                    children.append(("superclass", self.node("superclass", begin, [(None, x)])))
            elif self.text_at() == "implements":
                begin = self.take().start
                types: list[tuple[str | None, Node]] = []
                while (x := self.type_()) is not None:
                    types.append((None, x))
                    if not self.accept(","):
                        break
                inner = self.node("type_list", types[0][1].start if types else begin, types)
                children.append(("interfaces", self.node("super_interfaces", begin, [(None, inner)])))
            else:
                self.at += 1
        if self.text_at() == "{":
            children.append(("body", self.block("class_body")))
        return self.node("class_declaration", start, children)


class CSharp(Java):
    language = "csharp"
    words = (Java.words | {"in", "is", "as", "using", "namespace", "ref", "out", "params", "internal", "partial", "virtual", "override", "readonly", "sealed", "await", "async", "foreach", "struct", "typeof", "goto", "yield", "where"}) - {"package", "import", "assert", "require"}
    string_kind, content_kind = "string_literal", "string_literal_content"
    integer_kind, float_kind = "integer_literal", "real_literal"
    argument_kind = "argument"
    named_arguments = True
    word_operators = {"is", "as", "in"}

    def string_kind_of(self, t: Token) -> str:
        if t.mark[0] == "$" or t.mark == '@$"':
            return "interpolated_string_expression"
        return {"'": "character_literal", '@"': "verbatim_string_literal", '"""': "raw_string_literal"}.get(t.mark, "string_literal")

    def content_kind_of(self, t: Token, kind: str) -> str | None:
        return {"string_literal": "string_literal_content", "interpolated_string_expression": "string_content", "raw_string_literal": "raw_string_content"}.get(kind)

    def escapes(self, t: Token) -> bool:
        return t.mark in ('"', '$"')

    def statement(self, before: Node | None) -> Node | None:
        if self.text_at() == "[" and before is None:
            return self.attributes()
        return Parser.statement(self, before)

    def attributes(self) -> Node:
        start = self.take().start
        out: list[tuple[str | None, Node]] = []
        if self.kind_at() == ID and self.text_at(1) == ":":
            self.at += 2
        while self.peek() is not None and self.text_at() != "]":
            if self.kind_at() != ID:
                self.at += 1
                continue
            begin = self.peek().start
            first, last = self.dotted()
            name = Node("identifier" if first is last else "qualified_name", first.start, last.end)
            children: list[tuple[str | None, Node]] = [("name", name)]
            if self.text_at() == "(":
                open_ = self.take().start
                args: list[tuple[str | None, Node]] = []
                while (t := self.peek()) is not None and not (t.kind == OP and t.text in ")]}"):
                    at, a = self.at, t.start
                    inner: list[tuple[str | None, Node]] = []
                    if t.kind == ID and self.text_at(1) in ("=", ":"):
                        inner.append(("name", self.leaf("identifier", self.take())))
                        self.at += 1
                    x = self.expression(1) if self.text_at() != "," else None
                    if x is not None:
                        args.append((None, self.node("attribute_argument", a, [*inner, (None, x)])))
                    if self.at == at:
                        self.at += 1
                self.accept(")")
                children.append((None, self.node("attribute_argument_list", open_, args)))
            out.append((None, self.node("attribute", begin, children)))
        self.accept("]")
        return self.node("attribute_list", start, out)

    def member(self, left: Node, op: Token, name: Token) -> Node:
        return Node("member_access_expression", left.start, name.end, [("expression", left), (None, self.sign(op)), ("name", self.leaf("identifier", name))])

    def call(self, left: Node) -> Node:
        args = self.arguments()
        return self.node("invocation_expression", left.start, [("function", left), ("arguments", args)])

    def word_class(self) -> Node:
        start = self.take().start
        while self.text_at() not in ("{", ";", "}", ""):
            self.at += 1
        return self.node("class_declaration", start, [("body", self.block("declaration_list"))] if self.text_at() == "{" else [])

    word_interface = word_struct = word_class


class Go(Parser):
    language = "go"
    words = {"if", "else", "for", "switch", "case", "default", "break", "continue", "return", "go", "defer", "range", "func", "var", "const", "type", "struct", "interface", "import", "package", "select", "fallthrough", "goto", "chan", "map"}
    arguments_kind = "argument_list"
    member_kind, object_field, member_field, member_name_kind = "selector_expression", "operand", "field", "field_identifier"
    integer_kind, float_kind = "int_literal", "float_literal"
    member_ops = {"."}
    word_operators: set[str] = set()

    def allowed(self, op: str) -> bool:
        return op not in ("=>", "->", "?", "?:", "??")

    def string(self, t: Token) -> Node:
        kind = {"`": "raw_string_literal", '"': "interpreted_string_literal"}.get(t.mark, "rune_literal")
        return Node(kind, t.start, t.end, [] if kind == "rune_literal" else self.contents(t, f"{kind}_content"))

    def escapes(self, t: Token) -> bool:
        return t.mark == '"'

    def word_if(self) -> Node:
        start = self.take().start
        children: list[tuple[str | None, Node]] = []
        self.no_braces += 1
        while self.peek() is not None and self.text_at() not in ("{", "}", ")"):
            at = self.at
            if self.text_at() == ";" or self.kind_at() == NEWLINE:
                self.at += 1
                continue
            x = self.expression()
            if x is not None:
                children.append(("condition", x))
            if self.at == at:
                self.at += 1
        self.no_braces -= 1
        if self.text_at() == "{":
            children.append(("consequence", self.block("block")))
        if self.text_at() == "else":
            self.at += 1
            x = self.deeper(self.statement, None) if self.peek() is not None else None
            if x is not None:
                children.append(("alternative", x))
        return self.node("if_statement", start, children)

    word_for = word_switch = word_if

    def word_func(self) -> Node:
        start = self.take().start
        while self.peek() is not None and self.text_at() not in ("{", ";", ")", "}", ","):
            if self.text_at() == "(":
                self.skip_brackets()
            elif self.kind_at() == NEWLINE:
                break
            elif self.text_at() in ("interface", "struct") and self.text_at(1) == "{":
                self.at += 1
                self.skip_brackets()
            else:
                self.at += 1
        children = [("body", self.block("block"))] if self.text_at() == "{" else []
        return self.postfix(self.node("func_literal", start, children))

    def word_import(self) -> None:
        self.at += 1
        if self.text_at() == "(":
            self.skip_brackets()
        else:
            while self.peek() is not None and self.kind_at() != NEWLINE:
                self.at += 1

    def word_map(self) -> Node | None:
        start = self.take().start
        if self.text_at() == "[":
            self.skip_brackets()
        inner = self.primary() if self.kind_at() == ID else None
        node = self.node("map_type", start, [(None, inner)] if inner is not None else [])
        return self.block("composite_literal") if self.text_at() == "{" and not self.no_braces else node

    def literal_body(self, left: Node) -> Node | None:
        if self.no_braces or left.kind not in ("identifier", "selector_expression", "array", "subscript") or left.end != self.tokens[self.at].start:
            return None
        body = self.block("literal_value")
        return Node("composite_literal", left.start, body.end, [("type", left), ("body", body)])


class Kotlin(Parser):
    language = "kotlin"
    words = {"if", "else", "for", "while", "do", "when", "return", "try", "catch", "finally", "throw", "class", "interface", "object", "fun", "val", "var", "import", "package", "in", "is", "as", "public", "private", "protected", "internal", "override", "open", "data", "sealed", "abstract", "companion", "suspend", "lateinit", "inline", "const", "enum", "break", "continue", "typealias"}
    string_kind, content_kind = "string_literal", "string_content"
    integer_kind, float_kind = "number_literal", "float_literal"
    arguments_kind, argument_kind = "value_arguments", "value_argument"
    member_kind = "navigation_expression"
    member_ops = {".", "?.", "::"}
    word_operators = {"in", "is", "as"}

    def string_kind_of(self, t: Token) -> str:
        return {"'": "character_literal", '"""': "multiline_string_literal"}.get(t.mark, "string_literal")

    def escapes(self, t: Token) -> bool:
        return t.mark != '"""'

    def allowed(self, op: str) -> bool:
        return op != "?"

    def is_prefix(self, t: Token) -> bool:
        return t.text not in ("@", "&", "*", "::")

    def member(self, left: Node, op: Token, name: Token) -> Node:
        return Node(self.member_kind, left.start, name.end, [(None, left), (None, self.sign(op)), (None, self.leaf("identifier", name))])

    def argument(self) -> Node | None:
        start = self.peek().start
        children: list[tuple[str | None, Node]] = []
        if self.kind_at() == ID and self.text_at(1) == "=":
            children.append((None, self.leaf("identifier", self.take())))
            self.at += 1
        x = self.expression(1)
        return None if x is None and not children else self.node("value_argument", start, [*children, *([(None, x)] if x is not None else [])])

    def call(self, left: Node) -> Node:
        args = self.arguments()
        return self.node("call_expression", left.start, [(None, left), (None, args)])

    def literal_body(self, left: Node) -> Node | None:
        if self.no_braces or left.kind not in ("identifier", "navigation_expression", "call_expression"):
            return None
        start = self.peek().start
        body = self.block("lambda_literal")
        return Node("call_expression", left.start, body.end, [(None, left), (None, Node("annotated_lambda", start, body.end, [(None, body)]))])

    def statement(self, before: Node | None) -> Node | None:
        if self.text_at() == "@" and self.kind_at(1) == ID:
            return self.annotation()
        return super().statement(before)

    def annotation(self) -> Node:
        start = self.take().start
        if self.text_at(1) == ":" and self.kind_at(2) == ID:  # a use site, as @get:
            self.at += 2
        first, last = self.dotted()
        inner = Node("user_type", first.start, last.end)
        if self.text_at() == "(":
            args = self.arguments()
            inner = self.node("constructor_invocation", first.start, [(None, inner), (None, args)])
        return self.node("annotation", start, [(None, inner)])

    def word_fun(self) -> Node:
        start = self.take().start
        while self.peek() is not None and self.text_at() not in ("{", "=", ";", "}"):
            if self.text_at() == "(":
                self.skip_brackets()
            elif self.kind_at() == NEWLINE and self.text_at(1) not in (":",):
                break
            else:
                self.at += 1
        return self.node("function_declaration", start, [(None, self.block("function_body"))] if self.text_at() == "{" else [])

    def word_class(self) -> Node:
        start = self.take().start
        while self.peek() is not None and self.text_at() not in ("{", "}") and self.kind_at() != NEWLINE:
            if self.text_at() == "(":
                self.skip_brackets()
            else:
                self.at += 1
        return self.node("class_declaration", start, [(None, self.block("class_body"))] if self.text_at() == "{" else [])

    word_interface = word_object = word_class

class Php(Parser):
    language = "php"
    words = _C_WORDS - {"type", "get", "set", "init", "select", "map", "range", "go", "object", "data", "open", "when", "match", "module", "end", "begin", "unless", "until", "then", "with", "self", "val", "fun", "func", "def", "params", "where", "ref", "out", "internal", "partial", "pass", "not", "is", "operator", "inline", "infix", "ensure", "raise", "virtual", "override", "chan", "defer", "assert", "lambda", "from", "of", "package", "struct", "using", "let", "await", "async", "typeof", "del", "export", "suspend", "companion", "in", "import", "void", "record", "synchronized", "sealed", "range", "elif", "elsif", "rescue", "nonlocal", "lateinit"}
    argument_kind = "argument"
    identifier_kind = "name"
    integer_kind, float_kind = "integer", "float"
    content_kind = "string_content"
    member_ops = {"->", "?->", "::"}
    word_operators = {"instanceof", "and", "or"}
    named_arguments = True

    hole_kind = ""  # code in a string is a child of the string

    def string(self, t: Token) -> Node:
        if t.mark == "<<<'":
            return Node("nowdoc", t.start, t.end, [(None, Node("nowdoc_body", *t.inner))])
        if t.mark == "<<<":
            return Node("heredoc", t.start, t.end, [("value", Node("heredoc_body", *t.inner, self.contents(t, "string_content")))])
        return super().string(t)

    def string_kind_of(self, t: Token) -> str:
        return "string" if t.mark == "'" else "encapsed_string"

    def allowed(self, op: str) -> bool:
        return op != "->"

    def is_prefix(self, t: Token) -> bool:
        return t.text not in ("*", "::")

    def postfix(self, left: Node) -> Node:
        left = super().postfix(left)
        while self.text_at() == ".":  # concatenation
            self.at += 1
            right = self.primary() if self.peek() is not None else None
            if right is None:
                break
            right = super().postfix(right)
            left = Node("binary_expression", left.start, right.end, [("left", left), ("right", right)])
        return left

    def word(self) -> Node | None:
        t = self.peek()
        if t.text in self.words and t.text not in ("this", "self", "static", "parent"):
            handler = getattr(self, f"word_{t.text}", None)
            return handler() if handler is not None else None
        first, last = self.dotted_name()
        return self.qualified(first, last)

    def dotted_name(self) -> tuple[Token, Token]:
        first = last = self.take()
        while self.text_at() == "\\" and self.kind_at(1) == ID:
            self.at += 1
            last = self.take()
        return first, last

    @staticmethod
    def qualified(first: Token, last: Token) -> Node:
        name = Node("name", last.start, last.end)
        return name if first is last else Node("qualified_name", first.start, last.end, [("prefix", Node("namespace_name", first.start, last.start - 1)), (None, name)])

    def primary(self) -> Node | None:
        if self.text_at() == "\\" and self.kind_at(1) == ID:
            self.at += 1
            return self.word()
        return super().primary()

    def member(self, left: Node, op: Token, name: Token) -> Node:
        n = self.leaf("name" if name.kind == ID else "variable_name", name)
        if self.text_at() == "(" and name.kind == ID:
            args = self.arguments()
            kind = {"->": "member_call_expression", "?->": "nullsafe_member_call_expression", "::": "scoped_call_expression"}[op.text]
            return self.node(kind, left.start, [("scope" if op.text == "::" else "object", left), (None, self.sign(op)), ("name", n), ("arguments", args)])
        if op.text == "::":
            return Node("class_constant_access_expression", left.start, name.end, [(None, left), (None, n)])
        kind = "member_access_expression" if op.text == "->" else "nullsafe_member_access_expression"
        return Node(kind, left.start, name.end, [("object", left), (None, self.sign(op)), ("name", n)])

    def call(self, left: Node) -> Node:
        args = self.arguments()
        return self.node("function_call_expression", left.start, [("function", left), ("arguments", args)])

    def word_new(self) -> Node | None:
        start = self.take().start
        self.accept("\\")
        if self.kind_at() != ID:
            return None
        first, last = self.dotted_name()
        children: list[tuple[str | None, Node]] = [(None, self.qualified(first, last))]
        if self.text_at() == "(":
            children.append((None, self.arguments()))
        return self.node("object_creation_expression", start, children)

    def statement(self, before: Node | None) -> Node | None:
        if self.text_at() == "#" and self.text_at(1) == "[":
            return self.attributes()
        return super().statement(before)

    def attributes(self) -> Node:
        start = self.take().start
        self.at += 1
        out: list[tuple[str | None, Node]] = []
        while self.peek() is not None and self.text_at() != "]":
            self.accept("\\")
            if self.kind_at() != ID:
                self.at += 1
                continue
            begin = self.peek().start
            first, last = self.dotted_name()
            children: list[tuple[str | None, Node]] = [(None, self.qualified(first, last))]
            if self.text_at() == "(":
                children.append(("parameters", self.arguments()))
            out.append((None, self.node("attribute", begin, children)))
        self.accept("]")
        return self.node("attribute_list", start, [(None, Node("attribute_group", start, self.tokens[self.at - 1].end, out))])

    def word_function(self) -> Node:
        start = self.take().start
        self.accept("&")
        children: list[tuple[str | None, Node]] = []
        if self.kind_at() == ID:
            children.append(("name", self.leaf("name", self.take())))
        if self.text_at() == "(":
            self.skip_brackets()
        if self.text_at() == "use" and self.text_at(1) == "(":
            self.at += 1
            self.skip_brackets()
        while self.peek() is not None and self.text_at() not in ("{", ";", "}", ")", ","):
            self.at += 1
        if self.text_at() == "{":
            children.append(("body", self.block("compound_statement")))
        return self.node("method_declaration" if children and children[0][0] == "name" else "anonymous_function", start, children)

    def word_class(self) -> Node:
        start = self.take().start
        children: list[tuple[str | None, Node]] = []
        if self.kind_at() == ID and self.text_at() not in ("extends", "implements"):
            children.append(("name", self.leaf("name", self.take())))
        while self.peek() is not None and self.text_at() not in ("{", ";", "}"):
            if self.text_at() == "extends":
                begin = self.take().start
                self.accept("\\")
                if self.kind_at() == ID:
                    children.append((None, Node("base_clause", begin, begin, [(None, self.qualified(*self.dotted_name()))])))
                    children[-1][1].end = self.tokens[self.at - 1].end
            else:
                self.at += 1
        if self.text_at() == "{":
            children.append(("body", self.block("declaration_list")))
        return self.node("class_declaration", start, children)

    word_interface = word_trait = word_class

    def word_use(self) -> None:
        while self.peek() is not None and self.text_at() not in (";", "}"):
            self.at += 1

    word_namespace = word_use


class Python(Parser):
    language = "python"
    words = {"if", "elif", "else", "for", "while", "return", "yield", "try", "except", "finally", "raise", "with", "as", "class", "def", "lambda", "import", "from", "in", "is", "not", "and", "or", "assert", "del", "global", "nonlocal", "pass", "break", "continue", "async", "await", "match_"}
    content_kind, splits_escapes = "string_content", False
    integer_kind, float_kind = "integer", "float"
    call_kind, arguments_kind = "call", "argument_list"
    member_kind, member_field, member_name_kind = "attribute", "attribute", "identifier"

    def nested(self, toks: list[Token]) -> list[tuple[str | None, Node]]:
        return super().nested([t for t in toks if t.kind != NEWLINE])
    member_ops = {"."}
    word_operators: set[str] = set()
    binary_kind = "binary_operator"
    word_if = None

    def allowed(self, op: str) -> bool:
        return op not in ("?", "=>", "?:", "??", "||", "&&", "->")

    def bracketed(self, kind: str, closed: str) -> Node:
        return super().bracketed({"array": "list"}.get(kind, kind), closed)

    def operator(self) -> tuple[str, int] | None:
        two = (self.text_at(), self.text_at(1))
        if two == ("is", "not"):
            return "is_not", 2
        if two == ("not", "in"):
            return "not_in", 2
        if two[0] in ("is", "in", "and", "or") and self.kind_at() == ID:
            return two[0], 1
        return super().operator()

    def binary(self, left: Node, sign: Node, right: Node) -> Node:
        if sign.kind in ("==", "!=", "<", ">", "<=", ">=", "is", "is not", "in", "not in"):
            return Node("comparison_operator", left.start, right.end, [(None, left), ("operators", sign), (None, right)])
        if sign.kind in ("and", "or"):
            return Node("boolean_operator", left.start, right.end, [("left", left), ("operator", sign), ("right", right)])
        return super().binary(left, sign, right)

    def statement(self, before: Node | None) -> Node | None:
        t = self.peek()
        if t.text == "@" and t.kind == OP and self.kind_at(1) == ID and before is None:
            self.at += 1
            inner = self.postfix(self.leaf("identifier", self.take()))
            return self.node("decorator", t.start, [(None, inner)])
        if t.kind == ID and t.text in self.words and t.text not in ("def", "lambda", "not", "await"):
            self.at += 1
            return None
        return super().statement(before)

    def is_prefix(self, t: Token) -> bool:
        return t.text in ("-", "+", "~", "*", "**", "not", "await") or t.text == "**"

    def argument(self) -> Node | None:
        start = self.peek().start
        if self.text_at() in ("*", "**"):
            self.at += 1
        if self.kind_at() == ID and self.text_at(1) == "=":
            name = self.leaf("identifier", self.take())
            self.at += 1
            value = self.expression(1)
            return self.node("keyword_argument", start, [("name", name), *([("value", value)] if value is not None else [])])
        x = self.expression(1)
        if x is not None and self.text_at() in ("for", "async"):  # a comprehension
            rest = self.guarded()
            return self.node("generator_expression", start, [(None, x), *rest])
        if self.kind_at() == ID and self.text_at() in ("if", "else"):  # a conditional expression
            children = [(None, x)] if x is not None else []
            while self.text_at() in ("if", "else"):
                self.at += 1
                y = self.expression(1)
                if y is not None:
                    children.append((None, y))
            return self.node("conditional_expression", start, children)
        return x

    def word_def(self) -> Node:
        start = self.take().start
        if self.kind_at() == ID:
            self.at += 1
        params: list[tuple[str | None, Node]] = []
        if self.text_at() == "(":
            open_ = self.take().start
            while (t := self.peek()) is not None and t.text != ")":
                if t.kind != ID:
                    self.at += 1
                    continue
                name = self.leaf("identifier", self.take())
                kind: Node | None = None
                typed = False
                if self.accept(":"):
                    typed = True
                    self.skip_newlines()
                    kind = self.expression(1)
                if self.accept("="):
                    self.skip_newlines()
                    value = self.expression(1)
                    children: list[tuple[str | None, Node]] = [("name", name)]
                    if kind is not None:
                        children.append(("type", kind))
                    if value is not None:
                        children.append(("value", value))
                    params.append((None, self.node("typed_default_parameter" if typed else "default_parameter", name.start, children)))
                elif kind is not None:
                    params.append((None, self.node("typed_parameter", name.start, [(None, name), ("type", kind)])))
                while self.peek() is not None and self.text_at() not in (",", ")"):
                    if self.text_at() in ("(", "[", "{"):
                        self.skip_brackets()
                    else:
                        self.at += 1
                self.accept(",")
            self.accept(")")
            params = [("parameters", self.node("parameters", open_, params))]
        while self.peek() is not None and self.text_at() != ":" and self.kind_at() != NEWLINE:
            self.at += 1
        return self.node("function_definition", start, params)

    def word_lambda(self) -> Node | None:
        start = self.take().start
        while self.peek() is not None and self.text_at() != ":" and self.kind_at() != NEWLINE and self.text_at() not in (")", "]", "}"):
            self.at += 1
        self.accept(":")
        body = self.expression(1) if self.peek() is not None else None
        return self.node("lambda", start, [("body", body)] if body is not None else [])

    def continues(self) -> bool:
        return False

    def braced(self) -> Node:
        return self.block("dictionary")


class _BracketedPython(Python):
    """In brackets a new line is no end."""

    def __init__(self, text: str, given: list[Token] | None = None) -> None:
        super().__init__(text, given)
        self.open = 0  # brackets around the next token
        self.tokens = self.kept(self.tokens)
        self.n = len(self.tokens)
        self.pairs = self.brackets()

    def kept(self, run: list[Token]) -> list[Token]:
        depth, kept = self.open, []
        for t in run:
            if t.kind == OP:
                depth += (t.text in ("(", "[", "{")) - (t.text in (")", "]", "}"))
            if t.kind != NEWLINE or depth <= 0:
                kept.append(t)
            depth = max(0, depth)
        self.open = depth
        return kept


class Ruby(Parser):
    language = "ruby"
    integer_kind, float_kind = "integer", "float"
    words = {"if", "unless", "else", "elsif", "end", "while", "until", "for", "in", "do", "begin", "rescue", "ensure", "return", "def", "class", "module", "then", "when", "case", "yield", "and", "or", "not", "break", "next", "redo", "retry", "alias", "undef", "super_"}
    content_kind = "string_content"
    call_kind, arguments_kind = "call", "argument_list"
    binary_kind = "binary"
    member_ops = {".", "&.", "::"}
    word_operators = {"and", "or"}
    word_if = None
    _no_arguments = {"if", "unless", "while", "until", "do", "and", "or", "then", "in", "rescue"}

    def allowed(self, op: str) -> bool:
        return op not in ("->", "??", "?:")

    def is_prefix(self, t: Token) -> bool:
        return t.text in ("!", "-", "+", "~", "*", "&", "**", "not")

    def string(self, t: Token) -> Node:
        if t.mark == "<<":
            return Node("heredoc_beginning", t.start, t.end, [(None, Node("heredoc_body", *t.inner, self.contents(t, "heredoc_content")))])
        if t.mark in ("%w", "%i"):
            words = [(None, Node("bare_string" if t.mark == "%w" else "bare_symbol", m.start(), m.end(), [(None, Node("string_content", m.start(), m.end()))])) for m in _WORD.finditer(self.text, *t.inner)]
            code = [(None, Node("interpolation", a, b, self.nested(toks))) for a, b, toks in t.parts or ()]
            return Node("string_array" if t.mark == "%w" else "symbol_array", t.start, t.end, words + code)
        return super().string(t)

    def string_kind_of(self, t: Token) -> str:
        return {"`": "subshell", "%x": "subshell", "/": "regex", "%r": "regex", "%s": "simple_symbol"}.get(t.mark, "string")

    def content_kind_of(self, t: Token, kind: str) -> str | None:
        return None if kind == "simple_symbol" else self.content_kind

    def primary(self) -> Node | None:
        t = self.peek()
        if t.kind == VARIABLE:
            self.at += 1
            return self.leaf("global_variable" if t.text[0] == "$" else "class_variable" if t.text.startswith("@@") else "instance_variable", t)
        if t.text == "&" and self.text_at(1) == ".":
            return None
        return super().primary()

    def word(self) -> Node | None:
        t = self.peek()
        if t.text in self.words:
            handler = getattr(self, f"word_{t.text}", None)
            return handler() if handler is not None else None
        self.at += 1
        if t.text[0].isupper() and self.text_at() != "(":
            return self.leaf("constant", t)
        name = self.leaf("self" if t.text == "self" else "identifier", t)
        if self.text_at() == "(" and self.peek().start == t.end:
            args = self.arguments()
            return self.node("call", t.start, [("method", name), ("arguments", args)])
        if (args := self.command_arguments(t)) is not None:
            return Node("call", t.start, args.end, [("method", name), ("arguments", args)])
        return name

    def command_arguments(self, name: Token) -> Node | None:
        """Arguments without parentheses: on the same line, after a space."""
        t = self.peek()
        if t is None or t.start == name.end or t.kind == NEWLINE or name.text == "self":
            return None
        first = t.kind in (STRING, SYMBOL, NUMBER, VARIABLE) and t.mark != "/" or t.kind == ID and t.text not in self.words and t.text not in self._no_arguments
        tight = t.kind == OP and t.text in (":", "[", "*", "&", "-", "::") and (after := self.peek(1)) is not None and after.start == t.end and t.text in ("[", "*", "&", "::")
        if not first and not tight:
            return None
        start, children = t.start, []
        while (t := self.peek()) is not None and t.kind != NEWLINE and not (t.kind == OP and t.text in ")]};{"):
            if t.kind == ID and t.text in self._no_arguments:
                break
            at = self.at
            x = self.argument()
            if x is not None:
                children.append((None, x))
            if self.at == at or self.text_at() != ",":
                break
            self.at += 1
            self.skip_newlines()
        return self.node("argument_list", start, children) if children else None

    def argument(self) -> Node | None:
        start = self.peek().start
        if self.kind_at() in (ID, STRING) and self.text_at(1) == ":" and self.peek(1).start == self.peek().end:
            key = self.leaf("hash_key_symbol", self.take())
            self.at += 1
            self.skip_newlines()
            value = self.expression(1) if self.peek() is not None else None
            return self.node("pair", start, [("key", key), *([("value", value)] if value is not None else [])])
        x = self.expression()
        return x

    def member(self, left: Node, op: Token, name: Token) -> Node:
        if op.text == "::" and name.text[0].isupper() and self.text_at() != "(":
            return Node("scope_resolution", left.start, name.end, [("scope", left), (None, self.sign(op)), ("name", self.leaf("constant", name))])
        children: list[tuple[str | None, Node]] = [("receiver", left), (None, self.sign(op)), ("method", self.leaf("identifier", name))]
        if self.text_at() == "(" and self.peek().start == name.end:
            children.append(("arguments", self.arguments()))
        elif (args := self.command_arguments(name)) is not None:
            children.append(("arguments", args))
        return Node("call", left.start, children[-1][1].end, children)

    def postfix(self, left: Node) -> Node:
        while self.text_at() == "&" and self.text_at(1) == "." and self.kind_at(2) == ID:
            op = self.take()
            self.at += 1
            left = self.member(left, op, self.take())
        out = super().postfix(left)
        if out is not left and self.text_at() == "&" and self.text_at(1) == ".":
            return self.postfix(out)
        return out

    def call(self, left: Node) -> Node:
        args = self.arguments()
        return self.node("call", left.start, [("receiver", left), ("arguments", args)])

    def indexes(self, left: Node) -> bool:
        return self.peek().start == left.end

    def word_def(self) -> Node:
        start = self.take().start
        while self.peek() is not None and self.kind_at() != NEWLINE and self.text_at() not in ("(", ";", "="):
            self.at += 1
        if self.text_at() == "(":
            self.skip_brackets()
        return self.node("method", start, [])

    def word_class(self) -> Node | None:
        start = self.take().start
        if self.kind_at() != ID:
            return None
        first, last = self.dotted()
        children: list[tuple[str | None, Node]] = [("name", Node("constant" if first is last else "scope_resolution", first.start, last.end))]
        if self.text_at() == "<":
            begin = self.take().start
            if self.kind_at() == ID:
                parent = self.postfix(self.leaf("constant", self.take()))
                children.append(("superclass", self.node("superclass", begin, [(None, parent)])))
        body = []
        depth = 0
        # the body is what follows; it belongs to the class only for its lines, so it is read up to the matching end
        while self.peek() is not None:
            t = self.peek()
            if t.kind == ID and t.text == "end" and depth == 0:
                self.at += 1
                break
            if t.kind == ID and self.begins_block(t):
                depth += 1
            elif t.kind == ID and t.text == "end":
                depth -= 1
                self.at += 1
                continue
            if t.kind == NEWLINE or t.kind == OP and t.text in ";,:)]}":
                self.at += 1
                continue
            at = self.at
            x = self.statement(None)
            if x is not None:
                body.append((None, x))
            if self.at == at:
                self.at += 1
        if body:
            children.append(("body", Node("body_statement", body[0][1].start, body[-1][1].end, body)))
        return self.node("class", start, children)

    def begins_block(self, t: Token) -> bool:
        if t.text in ("def", "do", "begin", "case", "module"):
            return True
        before = self.tokens[self.at - 1] if self.at else None
        return t.text in ("if", "unless", "while", "until", "for") and (before is None or before.kind == NEWLINE or before.text == ";")


PARSERS = {"typescript": TypeScript, "javascript": JavaScript, "java": Java, "csharp": CSharp, "go": Go, "kotlin": Kotlin, "php": Php, "python": _BracketedPython, "ruby": Ruby}


def parse(text: str, language: str, given: list[Token] | None = None) -> Node:
    """The tree of a source text, of its tokens if they are given. Past DEEPEST levels of nesting, inner parts are passed over."""
    _deep_enough()
    return PARSERS[language](text, given).parse()


def parse_parts(text: str, language: str, runs: Iterator[list[Token]] | None = None, most: int = RUN, passed: Passed | None = None) -> Iterator[Node]:
    """parse() in parts, each a node of the same kind and place with some of the children; of runs of the text's tokens, if they are given.
    passed: which statements of the file are left out."""
    _deep_enough()
    return PARSERS[language](text, []).parts(token_runs(text, language) if runs is None else runs, most, passed)


def _deep_enough() -> None:
    if sys.getrecursionlimit() < 5000:
        sys.setrecursionlimit(5000)  # DEEPEST levels take some ten calls each
