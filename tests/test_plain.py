"""Statements that are passed over without tokens leave the trees and matches of all others as they are."""

import random
import sys

import pytest
from test_parts import MATCHER, ODD, PIECES, flat, plain, sources

from portcullis.operators import scan
from portcullis.operators.scan import Lines, Places, Untouched, words_of
from portcullis.plans import scans
from portcullis.syntax import lexer, parse, parse_parts
from portcullis.syntax.lexer import token_runs
from portcullis.syntax.plain import plain_run

PLAIN = ("typescript", "javascript")


class Everything:
    """Passes over all plain statements but some, whatever they touch."""

    def __init__(self, source, language, rng, most):
        self.source, self.language, self.rng, self.most, self.spans = source, language, rng, most, []

    def until(self, start):
        m = plain_run(self.language).match(self.source, start) if self.rng.random() > 0.1 else None
        if m is None:
            return start
        self.spans.append((start, m.end()))
        return m.end()

    def runs(self, after):
        return token_runs(self.source, self.language, self.most, after, 7)


def written(rng):
    """Code of random statements, in some of which pieces are put in or left out."""

    def expression(deep=0):
        x = lambda: expression(deep + 1)
        if deep > 3 or rng.random() < 0.3:
            return rng.choice(["a", "user.role", "1", "'s'", "x[0]", '"t"', "f(a, b)", "`q`", "`${q}`", "i++"])
        return rng.choice([
            lambda: x() + rng.choice([" + ", " === ", " && ", ", ", " = ", " in ", " / ", " < "]) + x(), lambda: f"({x()})", lambda: f"f({x()})", lambda: f"{{ k: {x()} }}", lambda: f"(y) => {{ {statement(deep + 1)} }}",
            lambda: f"[{x()}]", lambda: f"{x()} ? {x()} : {x()}", lambda: f"new Map<string, number>({x()})", lambda: "!" + x(), lambda: f"[a < b]>({x()})",
        ])()

    def statement(deep=0):
        s, x = lambda: statement(deep + 1), lambda: expression(deep + 1)
        if deep > 3:
            return "x++;"
        return rng.choice([
            lambda: x() + ";", lambda: f"const v = {x()}" + rng.choice([";", "\n"]), lambda: f"if ({x()}) {{ {s()} }}" + rng.choice(["", f" else {s()}"]), lambda: f"if ({x()}) {s()}" + rng.choice(["", f" else {s()}"]),
            lambda: f"return {x()};", lambda: f"for (let i = 0; i < n; i++) {{ {s()} }}", lambda: f"class A extends B {{ m(x){rng.choice(['', ': T'])} {{ {s()} }} p = {x()}; }}",
            *[lambda: rng.choice(["", "export ", "export default async "]) + f"function f{rng.choice(['', '<T>'])}({rng.choice(['', 'a: T, b = {c: 1}', '{a}'])}){rng.choice(['', ': Map<string, T[]>'])} {{ {s()} {s()} }}"] * 4,
        ])()

    text = rng.choice(["\n", " ", "\n// it's\n", "/* ( */"]).join(statement() for _ in range(rng.randrange(1, 9)))
    for _ in range(rng.choice([0, 0, 0, 1, 2, 4])):
        i = rng.randrange(len(text) + 1)
        text = text[:i] + rng.choice([*ODD, "/", "else ", "return ", "class ", "not ", "a<b>(", "):", "=> ", "++"]) + text[i + rng.choice([0, 0, 1, 5]) :]
    return text


@pytest.mark.parametrize("language", PLAIN)
def test_trees_behind_what_is_passed_over(language):
    rng = random.Random(language)
    passed = 0
    for source in [*sources(language), *(written(rng) for _ in range(1500))]:
        size = rng.choice([3, 20, 20_000])
        e = Everything(source, language, rng, size)
        got = [n for part in parse_parts(source, language, token_runs(source, language, size, None, 3), rng.choice([1, 10, 500]), e) for n in flat(part.children)]
        left = [n for n in flat(parse(source, language).children) if not any(a <= n[2] and n[3] <= b for a, b in e.spans)]
        assert got == left, (source, e.spans)
        passed += bool(e.spans)
    assert passed > 500


@pytest.mark.parametrize("language", PLAIN)
def test_matches_beside_what_is_passed_over(language, monkeypatch):
    rng = random.Random(language)
    texts = [*sources(language)]
    texts += ["\n".join(x for _ in range(4) for x in (written(rng), rng.choice(PIECES[language])[0])) for _ in range(150)]
    found = lambda most: [[x for piece in MATCHER.pieces(s, language, None, None, most) for x in piece] for s in texts]
    few, all_ = found(5), found(sys.maxsize)
    given = [MATCHER.matches(s, language, None, lexer.tokens(s, language)) for s in texts]
    monkeypatch.setattr(scan, "plain_run", lambda _: None)
    key = lambda x: (x["rule_ord"], x["line_start"], x["line_end"], x["code_snippet"], x["captures"])
    for source, *each in zip(texts, few, all_, given, found(sys.maxsize), strict=True):
        a, b, c, d = (sorted(map(key, x)) for x in each)
        assert a == b == c == d, source


def test_functions_without_decisions_cost_no_tokens(monkeypatch):
    """Of scan_plain_ts: four times the functions that hold nothing take no more tokens."""
    counts = []
    for n in (500, 2000):
        source = plain("ts", n).replace("if (user.role ===", "if (user.rule ===") + "\n" + plain("ts", 1)
        count = [0]

        class Counted(lexer.Token):
            def __init__(self, *a, count=count):
                count[0] += 1
                super().__init__(*a)

        monkeypatch.setattr(lexer, "Token", Counted)
        assert [x["line_start"] for x in MATCHER.matches(source, "typescript")] == [7 * n + 5]
        counts.append(count[0])
    assert counts[1] == counts[0] < 5_000, counts


def test_a_text_without_plain_statements_is_not_gone_through_again_and_again():
    source = "x = 1\n" * 20_000 + "user.role\n"
    tried = []

    class Pattern:
        def match(self, text, start, end):
            tried.append(start)
            return plain_run("typescript").match(text, start, end)

    u = Untouched(source, Pattern(), [Places(source, scan.re.compile("role"))], None)
    assert all(u.until(i) == i for i in range(0, 120_000, 6))
    assert len(tried) < 100


def test_lines_far_apart():
    source = "".join("x" * (i % 5) + "\n" for i in range(300))
    rng = random.Random(0)
    for _ in range(50):
        lines = Lines(source)
        for at in sorted(rng.sample(range(len(source)), 12)):
            lines.forget(at)
            for x in (at, min(at + rng.randrange(40), len(source) - 1), max(0, at - 3)):
                assert lines.of(x) == source.count("\n", 0, x) + 1


def test_words_of_patterns():
    assert words_of("(?i)(owner_?id|user_?id)") == ("owner_id", "ownerid", "user_id", "userid") and words_of("(roles?|groups?)") == ("group", "role")
    assert words_of("[a-z][A-Za-z]*Procedure") == ("procedure",) and words_of("(can|may)([A-Z]\\w*)?") == ("can", "may")
    assert words_of("a|\\d") == words_of("(a)(b)") == words_of("(?i)\\w+") == words_of("ſet") == words_of("x{0}y") == ()
    for language, pieces in PIECES.items():
        for code, _, _ in pieces:
            for text in (code, code.upper(), code.lower(), code.swapcase()):
                for p, words in MATCHER.words.items():
                    assert not (words and p.search(text)) or any(w in text.lower() for w in words), (language, p.pattern, text)
    # letters that equal others only without regard to case
    assert MATCHER.fitting("ſtaff.belongsTo(1)\nuſe", "typescript") == [r for r in MATCHER.by_language["typescript"] if all(p.search("ſtaff.belongsTo(1)\nuſe") for p in r[-1])]
    for text in ("x" * scan.WINDOW + "hasRole(1)", "x" * (scan.WINDOW - 4) + "hasRole(1)"):
        assert any(r[1].id == "ts-has-role-call" for r in MATCHER.fitting(text, "typescript"))


def test_texts_are_found_as_without_their_words(monkeypatch):
    monkeypatch.setattr(scan, "STEP", 7)
    rng = random.Random(1)
    for pattern in ("(role|roles|roleName|userRole)", "use", "(?i)(role|x)", "[a-z][A-Za-z]*Role"):
        p = scan.re.compile(pattern)
        for _ in range(300):
            text = "".join(rng.choice(["role", "Role", "roles", "roleName", "use", "user", "Name", "x", " ", " ", "s", "é" if rng.random() < 0.1 else "."]) for _ in range(rng.randrange(40)))
            assert [m.span() for m in scan.texts_of(text, p, words_of(pattern))] == [m.span() for m in p.finditer(text)], (pattern, text)


def test_files_are_dealt_before_they_are_put_together(spark):
    """Their rows go round once, and no content does."""
    for files in (scans.plain_blocks(spark, "/root/testdata/sf0.001", "ts"), scans.plain_code(spark, "/root/testdata/sf0.001")):
        plan = files._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1, plan
