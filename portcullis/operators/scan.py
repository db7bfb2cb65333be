"""The structural scan: source files to findings and enforcement points.

One Python stage parses each file once and gives, as arrays of a row, its rule matches, the policy names that it imports,
and its assignments. That row has no source text any more; it is written once, and everything after it is relational. A large file is
parsed part by part and gives several rows, so of its tokens, trees and matches a task holds those of a part, or of one statement."""

from __future__ import annotations

import gc
import re
import sys
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portcullis import model
from portcullis.checkpoints import checkpointed
from portcullis.functions import paths, text
from portcullis.operators import bindings, findings
from portcullis.rules.spec import Rule, RuleError
from portcullis.syntax import Query, parse_parts
from portcullis.syntax.imports import assignment_parts, is_policy_path, policy_imports
from portcullis.syntax.lexer import OP, RUN, Token, token_runs, tokens
from portcullis.syntax.parser import FEW, FIRST
from portcullis.syntax.plain import plain_run
from portcullis.syntax.query import Index
from portcullis.syntax.tree import Node
from portcullis.tiers import BROADCAST

PARSED = (
    "file string, language string, matches array<struct<rule_id:string,rule_ord:int,match_seq:int,line_start:bigint,line_end:bigint,code_snippet:string,"
    f"captures:map<string,string>,policy_outputs:{model.POLICY_OUTPUTS},provenance:string>>, names array<string>, edges array<struct<lhs:string,rhs:string>>"
)
#: Rules are sent to the workers with the task; they are files of a few kilobytes each.
MAX_RULES = 20_000
#: Matches or assignments in a row, and in rows that are handed on together.
PIECE = 1_000
#: Bytes of files that cross to a worker at once; a longer file crosses alone.
FILE_BYTES = 1 << 20
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Characters of a file that are read at least until plain statements are looked for again.
MOST_WAIT = 4_096
#: Characters of a file in which a rule's text is looked for by its words.
STEP = 1 << 14
#: Characters of a file in which the texts of all rules are looked for at once.
WINDOW = 1 << 18
#: Characters of a file whose tokens are kept from the matches to the imports; those of a longer one are read again.
KEPT = 200_000


def strip_quotes(s: str) -> str:
    s = s.strip()
    return s[1:-1] if len(s) > 1 and s[0] == s[-1] and s[0] in "\"'" else s


def quoted_items(s: str) -> str:
    items = (x.strip() for x in s.strip().strip('"').strip("'").split(","))
    return ", ".join(f'"{x}"' for x in items if x)


def render(template: str, captures: dict[str, str], engine: str) -> str:
    """{{key}} -> the capture without quotes; sets of roles as quoted items; unknown keys stay."""
    values = {k: strip_quotes(v) for k, v in captures.items()}
    if engine == "rego" and "roles" in captures:
        values["roles_set"] = quoted_items(captures["roles"])
    if engine == "cedar" and (roles := captures.get("roles", captures.get("role_value"))) is not None:
        values["cedar_roles_set"] = quoted_items(roles)
    return re.sub(r"\{\{(\w+)\}\}", lambda m: values.get(m[1], m[0]), template)


def loose(kind: str, value: str) -> re.Pattern | None:
    """A pattern that is found in every source whose captures can meet a condition; None if there is no telling."""
    if kind == "eq":
        return re.compile(re.escape(value))
    if kind != "match":
        return None
    bare = re.sub(r"^((?:\(\?i\))?)\^", r"\1", value)
    bare = bare.removesuffix("$") if not bare.endswith("\\$") else bare
    if re.search(r"[\^$]|\\[bBAZ]|\(\?[^:i]", re.sub(r"\[\^?(?:\\.|[^\]])*\]|\\[$^]", "", bare)):
        return None  # other anchors, borders or looks around would see the source's neighbours
    return re.compile(bare)


def words_of(pattern: str) -> tuple[str, ...]:
    """Words in small letters, one of which is in every text in ASCII in which the pattern is found, if in small letters; none if there is no telling."""
    bare = pattern.removeprefix("(?i)")
    bare = re.sub(r"\\.|\[\^?(?:\\.|[^\]])*\]", ".", bare)  # one of several characters
    bare = re.sub(r"\([^()]*\)[?*]", ".", bare)  # what may be left out
    if m := re.fullmatch(r"\((?!\?)([^()]*)\)(?:\.[?*+]?)*", bare):
        bare = m[1]
    if not pattern.isascii() or re.search(r"[(){}^$]", bare):
        return ()
    out = set()
    for one in bare.split("|"):
        letter = re.search(r"\w\?", one)
        both = [one] if letter is None else [one[: letter.start()] + x + one[letter.end() :] for x in ("", letter[0][0])]
        out |= {max(re.split(r"\W+", re.sub(r".[?*]", ".", x)), key=len).lower() for x in both}
    return () if "" in out else tuple(sorted(x for x in out if not any(y in x for y in out if y != x)))


def texts_of(source: str, pattern: re.Pattern, words: tuple[str, ...]) -> Iterator[re.Match]:
    """finditer(), of texts in ASCII only where they have one of the words, if the pattern is of nothing but names."""
    names = re.fullmatch(r"\(?(\w+(?:\|\w+)*)\)?", pattern.pattern)
    if not (words and names and source.isascii()):
        yield from pattern.finditer(source)
        return
    longest, i = max(map(len, names[1].split("|"))), 0
    while i < len(source):
        end, beyond = i + STEP, i + STEP + longest
        part = source[i:beyond].lower()
        if any(w in part for w in words):
            for m in pattern.finditer(source, i, beyond):
                if m.start() >= end:
                    break
                yield m
                i = m.end()
        i = max(i, end)


class Places:
    """Where a source has text that a rule needs. A place of it that the search passes over lies in one that it finds, so a part
    of the source that touches none of those has none. Places are searched for as far as they are asked for."""

    def __init__(self, source: str, needed: re.Pattern, words: tuple[str, ...] = ()) -> None:
        self.coming = texts_of(source, needed, words)
        self.first: list[int] = []
        self.last: list[int] = []
        self.read = 0  # places that begin before are known
        self.low = 0  # places that end here or before are forgotten

    def within(self, start: int, end: int) -> bool:
        if start < self.low:
            return True  # no telling any more
        while self.read < end:
            m = next(self.coming, None)
            if m is None:
                self.read = sys.maxsize
                break
            self.first.append(m.start())
            self.last.append(m.end())
            self.read = m.start() + 1
        i = bisect_right(self.last, start)
        return i < len(self.first) and self.first[i] < end

    def may(self, node: Node) -> bool:
        return self.within(node.start, node.end)

    def after(self, start: int) -> int:
        """Where the first place begins that ends behind start; the largest number if there is none."""
        if start < self.low:
            return start  # no telling any more
        while (not self.last or self.last[-1] <= start) and self.read < sys.maxsize:
            self.within(start, self.read + 1)
        i = bisect_right(self.last, start)
        return self.first[i] if i < len(self.first) else sys.maxsize

    def forget(self, start: int) -> None:
        """Nothing before start will be asked for."""
        if start > self.low:
            self.low = start
            i = bisect_right(self.last, start)
            del self.first[:i], self.last[:i]


class Lines:
    """The numbers of lines, from 1, of places in a source; those of places far back are counted anew."""

    def __init__(self, source: str) -> None:
        self.source = source
        self.coming = re.finditer("\n", source)
        self.starts: list[int] = [0]
        self.passed = 0  # lines that begin before those in starts

    def of(self, at: int) -> int:
        if at < self.starts[0]:
            return self.source.count("\n", 0, at) + 1
        while self.starts[-1] <= at and (m := next(self.coming, None)) is not None:
            self.starts.append(m.end())
        return self.passed + bisect_right(self.starts, at)

    def forget(self, start: int) -> None:
        """Nothing before start will be asked for."""
        i = max(0, bisect_right(self.starts, start) - 1)
        if i == len(self.starts) - 1 and (n := self.source.count("\n", self.starts[-1], start)):  # none was read so far
            self.passed += i + n
            self.starts = [self.source.rindex("\n", 0, start) + 1]
            self.coming = _NEWLINE.finditer(self.source, self.starts[0])
            return
        self.passed += i
        del self.starts[:i]


_NEWLINE = re.compile("\n")


class Untouched:
    """Plain statements of a source that touch none of the places."""

    def __init__(self, source: str, pattern: re.Pattern, places: list[Places], runs: Callable[[Token | None], Iterator[list[Token]]]) -> None:
        self.source, self.match, self.places, self.runs = source, pattern.match, places, runs
        self.place = -1  # where the first place begins that ends behind the statements
        self.wait, self.failed = 0, 0  # nothing is tried before wait, after so many trials in vain

    def until(self, start: int) -> int:
        if start < self.wait:
            return start
        if start >= self.place:
            self.place = min(p.after(start) for p in self.places)
        m = self.match(self.source, start, min(self.place, len(self.source))) if start < self.place else None
        if m is None:  # a text without such statements isn't gone through again and again
            self.failed += 1
            self.wait = start + min(16 << self.failed, MOST_WAIT)
            return start
        self.failed = 0
        return m.end()


#: Languages whose blocks of statements stand in braces, and the words that may stand before one; in Go any may.
BRACES = {"typescript", "javascript", "java", "csharp", "go", "kotlin", "php"}
_BEFORE_BLOCK = {")", "=>", "->", "else", "try", "finally", "do"}


def without_blocks(given: list[Token], language: str, needed: list[Places]) -> list[Token]:
    """Tokens without what stands in blocks that hold nothing any rule needs; the braces stay."""
    return [t for run in runs_without_blocks(iter([given]), language, needed) for t in run]


def runs_without_blocks(runs: Iterator[list[Token]], language: str, needed: list[Places]) -> Iterator[list[Token]]:
    """without_blocks() of tokens in runs; what stands in an open block is held back."""
    if language not in BRACES:
        yield from runs
        return
    out: list[Token] = []
    opened: list[tuple[int, bool]] = []  # of each open brace its place in out, and whether it begins a block
    for run in runs:
        for t in run:
            if t.kind == OP:
                if t.text == "{":
                    last = out[-1] if out else None
                    opened.append((len(out), last is not None and (language == "go" or last.text in _BEFORE_BLOCK)))
                elif t.text == "}" and opened:
                    at, block = opened.pop()
                    if block and len(out) - at > 1 and not any(p.within(out[at].end, t.start) for p in needed):
                        del out[at + 1 :]
            out.append(t)
        done = min(next((at for at, block in opened if block), len(out)), len(out) - 1)  # the last one says what a brace begins
        if done > 0:
            yield out[:done]
            del out[:done]
            opened = [(at - done, block) for at, block in opened]
    if out:
        yield out


def in_parts(query: Query) -> bool:
    """Whether all that the query can match lies within one statement of a file."""
    return query.roots is not None and "program" not in query.roots


class Matcher:
    """Compiled rules by language. A rule that doesn't compile is left out and named in ``refused``."""

    def __init__(self, rules: list[Rule]) -> None:
        if len(rules) > MAX_RULES:
            raise ValueError(f"more than {MAX_RULES} rules")
        self.by_language: dict[str, list] = {}
        self.words: dict[re.Pattern, tuple[str, ...]] = {}
        self.refused: dict[str, str] = {}
        for order, rule in enumerate(rules):
            try:
                query = rule.compiled()
            except RuleError as e:
                self.refused[rule.id] = str(e)
                continue
            tests = [(c, k, re.compile(v) if k.endswith("match") else v) for c, k, v in rule.predicates]
            cross = [(kind, captures, re.compile(v)) for kind, captures, v in rule.cross]
            needs = [p for _, k, v in rule.predicates if (p := loose(k, v)) is not None]
            self.words |= {p: words_of(p.pattern) for p in needs}
            for language in rule.languages:
                self.by_language.setdefault(language, []).append((order, rule, query, tests, cross, needs))

    def fitting(self, source: str, language: str) -> list:
        """The rules that can find anything in a source at all."""
        rules = self.by_language.get(language, ())
        if source.isascii():  # other letters may have equals in it
            words = {w for r in rules for p in r[-1] for w in self.words[p]}
            longest = max(map(len, words), default=0)
            for i in range(0, len(source), WINDOW):
                part = source[i : i + WINDOW + longest].lower()
                words = {w for w in words if w not in part}
                if not words:
                    break
            rules = [r for r in rules if not any(self.words[p] and words.issuperset(self.words[p]) for p in r[-1])]
        known: dict[re.Pattern, bool] = {}

        def has(p: re.Pattern) -> bool:
            if p not in known:
                known[p] = p.search(source) is not None
            return known[p]

        return [r for r in rules if all(has(p) for p in r[-1])]

    @staticmethod
    def holds(captures: dict[str, str], tests: list, cross: list) -> bool:
        for name, kind, value in tests:
            c = captures.get(name)
            if c is None:
                return False
            hit = c == value if kind.endswith("eq") else value.search(c) is not None
            if hit == kind.startswith("not"):
                return False
        return all((any if kind == "any_match" else all)(n in captures and pattern.search(captures[n]) for n in names) for kind, names, pattern in cross)

    def matches(self, source: str, language: str, rules: list | None = None, given: list[Token] | None = None) -> list[dict]:
        """rules: the fitting ones, and given: the source's tokens, where they are known already."""
        return [x for piece in self.pieces(source, language, rules, given) for x in piece]

    def pieces(self, source: str, language: str, rules: list | None = None, given: list[Token] | None = None, most: int = RUN) -> Iterator[list[dict]]:
        """matches() in pieces; a rule's are in the order of the source. most: the tokens of a part that is parsed at once."""
        rules = self.fitting(source, language) if rules is None else rules
        if not rules:
            return  # nothing to find: not even parsed
        inside = language != "ruby" or "<<" not in source  # bodies of here-documents lie outside of the nodes that hold them
        needs = {r[1].id: r[-1] for r in rules if r[-1] and inside}
        often = {p: sum(1 for _ in p.finditer(source)) for ps in needs.values() if len(ps) > 1 for p in ps}
        rarest = {rule: min(ps, key=lambda p: often.get(p, 0)) for rule, ps in needs.items()}
        shared = {p: Places(source, p, self.words[p]) for p in rarest.values()}
        places = {rule: shared[p] for rule, p in rarest.items()}
        all_named = len(places) == len(rules)
        blocks = all_named and all(r[1].named_blocks for r in rules)
        parts = all(in_parts(r[2]) for r in rules)
        pattern = plain_run(language) if all_named and parts else None

        def read(after: Token | None = None) -> Iterator[list[Token]]:
            if given is None:
                runs = token_runs(source, language, min(most, RUN), after, None if pattern is None else FIRST if after is None else FEW)
            else:
                runs = iter([given if after is None else given[bisect_left(given, after.end, key=lambda t: t.start) :]])
            return runs_without_blocks(runs, language, list(shared.values())) if blocks else runs

        passed = None if pattern is None else Untouched(source, pattern, list(shared.values()), read)
        lines = Lines(source)
        n, out = 0, []
        rendered: dict[tuple, list[dict]] = {}  # of equal captures in a piece the outputs are the same
        for tree in parse_parts(source, language, read(), most if parts else sys.maxsize, passed):
            index = Index(tree)
            start = min(c.start for _, c in tree.children)
            for x in (lines, *shared.values()):
                x.forget(start)
            for order, rule, query, tests, cross, _ in rules:
                for nodes in query.matches(index, places[rule.id].may if rule.id in places else None):
                    captures = {name: source[n.start : n.end] for name, n in nodes.items()}
                    if not self.holds(captures, tests, cross):
                        continue
                    whole = nodes["match"]
                    if (outputs := rendered.get(same := (order, *captures.items()))) is None:
                        outputs = rendered[same] = [{"engine": e, "content": render(t, captures, e)} for e, t in rule.templates]
                    provenance = (captures.get(rule.provenance) or None) if rule.provenance else None
                    out.append({
                        "rule_id": rule.id, "rule_ord": order, "match_seq": n, "line_start": lines.of(whole.start), "line_end": lines.of(max(whole.start, whole.end - 1)),
                        "code_snippet": captures["match"], "captures": list(captures.items()), "policy_outputs": outputs, "provenance": provenance,
                    })
                    n += 1
                    if len(out) >= PIECE:
                        yield out
                        out = []
                        rendered.clear()
        if out:
            yield out


@lru_cache(maxsize=4)
def _matcher(rules: tuple[Rule, ...]) -> Matcher:
    return Matcher(list(rules))


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that run within hand files to the workers FILE_BYTES at a time, so what a worker holds doesn't grow with the number of files
    in its partition. The session's own setting is put back."""
    own = spark.conf.get(_BYTES)
    spark.conf.set(_BYTES, FILE_BYTES)
    try:
        yield
    finally:
        spark.conf.set(_BYTES, own)


def parsed(files: DataFrame, rules: list[Rule], all_edges: bool = False) -> DataFrame:
    """files: path, content, language. PARSED, one row for each file with its names, and before and after it rows without names (null) for
    what is more than a piece. all_edges: with the assignments of Go files that bind nothing themselves. To be run within small_batches()."""
    given = tuple(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _matcher(given)
        gc.disable()  # trees have no cycles, and are many objects: they go as soon as their file is done
        for b in batches:
            rows, held = [], 0
            for path, content, language in zip(b.column("path").to_pylist(), b.column("content"), b.column("language").to_pylist(), strict=True):
                for found, names, edges in _file_rows(m, content.as_py() or "", language, all_edges):
                    rows.append({"file": path, "language": language, "matches": found, "names": names, "edges": edges})
                    held += len(found) + len(edges)
                    if held >= PIECE:
                        yield pa.RecordBatch.from_pylist(rows, _SCHEMA)
                        rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, _SCHEMA)
        gc.enable()

    return files.select("path", "content", "language").mapInArrow(run, PARSED)


def _file_rows(m: Matcher, source: str, language: str, all_edges: bool) -> Iterator[tuple[list[dict], list[str] | None, list[dict]]]:
    """matches, names and edges of the rows of a file."""
    fitting = m.fitting(source, language)
    read = tokens(source, language) if len(source) <= KEPT and (fitting or language == "go") and is_policy_path(source) else None
    found: list[dict] = []
    for piece in m.pieces(source, language, fitting, read):
        if found:
            yield found, None, []
        found = piece
    # bindings matter where something is found, in Go anywhere in the package; assignments where something is bound
    names = sorted(policy_imports(source, language, read)) if found or language == "go" else []
    edges = _edge_pieces(source, language, read) if names or all_edges and language == "go" else iter(())
    yield found, names, next(edges, [])
    for piece in edges:
        yield [], None, piece


def _edge_pieces(source: str, language: str, given: list[Token] | None = None) -> Iterator[list[dict]]:
    for part in assignment_parts(source, language, given):
        for i in range(0, len(part), PIECE):
            yield [{"lhs": x, "rhs": y} for x, y in part[i : i + PIECE]]


_OUTPUT = pa.list_(pa.struct([("engine", pa.string()), ("content", pa.string())]))
_SCHEMA = pa.schema([
    ("file", pa.string()), ("language", pa.string()),
    ("matches", pa.list_(pa.struct([
        ("rule_id", pa.string()), ("rule_ord", pa.int32()), ("match_seq", pa.int32()), ("line_start", pa.int64()), ("line_end", pa.int64()), ("code_snippet", pa.string()),
        ("captures", pa.map_(pa.string(), pa.string())), ("policy_outputs", _OUTPUT), ("provenance", pa.string()),
    ]))),
    ("names", pa.list_(pa.string())), ("edges", pa.list_(pa.struct([("lhs", pa.string()), ("rhs", pa.string())]))),
])


def package_edges(files: DataFrame, one: DataFrame, first: DataFrame) -> DataFrame | None:
    """scope and e of the Go files that bind nothing themselves but whose package does; they are read once more. None if there are
    none. one: PARSED with scope, first: scope and name, both written."""
    bound = first.where(F.col("scope").startswith("go:")).select("scope").distinct()
    # rows without names (null) are no files of their own
    others = checkpointed(one.where((F.col("language") == "go") & (F.size("names") == 0)).join(bound, "scope", "left_semi").select(F.col("file").alias("path"), "scope"))
    if others.isEmpty():
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("scope", pa.string()), _SCHEMA.field("edges")])
        for b in batches:
            rows, held = [], 0
            for scope, content in zip(b.column("scope").to_pylist(), b.column("content"), strict=True):
                for edges in _edge_pieces(content.as_py() or "", "go"):
                    rows.append({"scope": scope, "edges": edges})
                    held += len(edges)
                    if held >= PIECE:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema)

    # contents stay where they are: only paths are sent round, unless there are too many of them
    again = files.join(F.broadcast(others) if others.count() <= BROADCAST else others, "path").select("scope", "content").mapInArrow(run, "scope string, edges array<struct<lhs:string,rhs:string>>")
    return again.select("scope", F.explode("edges").alias("e"))


def rules_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    rows = [(r.id, i, list(r.languages), r.category, r.confidence, r.description, r.externalized, r.query, [dict(zip(("capture", "kind", "value"), p, strict=True)) for p in r.predicates], dict(r.templates), r.provenance) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "rule_id string, rule_ord int, languages array<string>, category string, confidence string, description string, externalized boolean, query string, predicates array<struct<capture:string,kind:string,value:string>>, templates map<string,string>, provenance string")


def selected(files: DataFrame, languages: list[str] = (), excludes: list[str] = ()) -> DataFrame:
    """files (path, content) to parse: of known languages, outside of policy modules, not excluded; text that isn't valid is left out by the sources."""
    out = files.withColumn("language", paths.language(F.col("path"))).where(F.col("language").isNotNull())
    out = findings.outside_policy_modules(findings.in_languages(out, list(languages)))
    for pattern in excludes:
        out = out.where(~F.col("path").rlike(pattern))
    return out


class Scan:
    """findings and enforcement_points of a set of files, both lazy."""

    def __init__(self, files: DataFrame, rules: list[Rule], least: str | None = None, categories: list[str] = (), languages: list[str] = (), excludes: list[str] = ()) -> None:
        source = selected(files, languages, excludes)
        with small_batches(files.sparkSession):
            one = checkpointed(parsed(source, rules).withColumn("scope", findings.scope()))
        more = package_edges(source, one, one.select("scope", F.explode("names").alias("name")))
        self._route(one, more, rules, least, categories)

    @classmethod
    def of_parsed(cls, one: DataFrame, rules: list[Rule], least: str | None = None, categories: list[str] = ()) -> Scan:
        """Of files that have been parsed, with all edges: PARSED with scope, written; whole scopes."""
        self = cls.__new__(cls)
        self._route(one, None, rules, least, categories)
        return self

    def _route(self, one: DataFrame, more: DataFrame | None, rules: list[Rule], least: str | None, categories: list[str]) -> None:
        table = rules_table(one.sparkSession, rules).select("rule_id", "category", "confidence", "description", "externalized")
        matches = one.select("file", "language", "scope", F.explode("matches").alias("m")).select("file", "language", "scope", "m.*").join(F.broadcast(table), "rule_id")
        first = one.select("scope", F.explode("names").alias("name"))
        edges = one.select("scope", F.explode("edges").alias("e"))
        if more is not None:
            edges = edges.unionByName(more)
        edges = edges.select("scope", "e.lhs", "e.rhs")
        with small_batches(one.sparkSession):
            self.bindings = bindings.close(first, edges)
        self.routed = findings.route(matches, self.bindings)
        self.enforcement_points = findings.enforcement_points(self.routed)
        ids = self.routed.where("not enforced").withColumn("id", text.finding_id(F.col("rule_id"), F.col("file"), F.col("line_start"), F.col("line_end"), F.col("code_snippet")))
        kept = findings.in_categories(findings.min_confidence(findings.first_of_each(ids), least), list(categories))
        self.findings = kept.select(
            "id", "file", "line_start", "line_end", "code_snippet", "language", "category", "confidence", "description", F.col("rule_id").alias("pattern_rule"),
            "policy_outputs", F.lit("structural").alias("pass"), paths.surface(F.col("file")).alias("surface"), "provenance",
        )

    def summary(self) -> DataFrame:
        return findings.summary(self.findings, self.enforcement_points)


#: Grammar variants by language: a rule for TypeScript is tried as TSX too.
VARIANTS = {"typescript": ("typescript", "tsx")}


def variants(files: DataFrame) -> DataFrame:
    """language, is_tsx: the distinct grammars that files (path) ask for."""
    known = files.select(paths.language(F.col("path")).alias("language"), (paths.extension(F.col("path")) == "tsx").alias("is_tsx"))
    return known.where(F.col("language").isNotNull()).distinct()


def listed(table: DataFrame, language: str | None = None, categories: list[str] = ()) -> DataFrame:
    """Rules (as rules_table gives them) of a language and of categories, where given."""
    out = table.where(F.array_contains("languages", language)) if language else table
    return findings.in_categories(out, list(categories))


def test_rules(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """A row for each embedded test in each grammar variant: rule_id, test, language, variant, expected, found, passed."""
    rows = [(i, r.id, t, language, v, x.input, x.expect_match) for i, r in enumerate(rules) for t, x in enumerate(r.tests) for language in [x.language or r.languages[0]] for v in VARIANTS.get(language, (language,))]
    tests = spark.createDataFrame(rows, "rule_ord int, rule_id string, test int, language string, variant string, input string, expected boolean")
    given = tuple(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [bool(Matcher([given[i]]).matches(source, language)) for i, source, language in zip(b.column("rule_ord").to_pylist(), b.column("input").to_pylist(), b.column("language").to_pylist(), strict=True)]
            names = ["rule_id", "test", "language", "variant", "expected"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(found, pa.bool_())], names=[*names, "found"])

    return tests.mapInArrow(run, "rule_id string, test int, language string, variant string, expected boolean, found boolean").withColumn("passed", F.col("expected") == F.col("found"))


def validate_rules(rules: list[Rule]) -> dict[str, str]:
    """Rules whose query doesn't compile or lacks a capture: id -> why."""
    return Matcher(rules).refused
