"""Functions of snippets, lines, templates and ids."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def lines(text: Column) -> Column:
    """Lines without their ends; the empty piece after a last end is no line."""
    none = F.array().cast("array<string>")
    return let(F.split(text, "\r?\n"), lambda parts: F.when(F.size(parts) == 0, none).when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts))


def little_endian(n: Column) -> Column:
    """A bigint as 8 bytes, least first."""
    x = F.lpad(F.hex(n), 16, "0")
    return F.unhex(F.concat(*[F.substring(x, 15 - 2 * i, 2) for i in range(8)]))


def finding_id(rule: Column, file: Column, line_start: Column, line_end: Column, snippet: Column) -> Column:
    """SHA-256 over rule, path, both lines as 8 bytes each and snippet, without separators."""
    return F.sha2(F.concat(rule.cast("binary"), file.cast("binary"), little_endian(line_start), little_endian(line_end), snippet.cast("binary")), 256)


def strip_quotes(s: Column) -> Column:
    """Trimmed, without one pair of equal quotes around it."""
    return F.regexp_replace(F.trim(s), r"(?s)^(?:\"(.*)\"|'(.*)')$", "$1$2")


def literals(code: Column, engine: str) -> Column:
    """String literals of a snippet. The rego form lets quotes differ, the cedar form doesn't."""
    if engine == "rego":
        return F.regexp_extract_all(code, F.lit(r"""["']([^"']+)["']"""), F.lit(1))
    whole = F.regexp_extract_all(code, F.lit(r""""[^"]+"|'[^']+'"""), F.lit(0))
    return F.transform(whole, lambda x: x.substr(F.lit(2), F.length(x) - 2))


def quoted_items(s: Column) -> Column:
    """admin, user -> "admin", "user": the items of a comma-separated list, quoted; quotes around the list and empty items go."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(s), '^"+|"+$', ""), "^'+|'+$", "")
    items = F.filter(F.transform(F.split(bare, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ", ")


def percent(part: Column, rest: Column) -> Column:
    """part of part + rest in whole percent, halves up; 0 of nothing."""
    total = part + rest
    return F.when(total == 0, 0).otherwise(F.round(part / total * 100)).cast("int")


def header_line(snippet: Column) -> Column:
    """The first line; over 80 characters, the first 77 and three dots; trimmed."""
    first = F.coalesce(F.get(lines(snippet), F.lit(0)), F.lit(""))
    return F.trim(F.when(F.length(first) > 80, F.concat(F.substring(first, 1, 77), F.lit("..."))).otherwise(first))


# The notes put above policies that aren't certain, by engine's comment mark.
COMMENT = {"rego": "#", "cedar": "//"}


def by_confidence(body: Column, confidence: Column, engine: str) -> Column:
    """As it is if high; with a note if medium; as comments if low."""
    mark = COMMENT[engine]
    commented = F.transform(lines(body), lambda x: F.when((x == "") | x.startswith(mark), x).otherwise(F.concat(F.lit(f"{mark} "), x)))
    return (
        F.when(confidence == "high", body)
        .when(confidence == "medium", F.concat(F.lit(f"{mark} TODO: verify this policy\n"), body))
        .otherwise(F.concat(F.lit(f"{mark} SUGGESTION: review and uncomment if correct\n"), F.array_join(commented, "\n")))
    )


def render(template: Column, variables: dict[str, Column], raw: tuple[str, ...] = ()) -> Column:
    """{{key}} -> value without its quotes (raw keys: as it is); keys with a null value, or without one, stay as they are."""
    put = lambda t, kv: F.coalesce(F.replace(t, F.lit("{{" + kv[0] + "}}"), kv[1] if kv[0] in raw else strip_quotes(kv[1])), t)
    return reduce(put, variables.items(), template)


def numbered(snippet: Column, first_line: Column) -> Column:
    """Each line after its number, which fills four places, and a newline after each; an empty snippet is a newline."""
    def one(x: Column, i: Column) -> Column:
        n = (first_line + i).cast("string")
        return F.concat(F.lpad(n, F.greatest(F.length(n), F.lit(4)), F.lit(" ")), F.lit(": "), x, F.lit("\n"))

    return F.when(snippet == "", "\n").otherwise(F.array_join(F.transform(lines(snippet), one), ""))


def clipped(s: Column, n_bytes: int) -> Column:
    """At most so many bytes of UTF-8, whole characters only. Of the prefixes that could fit, the longest that does."""
    whole = F.octet_length(s) <= n_bytes
    sizes = F.aggregate(
        F.split(F.substring(s, 1, n_bytes), ""),
        F.struct(F.lit(0).alias("bytes"), F.lit(0).alias("chars")),
        lambda a, c: F.struct(
            (a["bytes"] + F.octet_length(c)).alias("bytes"),
            F.when(a["bytes"] + F.octet_length(c) <= n_bytes, a["chars"] + 1).otherwise(a["chars"]).alias("chars"),
        ),
    )
    return F.when(whole, s).otherwise(s.substr(F.lit(1), sizes["chars"]))


#: Lines that count as imports, bytes of each, and their share of a prompt.
IMPORT_LINES, IMPORT_BYTES, IMPORT_SHARE = 20, 200, 0.25


def bounded_imports(all_lines: Column, max_chars: int) -> Column:
    """The first lines, each clipped, up to the first that goes beyond the budget (one more byte for each line)."""
    budget = int(max_chars * IMPORT_SHARE)
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("spent"), F.lit(False).alias("full"))

    def step(a: Column, x: Column) -> Column:
        def put(line: Column) -> Column:
            spent = a["spent"] + F.octet_length(line) + 1
            kept = F.struct(F.concat(a["out"], F.array(line)).alias("out"), spent.alias("spent"), F.lit(False).alias("full"))
            return F.when(spent > budget, F.struct(a["out"].alias("out"), a["spent"].alias("spent"), F.lit(True).alias("full"))).otherwise(kept)

        return F.when(a["full"], a).otherwise(let(clipped(x, IMPORT_BYTES), put))

    return F.aggregate(F.slice(all_lines, 1, IMPORT_LINES), start, step)["out"]


LINES_BEFORE, LINES_AFTER = 5, 15
TRUNCATED = "\n// [truncated: max_prompt_chars]"


def context(content: Column, line_start: Column, line_end: Column, max_chars: int) -> Column:
    """struct(line_start, line_end, snippet, imports): the lines around a range, within a budget of bytes."""
    none = F.array().cast("array<string>")
    empty = F.struct(F.lit(1).cast("bigint").alias("line_start"), F.lit(1).cast("bigint").alias("line_end"), F.lit("").alias("snippet"), none.alias("imports"))

    def around(every: Column) -> Column:
        n = F.size(every)
        a = F.least(F.greatest(line_start, F.lit(1)), n)
        b = F.least(F.greatest(line_end, a), n)
        first, last = F.greatest(a - LINES_BEFORE, F.lit(1)), F.least(b + LINES_AFTER, n)
        whole = F.array_join(F.slice(every, first.cast("int"), (last - first + 1).cast("int")), "\n")
        parts = let(F.struct(first.cast("bigint").alias("a"), last.cast("bigint").alias("b"), whole.alias("whole"), bounded_imports(every, max_chars).alias("imports")), within)
        return F.when(n == 0, empty).otherwise(parts)

    def within(x: Column) -> Column:
        left = F.greatest(F.lit(max_chars) - F.aggregate(x["imports"], F.lit(0), lambda s, i: s + F.octet_length(i) + 1), F.lit(0))
        return let(left, lambda room: F.struct(x["a"].alias("line_start"), x["b"].alias("line_end"), cut(x["whole"], room).alias("snippet"), x["imports"].alias("imports")))

    def cut(whole: Column, left: Column) -> Column:
        marked = left >= len(TRUNCATED)
        room = F.when(marked, left - len(TRUNCATED)).otherwise(left)
        # a prefix of whole characters that fits: count characters while their bytes do
        fits = F.aggregate(
            F.split(whole, ""), F.struct(F.lit(0).alias("bytes"), F.lit(0).alias("chars")),
            lambda s, c: F.struct((s["bytes"] + F.octet_length(c)).alias("bytes"), F.when(s["bytes"] + F.octet_length(c) <= room, s["chars"] + 1).otherwise(s["chars"]).alias("chars")),
        )["chars"]
        return F.when(F.octet_length(whole) <= room, whole).otherwise(F.concat(whole.substr(F.lit(1), fits), F.when(marked, TRUNCATED).otherwise("")))

    return let(lines(content), around)


def line_range(all_lines: Column, start: Column, end: Column) -> Column:
    """Lines start to end, joined; null if the range is no range or starts after the last line."""

    def cut(every: Column) -> Column:
        n = F.size(every)
        last = F.greatest(F.least(end, n), start)
        ok = (start > 0) & (end >= start) & (n > 0) & (start <= n)
        return F.when(ok, F.array_join(F.slice(every, F.greatest(start, F.lit(1)).cast("int"), F.greatest(last - start + 1, F.lit(0)).cast("int")), "\n"))

    return let(all_lines, cut)


def strip_fence(s: Column) -> Column:
    """Without an opening Markdown fence and its line, without a closing fence, trimmed."""
    t = F.regexp_replace(s, r"^\s+|\s+$", "")
    opened = F.when(~t.startswith("```"), t).when(t.contains("\n"), F.regexp_replace(t, r"^```[^\n]*\n", "")).otherwise(t.substr(F.lit(4), F.length(t)))
    return F.regexp_replace(F.regexp_replace(opened, r"\s+$", ""), r"(?s)^\s*(.*?)\s*(?:```)?$", "$1")


def log_line(s: Column) -> Column:
    """At most 200 bytes, then three dots if there was more."""
    return F.when(F.octet_length(s) <= 200, s).otherwise(F.concat(clipped(s, 200), F.lit("...")))
