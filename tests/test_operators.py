import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from portcullis import model
from portcullis.functions import text
from portcullis.operators import bindings, candidates, findings, semantic


def test_windows(spark):
    hits = spark.createDataFrame([("a", x) for x in (1, 3, 60, 60)] + [("b", 30), ("b", 51), ("b", 73)], "file string, line bigint")
    got = sorted(tuple(r) for r in candidates.windows(hits).collect())
    assert got == [("a", 1, 18), ("a", 55, 75), ("b", 25, 66), ("b", 68, 88)]


def test_budget_is_in_single_precision():
    assert [candidates.cold_budget(n, 0) for n in (0, 1, 10, 50, 90)] == [0, 1, 3, 16, 28]
    assert candidates.cold_budget(50, 45) == 5 and candidates.cold_budget(50, 50) == 0


def test_closure_of_bindings(spark):
    rng = random.Random(4)
    seeds = [("s1", "a"), ("s2", "x"), ("s3", "q")]
    edges = [("s1", "b", "make(a)"), ("s1", "c", "b.go()"), ("s1", "a", "c"), ("s1", "d", "abc"), ("s2", "y", "f(x1)"), ("s4", "m", "a"), ("s3", "r", "q.x"), ("s3", "s", 'r + "q"')]
    edges += [("s5", f"n{i}", f"n{rng.randrange(40)}()") for i in range(40)]
    seeds.append(("s5", "n0"))

    def close():
        known = set(seeds)
        while True:
            import re

            new = {(s, lhs) for s, lhs, rhs in edges for t, n in known if t == s and re.search(rf"\b{n}\b", rhs)} - known
            if not new:
                return known
            known |= new

    got = bindings.close(spark.createDataFrame(seeds, model.BINDINGS), spark.createDataFrame(edges, model.EDGES))
    assert {tuple(r) for r in got.collect()} == close()


ranges = st.tuples(st.integers(1, 30), st.integers(0, 8), st.sampled_from(model.CONFIDENCES))


@settings(max_examples=200, deadline=None)
@given(st.lists(ranges, max_size=5), st.lists(ranges, max_size=5))
def test_fold_replaces_the_first_that_is_covered(old, new):
    make = lambda kind, xs: [{"id": f"{kind}{i}", "line_start": a, "line_end": a + n, "confidence": c} for i, (a, n, c) in enumerate(xs)]
    entries, arrivals = make("o", old), make("n", new)
    out = semantic.fold(entries, arrivals)
    assert {a["id"] for a in arrivals} >= {x["id"] for x in out if x["id"][0] == "n"}
    if len(arrivals) == 1:
        (s,) = arrivals
        share = lambda e: len(set(range(e["line_start"], e["line_end"] + 1)) & set(range(s["line_start"], s["line_end"] + 1))) / max(e["line_end"] - e["line_start"] + 1, s["line_end"] - s["line_start"] + 1)
        hit = next((i for i, e in enumerate(entries) if share(e) >= 0.5 and model.CONFIDENCES.index(s["confidence"]) >= model.CONFIDENCES.index(e["confidence"])), None)
        assert out == (entries + [s] if hit is None else [*entries[:hit], s, *entries[hit + 1 :]])


def test_merge_is_the_fold_of_each_file(spark):
    rng = random.Random(2)
    rows = lambda kind, n: [(f"{kind}{i}", f"f{rng.randrange(6)}", a := rng.randrange(1, 40), a + rng.randrange(6), rng.choice(model.CONFIDENCES)) for i in range(n)]
    schema = "id string, file string, line_start bigint, line_end bigint, confidence string"
    old, new = rows("o", 60), rows("n", 25)
    dicts = lambda xs, f: sorted((dict(zip(("id", "file", "line_start", "line_end", "confidence"), x, strict=True)) for x in xs if x[1] == f), key=lambda d: (d["line_start"], d["line_end"], d["id"]))
    want = {x["id"] for f in {r[1] for r in old + new} for x in semantic.fold(dicts(old, f), dicts(new, f))}
    assert {r["id"] for r in semantic.merge(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)).collect()} == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aé日\U0001f600 ", max_size=12), min_size=1, max_size=30), st.integers(1, 40), st.integers(0, 9), st.integers(30, 400))
def test_context_keeps_to_its_budget(spark_session, lines, start, more, most):
    content = "\n".join(lines)
    df = spark_session.createDataFrame([(content, start, start + more)], "c string, a bigint, b bigint")
    x = df.select(text.context(F.col("c"), F.col("a"), F.col("b"), most).alias("x"), text.lines(F.col("c")).alias("l")).first()
    every = content.split("\n")
    if every[-1] == "" :
        every = every[:-1]
    assert x["l"] == every
    c = x["x"]
    used = sum(len(i.encode()) + 1 for i in c["imports"])
    assert used <= max(0, int(most * 0.25)) and len(c["snippet"].encode()) <= max(0, most - used)
    if every:
        a = min(max(start, 1), len(every))
        b = min(max(start + more, a), len(every))
        assert (c["line_start"], c["line_end"]) == (max(1, a - 5), min(len(every), b + 15))
        whole = "\n".join(every[c["line_start"] - 1 : c["line_end"]])
        assert c["snippet"] == whole or c["snippet"].removesuffix(text.TRUNCATED) == whole[: len(c["snippet"].removesuffix(text.TRUNCATED))]


def test_text_functions(spark):
    df = spark.createDataFrame([("x",)], "x string")
    one = lambda c: df.select(c.alias("v")).first()["v"]
    assert [one(text.strip_quotes(F.lit(s))) for s in ('"a"', "'b' ", '"c\'', '"', "d")] == ["a", "b", "\"c'", '"', "d"]
    assert one(text.literals(F.lit("""f("it's", 'y')"""), "rego")) == ["it", ", "]
    assert one(text.literals(F.lit("""f("it's", 'y')"""), "cedar")) == ["it's", "y"]
    assert one(text.numbered(F.lit("a\nb\n"), F.lit(9999))) == "9999: a\n10000: b\n" and one(text.numbered(F.lit(""), F.lit(1))) == "\n"
    assert [one(text.strip_fence(F.lit(s))) for s in ("```json\n{}\n```", " {} ", "```{}```", "x ```")] == ["{}", "{}", "{}", "x"]
    assert one(text.log_line(F.lit("é" * 150))) == "é" * 100 + "..." and one(text.log_line(F.lit("abc"))) == "abc"
    assert [one(text.percent(F.lit(a), F.lit(b))) for a, b in ((0, 0), (1, 7), (1, 2), (3, 0))] == [0, 13, 33, 100]
    assert one(text.by_confidence(F.lit("a\n\n# b"), F.lit("low"), "rego")) == "# SUGGESTION: review and uncomment if correct\n# a\n\n# b"
    assert one(text.render(F.lit("{{a}} {{b}} {{c}}"), {"a": F.lit("'x'"), "b": F.lit('"y"'), "c": F.lit(None).cast("string")}, ("b",))) == 'x "y" {{c}}'


def test_first_of_each_keeps_the_first_match(spark):
    df = spark.createDataFrame([("i", 2, 0, "c"), ("i", 1, 5, "b"), ("i", 1, 3, "a"), ("j", 9, 9, "d")], "id string, rule_ord int, match_seq int, v string")
    assert sorted(r["v"] for r in findings.first_of_each(df).collect()) == ["a", "d"]
