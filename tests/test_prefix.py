"""Prefix sums, islands, folds, routing and closure where one file, package or scope has all rows, over many tasks."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from portcullis import model, tiers
from portcullis.operators import bindings, candidates, findings, prefix, semantic


@pytest.fixture(autouse=True, scope="module")
def many_tasks(spark):
    """Small tables keep their partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_before_equals_running_values(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "a", "b", None, f"c{i % 50}"]), i, rng.randrange(100)) for i in range(4000)]
    df = spark.createDataFrame(rows, "k string, i int, v int").repartition(7)
    for by in (["k"], []):
        dealt = prefix.ranged(df, by, ["i"])
        assert dealt.select(prefix.PART).distinct().count() == 4
        got = {r["i"]: (r["s"], r["m"]) for r in prefix.before(dealt, by, ["i"], s=("sum", F.col("v")), m=("max", F.col("v"))).collect()}
        now = {}
        for k, i, v in rows:
            seen = now.setdefault(k if by else 0, [])
            assert got[i] == ((sum(seen), max(seen)) if seen else (None, None))
            seen.append(v)
    assert [r["place"] for r in prefix.places(df, ["i"]).orderBy("i").collect()] == list(range(1, 4001))
    assert prefix.places(df.limit(0), ["i"]).collect() == []


def test_no_window_runs_over_a_whole_table(spark):
    calls = spark.range(1000).select(F.col("id").alias("seq"), F.lit(1000).alias("input_tokens"), F.lit(0).alias("output_tokens"))
    kept = semantic.within_cost(calls, 3.0, 15.0, 1000.0, ("seq",))
    assert [r["seq"] for r in kept.orderBy("seq").collect()] == list(range(334))
    plan = semantic.within_cost(calls, 3.0, 15.0, 1000.0, ("seq",))._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and prefix.PART in plan


@pytest.fixture(scope="module")
def hot(spark):
    """A file with 300,000 hits, and a few others."""
    rng = np.random.default_rng(2)
    lines = np.unique(np.concatenate([rng.integers(1, 4_000_000, 250_000), np.arange(1_000_000, 1_050_000)]))
    df = spark.createDataFrame([(int(x),) for x in lines], "line long").repartition(6).withColumn("file", F.lit("hot")).unionByName(spark.createDataFrame([(3, "b"), (60, "b")], "line long, file string"))
    return lines, df


def test_islands_of_one_file_lie_in_many_tasks(spark, hot):
    lines, df = hot
    heads = np.flatnonzero(np.concatenate([[True], np.diff(lines) > candidates.BEFORE + candidates.AFTER + 1]))
    last = np.concatenate([heads[1:] - 1, [len(lines) - 1]])
    found = candidates.windows(df)
    assert sorted((r["line_start"], r["line_end"]) for r in found.where("file = 'hot'").collect()) == [(max(1, int(lines[a]) - 5), int(lines[b]) + 15) for a, b in zip(heads, last, strict=True)]
    assert sorted(tuple(r) for r in found.where("file = 'b'").collect()) == [("b", 1, 18), ("b", 55, 75)]
    taken = df.where("file = 'hot'").select("file", (F.col("line") + 16).alias("line_start"), (F.col("line") + 16 + F.col("line") % 3).alias("line_end"))
    regions = df.where("file = 'hot'").select("file", F.col("line").alias("line_start"), (F.col("line") + 2).alias("line_end"))
    starts, ends = np.sort(lines + 16), np.maximum.accumulate(lines + 16 + lines % 3)
    at = np.searchsorted(starts, lines + 2, side="right")
    free = np.where(at == 0, True, ends[np.maximum(at - 1, 0)] < lines)
    assert sorted(r["line_start"] for r in candidates.clear_of(regions, taken).collect()) == lines[free].tolist()


def test_merge_of_one_file_with_many_ranges(spark):
    """150,000 ranges of one file, in runs of all sizes."""
    rng = random.Random(3)
    schema = "id string, file string, line_start bigint, line_end bigint, confidence string"
    rows = lambda kind, n: [(f"{kind}{i}", "hot", a := rng.randrange(1, 900_000), a + rng.randrange(8), rng.choice(model.CONFIDENCES)) for i in range(n)]
    old, new = rows("o", 100_000) + [(f"p{i}", "hot", 10**6, 10**6 + i, "low") for i in range(300)], rows("n", 50_000) + [(f"q{i}", "hot", 10**6 + i, 10**6 + 2 * i, "medium") for i in range(200)]
    order = lambda xs: sorted((dict(zip(("id", "file", "line_start", "line_end", "confidence"), x, strict=True)) for x in xs), key=lambda d: (d["line_start"], d["line_end"], d["id"]))
    want = sorted((x["id"], x["line_start"], x["line_end"], x["confidence"]) for x in semantic.fold(order(old), order(new)))
    merged = semantic.merge(spark.createDataFrame(old, schema).repartition(6), spark.createDataFrame(new, schema))
    assert sorted(tuple(r) for r in merged.select("id", "line_start", "line_end", "confidence").collect()) == want


NAMES = ["gate", "a.b", "$user", "x$y", "né", "ab", "_u", "r[0]", "$", "a b"]
SNIPPETS = ["gate(x)", "Gate", "gates", "z.gate.z", "a.b()", "a.bc", "xa.b", "$user", "f($user)", "q$user", "x$y", "x$yz", "né!", "née", "r[0]", "r[0]x", "r[01]", "a$b", "a b", "ab", "", None, "_u + 1", "__u"]


@pytest.mark.parametrize("most", [tiers.BROADCAST, 0])
def test_routing_equals_one_pattern_for_each_scope(spark, most, monkeypatch):
    monkeypatch.setattr(tiers, "BROADCAST", most)
    monkeypatch.setattr(tiers, "LARGE", 3)
    monkeypatch.setattr(findings, "BROADCAST", most)
    bound = [("s", n) for n in NAMES] + [("t", "gate"), ("t", "gate")] + [("big", f"name{i}") for i in range(100_000)]
    matches = [(i, s, t, False) for i, (s, t) in enumerate([(s, t) for s in ("s", "t", "u", None) for t in SNIPPETS] + [("big", f"check(name{i * 7})") for i in range(300)] + [("big", f"check(other{i})") for i in range(300)])]
    matches += [(9000 + i, "s", "gate(x)", False) for i in range(50)] + [(9999, "u", "zzz", True)]
    routed = findings.route(spark.createDataFrame(matches, "i int, scope string, code_snippet string, externalized boolean"), spark.createDataFrame(bound, model.BINDINGS))
    assert routed.columns == ["i", "scope", "code_snippet", "externalized", "enforced"]
    small = {s: re.compile(r"\b(?:" + "|".join(re.escape(n) for k, n in bound if k == s and n != "$") + r")\b") for s in ("s", "t")}
    many = {f"check(name{i})" for i in range(100_000)}
    want = {i: e or t is not None and (t in many if s == "big" else s in small and small[s].search(t) is not None) for i, s, t, e in matches}
    assert {r["i"]: r["enforced"] for r in routed.collect()} == want and len(want) == len(matches)


def closed(seeds, edges):
    known = set(seeds)
    todo = list(known)
    onward = {}
    for s, lhs, rhs in edges:
        for w in re.findall(r"\w+", rhs):
            onward.setdefault((s, w), set()).add((s, lhs))
    while todo:
        for x in onward.get(todo.pop(), ()):
            if x not in known:
                known.add(x)
                todo.append(x)
    return known


@pytest.mark.parametrize("local", [bindings.LOCAL, 0, 60])
def test_closure_of_chains_circles_and_webs(spark, local, monkeypatch):
    monkeypatch.setattr(bindings, "LOCAL", local)
    rng = random.Random(6)
    seeds = [("c", "n0"), ("web", "w0"), ("tree", "t0"), ("circle", "x"), ("two", "a"), ("none", "q")]
    edges = [("c", f"n{i + 1}", f"n{i}") for i in range(70)] + [("c", f"m{i}", f"m{(i + 1) % 9}") for i in range(9)] + [("c", "behind", "m0"), ("c", "n5", "n4()")]
    edges += [("web", f"w{rng.randrange(60)}", f"f(w{rng.randrange(60)}, w{rng.randrange(60)})") for _ in range(80)]
    edges += [("tree", f"t{i}", f"t{(i - 1) // 2}") for i in range(1, 127)] + [("tree", "u", "v"), ("tree", "v", "w"), ("tree", "t3", "t3")]
    edges += [("circle", "y", "x + z"), ("circle", "z", "y"), ("circle", "x", "z"), ("two", "b", "a.c"), ("other", "b", "a"), ("none", "r", "s")]
    got = bindings.close(spark.createDataFrame(seeds, model.BINDINGS), spark.createDataFrame(edges, model.EDGES)).collect()
    assert {tuple(r) for r in got} == closed(seeds, edges) and len(got) == len({tuple(r) for r in got})


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    monkeypatch.setattr(bindings, "LOCAL", 0)
    rounds = []
    inner = bindings.checkpointed
    monkeypatch.setattr(bindings, "checkpointed", lambda df: rounds.append(1) or inner(df))
    edges = spark.range(1000).select(F.lit("s").alias("scope"), F.concat(F.lit("n"), F.col("id") + 1).alias("lhs"), F.concat(F.lit("n"), F.col("id")).alias("rhs"))
    assert bindings.close(spark.createDataFrame([("s", "n0")], model.BINDINGS), edges).count() == 1001
    assert len(rounds) <= 11 + 10  # ten doublings, and what is written before and after them


def test_first_of_each_is_cut_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("id"), F.col("id").alias("rule_ord"), F.lit(0).alias("match_seq"))
    assert findings.first_of_each(df)._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") == 2
