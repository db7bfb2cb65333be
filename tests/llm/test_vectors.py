"""Whitening against numpy over the whole list, hard negatives against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from portcullis.llm import hard_negatives as H
from portcullis.llm import vectors
from portcullis.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int, n int, x string, key string, query string, cluster string, component string, __row long"


def frame(spark, rows, kind="float"):
    """rows of (vec_id, embedding, label), and columns whose names clash with inner ones."""
    return spark.createDataFrame([(*r, 1, "x", "k", "q", "c", "d", 5) for r in rows], SCHEMA.replace("<float>", f"<{kind}>"))


def odd(d):
    return [(900_001, None, 1), (900_002, [0.5] * (d - 1) + [None], 1), (900_003, [float("nan")] * d, 1), (900_004, [float("inf")] + [0.1] * (d - 1), 2), (900_005, [0.1] * (d - 1) + [float("-inf")], 2)]


def random_rows(n, d, seed, copies=0):
    rng = np.random.default_rng(seed)
    x = (rng.normal(size=(n, d)) * np.linspace(0.3, 0.1, d)).astype(np.float32)
    if copies:
        x[rng.choice(n, copies, replace=False)] = x[0]
    return [(i, [float(c) for c in v], int(rng.integers(4))) for i, v in enumerate(x)]


def plain_whitening(rows):
    x = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v, _ in rows])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    centred = (n * fit - s) / n
    v = centred.T @ centred / n
    e, w = np.linalg.eigh(v)
    e, w = e[::-1][:16], w[:, ::-1][:, :16]
    return n, ((n * x - s) ** 2).sum(1), ((n * x - s) / n) @ w / np.sqrt(e), e / np.trace(v)


@pytest.mark.parametrize("d", [5, 70])
def test_whitening_equals_numpy(spark, d):
    rows = random_rows(700, d, d, copies=200)
    found = W.whiten(frame(spark, rows + odd(d)).repartition(5)).collect()
    n, deviation, white, explained = plain_whitening(rows)
    k = min(16, d)
    assert len(found) == 700 * k and {r["n"] for r in found} == {n} and n == len({tuple(v) for _, v, _ in rows})
    signs: dict[int, float] = {}
    for r in found:
        c, want = r["component"] - 1, white[r["vec_id"], r["component"] - 1]
        if abs(want) > 1e-3:
            assert signs.setdefault(c, np.sign(want * r["whitened"])) == np.sign(want * r["whitened"])
        assert abs(abs(r["whitened"]) - abs(want)) < 1e-9
        assert r["deviation"] == deviation[r["vec_id"]]
        assert abs(r["explained"] / explained[c] - 1) < 1e-9
    assert {r["identity_error"] for r in found} == {found[0]["identity_error"]} and found[0]["identity_error"] < 1e-9


def test_tiles_of_several_row_blocks_and_held_tiles(spark, monkeypatch):
    monkeypatch.setattr(W, "BLOCK_ROWS", 64)
    monkeypatch.setattr(W, "HELD", 2)
    rows = random_rows(1000, 75, 1)
    found = {(r["vec_id"], r["component"]): r["whitened"] for r in W.whiten(frame(spark, rows).repartition(3)).collect()}
    white = plain_whitening(rows)[2]
    assert max(abs(abs(v) - abs(white[i, c - 1])) for (i, c), v in found.items()) < 1e-9


def test_whitening_of_odd_tables(spark):
    columns = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for rows in ([], odd(3), [(1, [], 0)], [(1, [0.5, 0.25], 0)] * 4):
        found = W.whiten(frame(spark, rows))
        assert found.columns == columns and found.collect() == []
    # one direction without variance, a short vector, a null key, the same row twice
    rows = [(1, [0.5, 0.25, 0.0], 0), (None, [0.75], 0), (3, [0.125, 1.5, 0.0], 1), (3, [0.125, 1.5, 0.0], 1)]
    found = W.whiten(frame(spark, rows)).collect()
    assert {(r["vec_id"], r["component"]) for r in found} == {(i, c) for i in (1, None, 3) for c in (1, 2)} and len(found) == 8
    assert {r["n"] for r in found} == {3} and found[0]["identity_error"] < 1e-9


def test_whitening_of_large_numbers_is_exact_or_null(spark):
    rows = [(i, [float(2**40 + i), float(i)], 0) for i in range(5)] + [(9, [1e300, -1e300], 0)]
    found = W.whiten(frame(spark, rows, "double")).collect()
    x = [[min(64 * int(v[0]), 1 << 44) + 1_000_000 if v[0] < 1e300 else (1 << 44) + 1_000_000, 64 * int(v[1]) + 1_000_000 if abs(v[1]) < 1e300 else -(1 << 44) + 1_000_000] for _, v, _ in rows]
    s = [sum(y[j] for y in x) for j in range(2)]
    for r in found:
        want = sum((6 * x[min(r["vec_id"], 5)][j] - s[j]) ** 2 for j in range(2))
        assert r["deviation"] == (want if want < 1 << 63 else None)


def test_exact_products():
    for most in (100, 1 << 25, (1 << 31) - 1):
        rng = np.random.default_rng(most)
        a, b = rng.integers(-most, most + 1, (5, 40)), rng.integers(-most, most + 1, (6, 40))
        b[0] = a[0]
        want = [[min(max(sum(int(p) * int(q) for p, q in zip(u, v, strict=True)), -(1 << 63)), (1 << 63) - 1) for v in b] for u in a]
        assert vectors.products(a, b).tolist() == want


def plain_mining(rows, label_of=lambda k, y: y, anchor=lambda k: k % 100 == 0):
    """By all pairs; rows are told apart by their place."""
    d = max((len(v) for _, v, _ in rows if v), default=0)
    ok = [(k, [int(np.floor(256 * c)) for c in v] + [0] * (d - len(v)), label_of(k, y)) for k, v, y in rows if k is not None and y is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    out = []
    for i, (a, x, y) in enumerate(ok):
        if not anchor(a):
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, v, strict=True)), k, j) for j, (k, v, _) in enumerate(ok) if j != i)
        positives = [(p, -s) for s, p, j in scored if ok[j][2] == y][:5]
        for p, ps in positives:
            fits = [(k, -s) for s, k, j in scored if ok[j][2] != y and 80 * ps <= -100 * s <= 100 * ps][:5]
            out += [(a, p, r + 1, k, ps, ns) for r, (k, ns) in enumerate(fits)]
    return sorted(out)


def mined(df, **options):
    return sorted(map(tuple, H.mine(df, **options).collect()))


@pytest.mark.parametrize("seed", range(3))
def test_mining_equals_all_pairs(spark, seed, monkeypatch):
    monkeypatch.setattr(H, "BLOCK_BYTES", 400)
    monkeypatch.setattr(H, "CHUNK", 5)
    monkeypatch.setattr(H, "FIRST", 2)
    monkeypatch.setattr(H, "GROW", 2)
    rng = random.Random(seed)
    rows = random_rows(600, 6, seed, copies=150 * seed)
    rows = [(k, [round(c * 8) / 8 for c in v] if seed else v, y) for k, v, y in rows]  # many ties
    rows += odd(6) + [(None, [0.1] * 6, 1), (700, [0.2] * 6, None), (800, [0.2] * 3, 1), (100, rows[100][1], rows[100][2])]
    rng.shuffle(rows)
    plain = lambda k, y: (y + 1) % 10 if k % 7 == 0 else y
    assert mined(frame(spark, rows).repartition(4), label_of=H.relabelled, clusters=12) == plain_mining(rows, plain)


def test_lists_are_skipped_and_the_result_stays(spark, monkeypatch):
    """Tight clusters far from each other: fewer lists are visited than there are, and nothing is lost."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 8))
    rows = [(i, [float(c) for c in centres[i % 20] + rng.normal(size=8) * 0.01], int(rng.integers(3))) for i in range(800)]
    monkeypatch.setattr(H, "FIRST", 2)
    assert mined(frame(spark, rows), clusters=20) == plain_mining(rows)
    rows_ = H.checkpointed(frame(spark, rows).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").alias("key"), F.col("label").cast("long").alias("label"), vectors.floors("embedding", 256, H.MOST, "int").alias("x")))
    ix = H.index(rows_, 8, 20)
    asked = rows_.where("key % 100 = 0").select(F.col("row").alias("query"), "row", "label", "x", F.array(F.struct(F.lit(-(1 << 63)).cast("long").alias("low"), F.lit((1 << 63) - 1).cast("long").alias("high"))).alias("windows"))
    chunks = H.chunked(asked, ix).withColumn("kth", F.lit(None).cast("array<struct<query: long, window: int, score: long>>"))
    batches = chunks.drop("chunk").toArrow().to_batches()
    first = [x for b in H._visits(ix.centroids, ix.radius, ix.count > 0, 0, 2, batches) for x in b.to_pylist()]
    assert any(x["cluster"] is None for x in first)
    best = H.search(ix, asked, True).where("rank = 5").select("query", "window", "score").collect()
    known = chunks.withColumn("kth", F.array(*[F.struct(F.lit(r["query"]).alias("query"), F.lit(r["window"]).alias("window"), F.lit(r["score"]).alias("score")) for r in best]))
    after = [x for b in H._visits(ix.centroids, ix.radius, ix.count > 0, 2, 20, known.drop("chunk").toArrow().to_batches()) for x in b.to_pylist()]
    assert len(after) < 18  # lists whose bound is below every query's fifth score aren't visited


def test_mining_of_odd_tables(spark):
    for rows in ([], odd(4), [(100, [], 1)], [(100, [0.5, 0.5], 1)], [(100, [0.5, 0.5], 1), (101, [0.5, 0.25], 1)], [(100, [0.5], 1), (101, [-0.5], 1), (102, [0.5], 2)]):
        assert mined(frame(spark, rows)) == plain_mining(rows)
    big = [(100, [3e38, 1.0], 1), (101, [3e38, 2.0], 1), (102, [3e38, 1.5], 2)]
    m = (1 << 31) - 1
    assert mined(frame(spark, big)) == [(100, 101, 1, 102, m * m + 256 * 512, m * m + 256 * 384)]


def test_a_vector_that_a_third_of_all_rows_repeats(spark):
    df = spark.range(6_000).select(F.col("id").alias("vec_id"), F.when(F.col("id") % 3 == 0, F.array(F.lit(0.5), F.lit(0.5))).otherwise(F.array(F.rand(1), F.rand(2))).alias("embedding"), (F.col("id") % 5).cast("int").alias("label"))
    rows = [(r["vec_id"], list(r["embedding"]), r["label"]) for r in df.collect()]
    anchors = lambda k: k % 1000 == 0
    assert mined(df, anchors=anchors) == plain_mining(rows, anchor=anchors)
