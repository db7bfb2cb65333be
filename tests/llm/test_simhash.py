"""SimHash classes against all pairs of fingerprints, and fingerprints against plain counting."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from portcullis.llm import simhash as S
from portcullis.llm.common import checkpointed

from .conftest import LONG, ODD


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    """The least number of each row's component, by all pairs."""
    of = list(range(len(prints)))

    def find(i):
        while of[i] != i:
            of[i] = of[of[i]]
            i = of[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 2:
                x, y = find(i), find(j)
                of[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(prints))]


def test_fingerprints_equal_plain_ones(monkeypatch):
    texts = [t for _, t in ODD] + ["A b", "a B c", "One", "É é ÉÉ x", "x " * 9, "a\x0bb\x0cc\rd", "word\xa0same here now"]
    for piece in (S.PIECE, 7, 1):
        monkeypatch.setattr(S, "PIECE", piece)
        for t in texts[: len(texts) if piece > 7 else 4] + texts[len(ODD) :]:
            assert S.fingerprint(None if t is None else t.encode()) == plain_fingerprint(t)


def test_a_text_of_a_million_letters_and_one_of_a_million_words():
    assert S.fingerprint(b"x" * 1_000_000) == plain_fingerprint("x" * 1_000_000)
    assert S.fingerprint(b"ab " * 1_000_000) == xxhash.xxh64_intdigest(b"ab ab ab", 42)


def near_rows():
    """Texts with copies and small edits, so that some fingerprints differ by few bits."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    rows = []
    for _ in range(10):
        base = [word() for _ in range(rng.randint(150, 400))]
        rows.append(" ".join(base))
        for _ in range(12):
            base = base[:]
            base[rng.randrange(len(base))] = word()
            rows.append(" ".join(base))
    rows += [LONG, LONG + " more"]
    return list(enumerate(rows))


@pytest.mark.parametrize("limit", [S.LIMIT, 2])
def test_components_match_all_pairs(spark, documents, limit):
    rows = near_rows() + [(1000 + i, t) for i, t in near_rows()[:5]] + [(2000 + (i or 0), t) for i, t in ODD]
    want = components([plain_fingerprint(t) for _, t in rows])
    found = S.simhash(documents(rows), limit=limit).collect()
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in found) == sorted((k, f"{plain_fingerprint(t):016x}", rows[c][0]) for (k, t), c in zip(rows, want, strict=True))
    assert len(set(want)) < len(rows) - 40


@pytest.mark.parametrize("limit", [S.LIMIT, 3])
def test_links_of_a_ball_and_of_chains(spark, limit):
    """All fingerprints at one bit from a centre, chains of two bits, random ones: variants are cut to the last level."""
    rng = np.random.default_rng(3)
    centre = int(rng.integers(1 << 62))
    prints = {centre} | {centre ^ 1 << i for i in range(64)} | {centre ^ 0xFF ^ 1 << i ^ 1 << j for i in range(8) for j in range(i)}
    for _ in range(20):
        x = int(rng.integers(1 << 62))
        prints.add(x)
        for _ in range(8):
            x ^= 1 << int(rng.integers(64)) | 1 << int(rng.integers(64))
            prints.add(x)
    prints = sorted(prints)
    df = checkpointed(spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long"))
    links = S.near_links(df, limit).distinct().collect()
    assert all(((r["u"] ^ r["v"]) & (1 << 64) - 1).bit_count() <= 2 for r in links)
    of = {p - (1 << 64) if p >> 63 else p: i for i, p in enumerate(prints)}
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for r in links:
        a, b = find(of[r["u"]]), find(of[r["v"]])
        parent[max(a, b)] = min(a, b)
    assert [find(i) for i in range(len(prints))] == components(prints)


def test_groups_hand_on_a_forest():
    members = np.array(sorted({7} | {7 ^ 1 << i for i in range(40)} | {1 << 60}))
    links = S.forest(members)
    assert len(links) == 40 and len({x for e in links for x in e}) == 41


def test_empty_and_null(spark, documents):
    assert S.simhash(documents([])).collect() == []
    rows = [(None, "one two three four"), (None, None), (3, ""), (4, "  \n"), (4, "  \n")]
    found = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in S.simhash(documents(rows)).collect()}
    assert found == {(None, f"{plain_fingerprint(rows[0][1]):016x}", None), (None, "0" * 16, 3), (3, "0" * 16, 3), (4, "0" * 16, 3)}


def test_one_hot_fingerprint(spark, documents):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("a b c d")).otherwise(F.concat(F.lit("t"), F.col("id"), F.lit(" u v w"))).alias("text"))
    found = S.simhash(docs).where("doc_id % 3 = 0").groupBy("component_id").count().collect()
    assert [(r["component_id"], r["count"]) for r in found] == [(0, 10_000)]
