"""Near-duplicates, decontamination and the pipeline against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from portcullis.llm import bag_minhash as N
from portcullis.llm import decontaminate as D
from portcullis.llm.license_scan import words

from .conftest import ODD


def bag(text):
    w = words(text)
    k = min(5, len(w))
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else Counter()


def near_brute(rows):
    """The class of each row, as the index of its first row, by all pairs."""
    bags = [bag(t) for _, t in rows]
    of = list(range(len(rows)))

    def find(i):
        while of[i] != i:
            i = of[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            shared = sum((bags[i] & bags[j]).values())
            if shared and shared >= 0.8 * (sum(bags[i].values()) + sum(bags[j].values()) - shared):
                a, b = find(i), find(j)
                of[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(rows))]


def made(seed=5):
    """Copies, near copies in chains and stars, repeated words, texts that share a long passage."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    text = lambda n: [word() for _ in range(n)]
    rows, passage = [], text(60)
    for _ in range(12):
        base = text(rng.randint(40, 300))
        rows.append(base)
        for _ in range(rng.randint(0, 6)):
            near = base[:]
            for _ in range(rng.randint(0, len(near) // 40)):
                near[rng.randrange(len(near))] = word()
            rows.append(near)
            if rng.random() < 0.5:
                base = near
    rows += [passage + text(rng.randint(4, 40)) for _ in range(20)]
    rows += [["echo"] * n for n in (30, 33, 60, 62, 500)]
    rows += [text(3), text(3)] * 2
    out = [(i, " ".join(r).replace(" e", "\nE", 1)) for i, r in enumerate(rows)]
    return out + [(1000 + i, t) for i, (_, t) in enumerate(out[:5])] + ODD


def test_classes_match_brute_force(spark, documents):
    rows = made()
    found = N.near_duplicates(documents(rows)).collect()
    first = near_brute(rows)
    size = Counter(first)
    key = {}
    for (k, _), f in zip(rows, first, strict=True):
        key[f] = min(key.get(f, 10**9), 10**9 - 1 if k is None else k)
    want = Counter((k, None if key[f] == 10**9 - 1 else key[f], size[f]) for (k, _), f in zip(rows, first, strict=True))
    assert Counter((r["doc_id"], r["class_id"], r["class_size"]) for r in found) == want
    assert sum(r["kept"] for r in found) == len(size)
    docs = documents(rows)
    kept = N.drop_near(docs)
    assert kept.columns == docs.columns and kept.count() == len(size)
    assert N.near_duplicates(documents([])).collect() == []


def test_a_link_that_no_centre_sees_is_found(spark, documents, monkeypatch):
    """Two texts are near each other but not near the first of their buckets; the rest step must join them."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    a = base[:]
    for i in range(0, 400, 28):  # 0.6 to 0.7 from the base
        a[i] = f"a{i}"
    b = a[:]
    b[5], b[200] = "b5", "b200"
    rows = [(1, " ".join(base)), (2, " ".join(a)), (3, " ".join(b))]
    assert near_brute(rows) == [0, 1, 1]
    assert {r["doc_id"]: r["class_id"] for r in N.near_duplicates(documents(rows)).collect()} == {1: 1, 2: 2, 3: 2}


def test_signatures_estimate_weighted_jaccard_without_bias():
    rng = np.random.default_rng(4)
    errors = []
    for _ in range(150):
        e = rng.integers(1, 2**63, 60).astype(np.uint64)
        w = [rng.integers(0, 12, 60) * (rng.random(60) < 0.8) for _ in range(2)]
        keep = [x > 0 for x in w]
        true = np.minimum(*w).sum() / np.maximum(*w).sum()
        h = N.signatures(np.concatenate([e[k] for k in keep]), np.concatenate([x[k] for x, k in zip(w, keep, strict=True)]), np.repeat([0, 1], [k.sum() for k in keep]), 2)
        errors.append((h[0] == h[1]).mean() - true)
    assert abs(np.mean(errors)) < 0.012


def test_a_text_has_the_same_signature_in_any_group():
    texts = [t for _, t in made()]
    bags = [N.bag(t) for t in texts if len(N.shingles(t))]
    size = [len(b[0]) for b in bags]
    all_ = N.signatures(np.concatenate([b[0] for b in bags]), np.concatenate([b[1] for b in bags]), np.repeat(np.arange(len(bags)), size), len(bags))
    for i in (0, 3, len(bags) - 1):
        assert (N.signatures(*bags[i], np.zeros(size[i], int), 1)[0] == all_[i]).all()


def test_shingle_bags_equal_tuples():
    for _, text in made():
        e, w = N.bag(text)
        assert sorted(w.tolist()) == sorted(bag(text).values())


ITEMS = [(1, "What is the colour of the sky on a clear day at noon\nanswer: a deep and even blue"), (2, "short item"), (3, None), (4, " ".join(f"long{i}" for i in range(300))), (2, "short item"), (5, "the of and to in is it that for on as with was")]


def plain_edits(part, text):
    """Words to replace, drop or put in to make part a stretch of text, by the table of all prefixes."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(part, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def leaks_brute(items, rows):
    out = Counter()
    for key, text in rows:
        w = words(text)
        for item, t in sorted(set(items), key=str):
            question, answer = D.parts(t)
            if not question + answer:
                continue
            shares = []
            for part in (question, answer):
                k = min(5, max(1, len(part)))
                g = D.grams(part, k)
                there = set(w)
                aligned = 1 - plain_edits(part, w) / len(part) if part and sum(x in there for x in part) >= len(part) / 2 else 0
                shares.append(max(len(g & D.grams(w, k)) / len(g), aligned) if g else 1.0)
            if shares[0] >= D.QUESTION and shares[1] >= D.ANSWER:
                out[(key, item)] += 1
    return out


@pytest.mark.parametrize("shard", [D.SHARD, 10])
def test_leaks_match_brute_force(spark, documents, monkeypatch, shard):
    monkeypatch.setattr(D, "SHARD", shard)
    rng = random.Random(3)
    filler = lambda n: " ".join(rng.choice(["tree", "river", "stone", "the", "of", "cloud", "and"]) for _ in range(n))
    full = ITEMS[0][1].replace("\n", " ").replace("answer: ", "")
    rows = [
        (1, filler(500) + " " + ITEMS[0][1] + " " + filler(90)), (2, filler(63) + " " + full.upper()), (3, filler(300)), (4, ITEMS[3][1]), (4, ITEMS[3][1]),
        (5, " ".join(ITEMS[3][1].split()[:100])), (6, "a short item here"), (7, full.replace("clear", "cloudy").replace("noon", "night")),
    ]
    rows = [(i + 100, t) for i, t in rows] + ODD
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, score string")
    docs = documents(rows)
    found = D.find_leaks(docs, benchmark)
    assert Counter((r["doc_id"], r["item_id"]) for r in found.select("doc_id", "item_id").distinct().collect()) == Counter(set(leaks_brute(ITEMS, rows)))
    clean = D.drop_leaks(docs, benchmark)
    assert clean.columns == docs.columns
    hit = {k for k, _ in leaks_brute(ITEMS, rows)}
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(str(k) for k, _ in rows if k not in hit)
    assert D.find_leaks(docs, benchmark.limit(0)).collect() == []
    assert D.find_leaks(documents([]), benchmark).collect() == []


def test_edits_equal_the_whole_table():
    rng = random.Random(12)
    for _ in range(1500):
        part, text = [[rng.choice("abcd").encode() for _ in range(n)] for n in (rng.randint(1, 9), rng.randint(0, 14))]
        assert D.edits(part, text) == plain_edits(part, text)
    long = [str(rng.randrange(30)).encode() for _ in range(200)]
    assert D.edits(long, [b"x", *long[:90], *long[91:150], b"y", *long[150:], b"z"]) == 2 and D.edits(long, []) == 200


def test_edited_copies_of_every_item_are_found(spark):
    """One and two words replaced, dropped or put in, anywhere in the item, in a text of 400 other words."""
    from portcullis.llm.common import table

    sf = "/root/testdata/sf0.1"
    benchmark, rng = table(spark, sf, "benchmark"), random.Random(7)
    items = [(r["item_id"], r["text"].split()) for r in benchmark.collect()]
    vocabulary = [w for r in table(spark, sf, "documents").limit(500).collect() for w in (r["text"] or "").split()]
    more = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    rows, k = [], 0
    for kind in ("replace", "drop", "insert"):
        for edits in (1, 2):
            for item, text in items:
                w = text[:]
                for _ in range(edits):
                    j = rng.randrange(len(w))
                    w[j : j + (kind != "insert")] = more(1) if kind != "drop" else []
                rows.append((k * 1000 + item, " ".join(more(200) + w + more(200))))
            k += 1
    rows += [(100_000 + i, " ".join(more(400))) for i in range(300)]
    found = D.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect()
    right = {r["doc_id"] for r in found if r["doc_id"] % 1000 == r["item_id"] and r["doc_id"] < 100_000}
    for case in range(k):
        assert sum(case * 1000 <= d < (case + 1) * 1000 for d in right) >= 0.9 * len(items)
    assert not [r for r in found if r["doc_id"] >= 100_000 or r["doc_id"] % 1000 != r["item_id"]]


def test_wand_returns_all_segments_above_the_threshold():
    rng = random.Random(8)
    vocabulary = [f"t{i}".encode() for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary).decode() for _ in range(rng.randint(3, 40)))) for i in range(150)]
    frequency = Counter(w for _, t in items for w in set(words(t)))
    index = D.Index(items, frequency, len(items), 20.0)
    dense = np.zeros((len(index.vocabulary) + 1, len(items)))
    for t in range(1, len(index.start) - 1):
        at = slice(index.start[t], index.start[t + 1])
        dense[t, index.segment[at]] = index.impact[at]
    for _ in range(30):
        ids = np.array([index.vocabulary.get(rng.choice(vocabulary), 0) for _ in range(rng.randint(1, 400))])
        got = {(a, s) for a, s, _ in index.retrieve(ids)}
        want = set()
        for a in range(0, max(1, len(ids) - D.STRIDE), D.STRIDE):
            total = dense[np.unique(ids[a : a + D.WINDOW])].sum(0)
            want |= {(a, int(s)) for s in np.flatnonzero(total >= D.SCORE)}
        assert want <= got and all(dense[np.unique(ids[a : a + D.WINDOW])].sum(0)[s] >= D.SCORE - 1e-6 for a, s in got)


def test_pipeline_keeps_what_the_stages_keep_one_by_one(spark):
    """On the smallest tables: each stage against brute force over what its predecessor kept."""
    sf = "/root/testdata/sf0.001"
    from portcullis.llm import quality_gam as Q
    from portcullis.llm.common import fold, table

    docs = table(spark, sf, "documents")
    rows = {r["doc_id"]: r for r in docs.collect()}
    model = Q.fit(docs, table(spark, sf, "labels").where(fold("doc_id", 5) != 0))
    kept = sorted(i for i, r in rows.items() if model.score(np.array([Q.features(r["text"])]))[0] >= Q.THRESHOLD)
    best = {}
    for i in kept:
        norm = "".join(c for c in rows[i]["text"] or "" if c not in " \t\n\x0b\x0c\r")
        best[norm] = min(best.get(norm, (0, 10**9)), (-len(rows[i]["text"] or ""), i))
    kept = sorted(i for _, i in best.values())
    pairs = [(i, rows[i]["text"]) for i in kept]
    first = near_brute(pairs)
    kept = sorted({pairs[f][0] for f in first})
    items = [(r["item_id"], r["text"]) for r in table(spark, sf, "benchmark").collect()]
    hit = {k for k, _ in leaks_brute(items, [(i, rows[i]["text"]) for i in kept])}
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(r["doc_id"] for r in out.collect()) == [i for i in kept if i not in hit]
