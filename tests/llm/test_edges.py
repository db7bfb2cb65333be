"""Hot groups, repeated and missing keys, long conversations, odd tables, and whole models against plain versions."""

import bisect
import math
import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from portcullis.llm import bag_minhash as N
from portcullis.llm import chat_format as C
from portcullis.llm import common, queries
from portcullis.llm import decontaminate as D
from portcullis.llm import exact_dedup as X
from portcullis.llm import language_id as L
from portcullis.llm import quality_gam as Q
from portcullis.llm import url_filter as U
from portcullis.llm.common import checkpointed, fold, join_groups, table

from .conftest import CLASHES, ODD
from .test_exact import ROWS, brute
from .test_near import bag, made, near_brute

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("tier", "large"), [(100_000, 2_000), (2, 1), (50, 3)])
def test_groups_meet_their_rows_in_any_tier(spark, monkeypatch, tier, large):
    monkeypatch.setattr(common, "TIER", tier)
    monkeypatch.setattr(common, "LARGE", large)
    rows = [(i, "hot" if i % 3 == 0 else f"k{i % 40}" if i % 3 == 1 else f"one{i}") for i in range(600)] + [(1000, None)]
    df = checkpointed(spark.createDataFrame(rows, "i long, k string"))
    groups = checkpointed(df.where("k is not null").groupBy("k").count())
    size = Counter(k for _, k in rows)
    assert sorted(tuple(r) for r in join_groups(df, groups, "k", "count").select("i", "k", "count").collect()) == sorted((i, k, size[k]) for i, k in rows if k is not None)
    assert join_groups(df, groups.limit(0), "k", "count").collect() == []


def test_exact_and_near_groups_in_small_tiers(spark, documents, monkeypatch):
    monkeypatch.setattr(common, "TIER", 4)
    monkeypatch.setattr(common, "LARGE", 1)
    monkeypatch.setattr(X, "HEAVY", 1)
    monkeypatch.setattr(N, "CELL", 3)
    assert Counter(tuple(r) for r in X.exact_dedup(documents(ROWS)).collect()) == brute(ROWS)
    rows = made(seed=11)
    first = near_brute(rows)
    size = Counter(first)
    assert Counter((r["doc_id"], r["class_size"]) for r in N.near_duplicates(documents(rows)).collect()) == Counter((k, size[f]) for (k, _), f in zip(rows, first, strict=True))


def test_near_classes_of_a_given_table_are_those_of_all_links(spark):
    """Recall: every pair of sf0.01's documents that shares a shingle, by brute force."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect()]
    bags = [bag(t) for _, t in rows]
    places: dict = {}
    for i, b in enumerate(bags):
        for s in b:
            places.setdefault(s, []).append(i)
    pairs = {(i, j) for p in places.values() for k, i in enumerate(p) for j in p[k + 1 :]}
    of = list(range(len(rows)))

    def find(i):
        while of[i] != i:
            i = of[i]
        return i

    links = 0
    for i, j in pairs:
        shared = sum((bags[i] & bags[j]).values())
        if shared >= 0.8 * (sum(bags[i].values()) + sum(bags[j].values()) - shared):
            links += 1
            a, b = find(i), find(j)
            of[max(a, b)] = min(a, b)
    assert links > 50
    want = {rows[i][0]: rows[find(i)][0] for i in range(len(rows))}
    assert {r["doc_id"]: r["class_id"] for r in N.near_duplicates(docs).collect()} == want


def test_items_without_ids_and_with_text_ids(spark, documents):
    long = [" ".join(f"{c}{i}" for i in range(40)) for c in "abc"]
    docs = documents([(1, long[0]), (2, "x " + long[1]), (3, long[2]), (4, "clean")])
    for kind, ids in (("string", ["q-1", None, None]), ("long", [7, None, None]), ("string", ["same", "same", "other"])):
        bench = spark.createDataFrame(list(zip(ids, long, strict=True)), f"item_id {kind}, text string")
        found = D.find_leaks(docs, bench)
        assert dict(found.dtypes)["item_id"] == {"long": "bigint"}.get(kind, kind)
        assert sorted(((r["doc_id"], r["item_id"]) for r in found.collect()), key=str) == sorted(zip((1, 2, 3), ids, strict=True), key=str)
        assert [r["doc_id"] for r in D.drop_leaks(docs, bench).collect()] == [4]


def test_leaks_over_several_shards(spark, documents, monkeypatch):
    monkeypatch.setattr(D, "SHARD", 50)
    long = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcdef"]
    docs = documents([(i, f"x {t} y") for i, t in enumerate(long)] + [(9, "clean")])
    bench = spark.createDataFrame([(i % 4, t) for i, t in enumerate(long)], "item_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in D.find_leaks(docs, bench).collect()) == [(i, i % 4) for i in range(6)]
    assert [r["doc_id"] for r in D.drop_leaks(docs, bench).collect()] == [9]


def test_a_key_that_repeats_is_learned_from_once(spark):
    """Whatever the order of rows, and however often the key comes."""
    rng = random.Random(2)
    base = [(i, " ".join(rng.choice("good plain words here , . and more".split()) for _ in range(40)) if i % 2 else "#$% " * rng.randint(3, 60), "en" if i % 2 else "de") for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i, _, _ in base], "doc_id long, quality int")
    rows = base + [(3, f"copy {k}", "en") for k in range(400)]
    schema = "doc_id long, text string, lang string"
    models, languages = [], []
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, schema)
        m = Q.fit(docs, labels)
        models.append([t.tolist() for t in m.tables])
        languages.append(L.fit(docs).logits.tolist())
    assert models[0] == models[1] and languages[0] == languages[1]


def test_long_texts_go_to_the_driver_as_bags(monkeypatch):
    import pyarrow as pa

    rows = [(i, "en" if i % 2 else "de", " ".join(f"{'abc' if i % 2 else 'xyz'}{(i * k) % 17}" for k in range(20 + 5 * i))) for i in range(40)]
    b = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["h", "y", "t"])
    monkeypatch.setattr(L, "LONG", 400)
    sent = [r for x in L._compact(iter([b])) for r in x.to_pylist()]
    assert {r["t"] is None for r in sent} == {True, False} and all((r["t"] is None) != (r["at"] is None) for r in sent)
    bags = [L._bag(r["t"]) if r["at"] is None else (np.array(r["at"], np.int32), np.array(r["weight"])) for r in sent]
    assert np.allclose(L.train_bags(bags, [r["y"] for r in sent]).logits, L.train([t for _, _, t in rows], [y for _, y, _ in rows]).logits)


def test_long_conversations_are_assembled_in_pieces(spark, monkeypatch):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"<{c}> [t] \\ " * (t % 5)) for c in range(3) for t in range(30)] + [(5, 0, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = sorted(tuple(r) for r in C.read_back(C.format_chats(df)).collect())
    import pyarrow as pa

    b = pa.RecordBatch.from_pydict({"conv_id": [r[0] for r in rows], "role": [r[2] for r in rows], "text": [r[3] for r in rows]})
    monkeypatch.setattr(C, "PART", 300)
    pieces = list(C._pieces(b))
    assert sum(p.num_rows for p in pieces) == len(rows) and len(pieces) > 10
    parts = list(C._format(iter([b])))
    assert sum(p.num_rows for p in parts) > 10
    assert sorted(tuple(x.values()) for p in C._read(iter(parts)) for x in p.to_pylist()) == want


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Null, empty and repeated texts, null keys and clashing names go through all stages; so do empty tables."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)
    good = " ".join(f"plain words number {i} of a good long text, with stops." for i in range(30))
    rows = [*ODD, *((100 + i, f"{good} {i}") for i in range(3)), (200, good), (200, good)]
    labels = spark.createDataFrame([(100, 1, 0), (2, 0, 0), (None, 1, 0), (101, None, 0)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, None), (None, "one two three four five six seven"), (2, "")], "item_id long, text string")
    for name, part in (("odd", rows), ("empty", [])):
        folder = tmp_path / name
        made_rows = [(i, t, None, None, None, *["x"] * len(CLASHES)) for i, t in part]
        spark.createDataFrame(made_rows, schema).write.parquet(str(folder / "documents.parquet"))
        (labels if part else labels.limit(0)).write.parquet(str(folder / "labels.parquet"))
        (items if part else items.limit(0)).write.parquet(str(folder / "benchmark.parquet"))
        out = corpus_pipeline.run(spark, str(folder)).collect()
        keys = [r["doc_id"] for r in out]
        assert set(keys) <= {i for i, _ in part} and keys.count(200) <= 1 and keys.count(5) <= 1


# whole models against plain versions


def test_quality_scores_equal_a_plain_scorer(spark):
    """Feature by feature, table by table, without numpy's bins."""
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    m = Q.fit(docs, labels.where(fold("doc_id", 5) != 0))
    got = {r["doc_id"]: r for r in queries.op5_quality_gam(spark, SF).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        x = Q.features(t)
        z = m.intercept + sum(float(table_[bisect.bisect_right(e.tolist(), v)]) for e, table_, v in zip(m.edges, m.tables, x, strict=True))
        for (a, b), t2 in zip(m.pairs, m.pair_tables, strict=True):
            z += float(t2[bisect.bisect_right(m.pair_edges[a].tolist(), x[a])][bisect.bisect_right(m.pair_edges[b].tolist(), x[b])])
        p = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
        assert abs(p - got[i]["score"]) < 1e-9 and got[i]["predicted"] == int(p >= 0.3)


def test_languages_equal_a_plain_predictor(spark):
    """Subword by subword with Python's numbers, no word kept."""
    docs = table(spark, SF, "documents")
    m = L.fit(docs.where(fold("doc_id", 3) != 1))
    got = {r["doc_id"]: r for r in queries.op8_language_id(spark, SF).collect()}
    shift = 64 - L.BUCKETS.bit_length() + 1

    def logits(word):
        b, out = b"<" + word + b">", []
        for n in L.GRAMS:
            for i in range(len(b) - n + 1):
                code = 0
                for k in range(n):
                    code = (code * 257 + b[i + k] + 1) % 2**64
                out.append(m.logits[(code + n) * 0x9E3779B97F4A7C15 % 2**64 >> shift].astype(np.float64))
        return np.mean(out, 0)

    for r in docs.limit(60).collect():
        words, found = L.words(r["text"] or ""), got[r["doc_id"]]
        if not r["text"] or not any(c.isalpha() for c in r["text"]) or not words:
            assert (found["lang_pred"], found["score"]) == ("und", 0.0)
            continue
        counts = Counter(words)
        z = sum(c * logits(w) for w, c in counts.items()) / len(words) + m.bias
        p = np.exp(z / m.temperature - (z / m.temperature).max())
        p /= p.sum()
        assert found["lang_pred"] == m.labels[int(p.argmax())] and abs(found["score"] - p.max()) < 1e-4


def plain_filter(pages):
    """op1 in plain Python: all counts in memory, Viterbi over every word, odds of every token."""
    lexicon = Counter(w.decode() for _, _, html in pages for w in U._TAG.sub(b" ", (html or "").encode()).translate(U._LETTERS).split() if w.isascii())
    total = sum(lexicon.values())
    given = set(U.BLOCK_SEEDS) | set(U.HOST_WORDS)
    for w in given:
        n = max(max(1, total >> 12), lexicon[w])
        lexicon[w] = n
    size = sum(lexicon.values()) + 1

    def split(name):
        best = [(0.0, [])]
        for j in range(1, len(name) + 1):
            options = []
            for i in range(max(0, j - U.LONGEST), j):
                part = name[i:j]
                cost = -math.log(lexicon[part] / size) if part in lexicon else math.log(size) + 2.3 * (j - i)
                options.append((best[i][0] + cost, i, best[i][1] + [part]))
            cost, _, words = min(options, key=lambda o: (o[0], o[1]))
            best.append((cost, words))
        return best[-1][1]

    parsed = []
    for key, url, _ in pages:
        host, path = U.split_url(url)
        tokens = [f + w for f, text in (("h:", host), ("p:", path)) for name in U.runs(text) for w in (["0"] if name == "0" else split(name))]
        parsed.append((key, host, path, tokens))
    counts, n_urls = {True: Counter(), False: Counter()}, Counter()
    for _, _, _, tokens in parsed:
        block = any("h:" + s in tokens for s in U.BLOCK_SEEDS)
        counts[block].update(tokens)
        n_urls[block] += 1
    distinct = len(counts[True] | counts[False]) + 1
    sums = {b: sum(c.values()) for b, c in counts.items()}
    out = []
    for key, host, path, tokens in parsed:
        score = math.log(n_urls[True] + 1) - math.log(n_urls[False] + 1)
        score += sum(math.log((counts[True][t] + 1) / (sums[True] + distinct)) - math.log((counts[False][t] + 1) / (sums[False] + distinct)) for t in tokens)
        rules = [r for r in U.RULES if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])]
        rule = max(rules, key=len, default=None)
        out.append((key, host, path, rule, U.RULES[rule] if rule else "block" if score > U.BIAS else "allow", score))
    return out


def test_url_verdicts_equal_a_plain_filter(spark):
    pages = [(r["page_id"], r["url"], r["html"]) for r in table(spark, SF, "pages").collect()]
    long = "http://" + "a" * 3000 + "casinobonus.example.com/" + "x" * 5000
    pages += [(-1, None, None), (-2, "no scheme", ""), (-3, "http://", "<p>x"), (None, "https://casinoloans.com/a", None), (-4, long, "<b>casino"), (-5, "HTTP://WWW.Example.COM/en/7?x", None), *[(-6, "http://cheapcasino.net/de/1", "x")] * 3]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"], r["score"]) for r in U.filter_urls(df, U.fit(df)).collect()]
    want = plain_filter(pages)
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=order), sorted(want, key=order), strict=True):
        assert g[:5] == w[:5] and abs(g[5] - w[5]) < 1e-6, (g, w)


def test_words_beside_seeds_are_learned(spark):
    """Hosts of two kinds of words; seeds stand in four of five unwanted ones. The others, and all hosts with their seeds taken
    away, must be found by their other words."""
    rng = random.Random(13)
    bad, good = "lucky spinner royal jackal prize fortune dealer wager".split(), "garden recipe history school museum weather travel library".split()
    text = "<p>" + " ".join((bad + good) * 60)
    pages, unseeded = [], set()
    for i in range(1200):
        unwanted = i % 4 == 0
        words = rng.sample(bad if unwanted else good, 2)
        if unwanted and i % 5:
            words.insert(rng.randrange(3), rng.choice(U.BLOCK_SEEDS))
        elif unwanted:
            unseeded.add(i)
        pages.append((i, f"http://{''.join(words)}.com/{rng.choice(['index', 'about'])}/{i}", text))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    blocked = {r["page_id"] for r in U.filter_urls(df, U.fit(df)).collect() if r["verdict"] == "block"}
    wanted = {i for i in range(1200) if i % 4 == 0}
    assert len(blocked & unseeded) >= 0.9 * len(unseeded) and len(blocked - wanted) <= 0.02 * len(blocked)
    train, test = df.where("page_id % 7 <> 0"), df.where("page_id % 7 = 0 and (page_id % 4 <> 0 or page_id % 5 <> 0)")
    precision, recall = U.evaluate(train, test)
    assert precision >= 0.95 and recall >= 0.9, (precision, recall)
