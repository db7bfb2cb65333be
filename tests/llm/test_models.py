"""Held-out accuracy of the trained models on the given tables, brute-force sums, and odd rows."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from portcullis.llm import class_lm as B
from portcullis.llm import language_id as I
from portcullis.llm import quality_gam as Q
from portcullis.llm import queries
from portcullis.llm import url_filter as U
from portcullis.llm.common import table

from .conftest import ODD

SF = "/root/testdata/sf0.01"


def held(key, n, rest):
    return zlib.crc32(str(key).encode()) % n == rest


# quality


def test_quality_held_out(spark):
    scores = {r["doc_id"]: r for r in queries.op5_quality_gam(spark, "/root/testdata/sf0.1").collect()}
    assert len(scores) == 10_000
    known = [(scores[r["doc_id"]], r["quality"]) for r in table(spark, "/root/testdata/sf0.1", "labels").collect() if held(r["doc_id"], 5, 0)]
    assert all(s["held_out"] for s, _ in known)
    assert all(s["predicted"] == (s["score"] >= 0.3) for s in scores.values())
    assert np.mean([s["predicted"] == q for s, q in known]) >= 0.95


def test_quality_tables_find_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = Q.train(x, y)
    assert (0, 1) in m.pairs
    assert np.mean((m.score(x) > 0.5) == y) > 0.95


def test_quality_odd_rows(spark, documents):
    assert Q.train(np.zeros((0, 3)), np.zeros(0)).score(np.zeros((2, 3))).tolist() == [0.5, 0.5]
    labels = spark.createDataFrame([(None, 1, 0), (4, None, 0), (4, 1, 0), (4, 1, 1), (5, 0, 0)], "doc_id long, quality int, toxic int")
    docs = documents(ODD)
    m = Q.fit(docs, labels)
    rows = Q.score(docs, m).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert Q.keep_good(docs, m).columns == docs.columns
    assert Q.score(documents([]), m).collect() == []


# language


def test_language_held_out(spark):
    langs = {r["doc_id"]: r["lang"] for r in table(spark, SF, "documents").select("doc_id", "lang").collect()}
    rows = queries.op8_language_id(spark, SF).collect()
    assert all(r["held_out"] == held(r["doc_id"], 3, 1) for r in rows)
    assert np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in rows if r["held_out"]]) >= 0.98


def test_language_odd_rows(spark, documents):
    m = I.train(["the cat and the dog"] * 10 + ["der hund und die katze"] * 10, ["en"] * 10 + ["de"] * 10)
    got = {r["doc_id"]: r["lang_pred"] for r in I.identify(documents(ODD), m).collect()}
    assert [got[i] for i in (1, 2, 3, 7)] == ["und"] * 4
    assert all(got[i] in ("en", "de") for i in (4, 5, 8))
    assert [I.has_letter(t) for t in ("²½ 7", "…!_", "x", "é", "日", "1a")] == [False, False, True, True, True, True]
    assert {r["lang_pred"] for r in I.identify(documents(ODD), I.train([], [])).collect()} == {"und"}


def test_language_sample_has_one_row_of_each_key(spark, monkeypatch):
    """A key that most rows have takes one place of the sample, not most of them."""
    monkeypatch.setattr(I, "SAMPLE", 300)
    seen = []
    monkeypatch.setattr(I, "train_bags", lambda bags, labels: seen.append(len(bags)))
    rows = spark.range(6_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("the same key").alias("text"), F.lit("en").alias("lang"))
    I.fit(rows.unionByName(spark.range(1_000, 1_398).select(F.col("id").alias("doc_id"), F.lit("another text").alias("text"), F.lit("en").alias("lang"))))
    assert 200 < seen[0] <= 300


def test_subwords_are_those_of_each_word_alone():
    found = [b"a", b"haus", "été".encode(), b"wonderful"]
    ids, offsets = I.subwords(found)
    for i, w in enumerate(found):
        alone, _ = I.subwords([w])
        assert sorted(ids[offsets[i] : offsets[i + 1]]) == sorted(alone)
        n = len(w) + 2
        assert len(alone) == sum(max(0, n - g + 1) for g in I.GRAMS)


# class-based language model


@pytest.mark.parametrize("bits", [20, 8])
def test_class_model_sums_match_brute_force(spark, documents, monkeypatch, bits):
    """With 8 bits most words take the way through the join."""
    monkeypatch.setattr(B, "HEAD_BITS", bits)
    texts = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").limit(80).collect()
    rows = [*((r["doc_id"] + 1000, r["text"]) for r in texts), *ODD]
    train = [t for k, t in rows if not held("" if k is None else k, 7, 2)]
    docs = documents(rows)
    from portcullis.llm.common import fold

    m, counts = B.fit(docs.where(fold("doc_id", 7) != 2))
    got = Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4), round(r["score"], 4)) for r in B.score(docs, m, counts).collect())
    split = lambda t: [*(t or "").encode().lower().split(), b""]
    c = Counter(w for t in train for w in split(t))
    n, v = sum(c.values()), len(c)
    assert (m.tokens, m.distinct) == (n, v)
    want = Counter()
    rank = {w: i for i, w in enumerate(m.head[: B.CLUSTERED])}
    q = m.classes
    of = {bytes(r["word"]): r["class"] for r in counts.collect()}
    assert set(of) == set(c) and {w for w, x in of.items() if x is None} == {*rank, b""}
    for key, text in rows:
        w = split(text)
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)
        score, before = 0.0, q + 1
        for x in w:
            if x == b"":
                score += m.transition[before, 2 * q]
            elif x in rank:
                score += m.transition[before, m.of[rank[x]]] + m.emission[rank[x]]
            elif x in c:
                score += m.transition[before, q + of[x]] + math.log10(c[x] + 1) - m.log_room[of[x]]
            else:
                score += m.unseen[before]
            before = m.of[rank[x]] if x in rank else q
        want[(key, len(w), sum(c[x] > 0 for x in w), n, round(base, 4), round(score, 4))] += 1
    assert got == want
    # the model's probabilities of what may follow a context add up to no more than one
    for context in range(q + 2):
        total = sum(10 ** (m.transition[context, m.of[i]] + m.emission[i]) for i in range(len(rank))) + 10 ** m.transition[context, 2 * q] + 10 ** m.unseen[context]
        total += sum(10 ** (m.transition[context, q + of[x]] + math.log10(c[x] + 1) - m.log_room[of[x]]) for x in c if x and x not in rank)
        assert total == pytest.approx(1)


def test_class_model_beats_the_unigram_base_on_held_out_texts(spark):
    held_out = [r for r in queries.op10_class_lm(spark, SF).collect() if r["held_out"]]
    assert sum(r["score"] for r in held_out) > 1.02 * sum(r["base_score"] for r in held_out)


def test_exchange_only_raises_the_likelihood_and_finds_planted_classes():
    rng = np.random.default_rng(2)
    n, true = 40, np.arange(40) % 4
    bigrams = np.zeros((n + 1, n + 1))
    for _ in range(40_000):
        i = rng.integers(n)
        bigrams[i, rng.choice(np.flatnonzero(true == (true[i] + 1) % 4))] += 1
    of = B.exchange(bigrams, [n, 1], n_classes=4)
    assert len({(a, b) for a, b in zip(true, of[:n], strict=True)}) == 4
    assert of[n] == 4


def test_class_model_without_training_texts(spark, documents):
    m, counts = B.fit(documents([]))
    rows = B.score(documents(ODD), m, counts).collect()
    assert len(rows) == len(ODD) and all(r["n_known"] == 0 and r["train_tokens"] == 0 and math.isfinite(r["score"]) for r in rows)


def test_words_of_one_ending_have_classes_by_their_neighbours(spark, documents):
    """Beyond the seeds too: 700 words of either kind, all with one ending."""
    docs = documents([(i, f"la a{i}xyz ra lb b{i}xyz rb " * 2) for i in range(700)])
    model, counts = B.fit(docs)
    at = {w: i for i, w in enumerate(model.head)}
    of = [{int(model.of[at[f"{c}{i}xyz".encode()]]) for i in range(700)} for c in "ab"]
    assert of[0].isdisjoint(of[1])
    score = {r["doc_id"]: r["score"] for r in B.score(documents([(1, "la a699xyz ra"), (2, "la b699xyz ra")]), model, counts).collect()}
    assert score[1] > score[2] + 1


def test_rare_words_have_classes_by_their_neighbours(spark, documents, monkeypatch):
    """Words of two occurrences that aren't in the head, all with one ending, go with the frequent words that stand where they do."""
    monkeypatch.setattr(B, "HEAD_BITS", 9)
    docs = documents([(i, f"la a{i}xyz ra lb b{i}xyz rb " * 2 + "la often ra lb always rb") for i in range(700)])
    model, counts = B.fit(docs)
    of = {bytes(r["word"]).decode(): r["class"] for r in counts.collect()}
    assert "a5xyz" not in {w.decode() for w in model.head}
    a, b = ({of[f"{c}{i}xyz"] for i in range(700)} for c in "ab")
    head = {w: int(c) for w, c in zip(model.head, model.of, strict=True)}
    assert a == {head[b"often"]} and b == {head[b"always"]} and a != b
    score = {r["doc_id"]: r["score"] for r in B.score(documents([(1, "la a699xyz ra"), (2, "la b699xyz ra")]), model, counts).collect()}
    assert score[1] > score[2] + 1


def test_rows_of_neighbours_do_not_grow_with_partitions(spark, monkeypatch):
    monkeypatch.setattr(B, "PAIRS", 20_000)
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("text").cache()
    head = [bytes(r["word"]) for r in B.word_counts(docs).where("n > 1").orderBy(F.desc("n"), "word").collect() if r["word"]]
    seen = []
    for n in (2, 40):
        found = B.neighbours(docs.repartition(n), head)
        rows = {r["word"]: r["e"] for r in found.collect()}
        assert len(rows) == found.count() and all(len({x >> 32 for x in e}) == len(e) for e in rows.values())
        seen.append({w: sorted(e) for w, e in rows.items()})
    assert seen[0] == seen[1]
    docs.unpersist()


@pytest.mark.parametrize("bits", [20, 8])
def test_class_bigrams_cover_all_tokens(spark, documents, monkeypatch, bits):
    monkeypatch.setattr(B, "HEAD_BITS", bits)
    monkeypatch.setattr(B, "PAIRS", 1000)
    rows = [(r["doc_id"], r["text"]) for r in table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()]
    model, counts = B.fit(documents(rows))
    q, head = model.classes, {w: int(c) for w, c in zip(model.head, model.of, strict=True)}
    of = {bytes(r["word"]): r["class"] for r in counts.collect()}
    follow = np.zeros((q + 2, 2 * q + 1))
    for _, text in rows:
        before = q + 1
        for w in [*(text or "").encode().lower().split(), b""]:
            follow[before, 2 * q if not w else head[w] if w in head else q + of[w]] += 1
            before = head.get(w, q)
    assert model.transition == pytest.approx(np.log10((follow + B.ALPHA) / (follow.sum(1, keepdims=True) + B.ALPHA * (2 * q + 1))))


# urls


def test_url_rules_and_split():
    assert U.split_url("HTTP://User@EX.com:80/a/B?c#d") == ("user@ex.com:80", "/a/B")
    assert U.split_url("x://h#/p?") == ("h", "")
    assert U.split_url("no mark") == U.split_url(None) == ("", "")
    r = U.Rules(U.RULES)
    assert r.find("a.example.com", "/en/71") == ("example.com/en/7", "allow")
    assert r.find("a.example.com", "/en/81") == ("com/en/", "block")
    assert r.find("notexample.net", "/de/8") == ("net/de/", "allow")
    assert r.find("example.net", "/de/8") == ("example.net/de/8", "block")
    assert r.find("example.net", "/DE/8") is None and r.find("", "") is None and r.find("comx", "/en/") is None


def test_viterbi_splits_by_frequency():
    s = U.Segmenter({"cheap": 50, "pills": 50, "che": 2, "ap": 2, "spam": 40, "farm": 40})
    assert s.split("cheappills") == ["cheap", "pills"]
    assert s.split("spamfarm") == ["spam", "farm"]
    assert s.split("") == []
    best = lambda w: min((sum(s.cost.get(p, s.unknown + 2.3 * len(p)) for p in parts) for parts in parts_of(w)))

    def parts_of(w):
        return [[w]] + [[w[:i], *rest] for i in range(1, len(w)) for rest in parts_of(w[i:])] if w else [[]]

    for w in ("chespam", "xfarm", "apap"):
        assert sum(s.cost.get(p, s.unknown + 2.3 * len(p)) for p in s.split(w)) == pytest.approx(best(w))


def test_url_filter_blocks_seeded_and_neighbouring_names(spark):
    urls = [f"http://cheappills{i % 3}.org/fr/{i}" for i in range(30)] + [f"https://news{i % 7}.org/fr/{i}" for i in range(200)] + ["http://pillsoffer.org/x", None, "", "no", "http://a.com/en/x"]
    pages = spark.createDataFrame([(i, u, "<p>cheap pills news offer paper</p>" if u else None, "x") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")
    rows = {r["page_id"]: r for r in U.filter_urls(pages, U.fit(pages)).collect()}
    assert all(rows[i]["verdict"] == "block" and rows[i]["rule"] is None for i in range(30))
    assert all(rows[i]["verdict"] == "allow" for i in range(30, 230))
    assert rows[230]["verdict"] == "block"
    assert [(rows[i]["host"], rows[i]["path"], rows[i]["verdict"]) for i in (231, 232, 233)] == [("", "", "allow")] * 3
    assert (rows[234]["rule"], rows[234]["verdict"]) == ("com/en/", "block")
    none = pages.limit(0)
    assert U.filter_urls(none, U.fit(none)).collect() == []


@pytest.mark.parametrize("bits", [16, 4])
def test_rare_words_of_the_pages_stay_whole(spark, monkeypatch, bits):
    """A word of 100,000 is below the bound of the broadcast ones; with 4 bits most names take the way through the join."""
    monkeypatch.setattr(U, "NAME_BITS", bits, raising=False)
    common = "paper news offer cheap pills " * 400
    rows = [(i, f"http://{'dietrich' if i == 3 else 'news'}.org/fr/{i}", f"<p>{common}{'dietrich' if i == 3 else ''}</p>") for i in range(50)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["tokens"] for r in U.filter_urls(pages, U.fit(pages)).collect()}
    assert {i: t[0] for i, t in got.items()} == {i: "h:dietrich" if i == 3 else "h:news" for i in range(50)}


@pytest.mark.parametrize("bits", [16, 6, 2])
def test_rare_tokens_have_their_own_odds(spark, monkeypatch, bits):
    """Scores are those of all tokens' exact counts, and a rare seed still blocks, whatever is broadcast."""
    monkeypatch.setattr(U, "TOKEN_BITS", bits)
    urls = [f"http://news{i % 7}.org/fr/paper" for i in range(400)] + ["http://casino.org/fr/offer", "http://casino.org/fr/offer", "http://malwareoffer.net/x", None]
    pages = spark.createDataFrame([(i, u, "<p>news offer paper</p>") for i, u in enumerate(urls)], "page_id long, url string, html string")
    rows = {r["page_id"]: r for r in U.filter_urls(pages, U.fit(pages)).collect()}
    assert len(rows) == len(urls) and [rows[i]["verdict"] for i in (0, 400, 401, 402)] == ["allow", "block", "block", "block"]
    seeds, n = {f"h:{w}" for w in U.BLOCK_SEEDS}, {True: Counter(), False: Counter()}
    label = {i: not seeds.isdisjoint(r["tokens"]) for i, r in rows.items()}
    for i, r in rows.items():
        n[label[i]].update(r["tokens"])
    size = len(n[True] | n[False]) + 1
    odds = {t: math.log((n[True][t] + 1) / (n[True].total() + size)) - math.log((n[False][t] + 1) / (n[False].total() + size)) for t in n[True] | n[False]}
    prior = math.log(sum(label.values()) + 1) - math.log(len(label) - sum(label.values()) + 1)
    assert all(r["score"] == pytest.approx(prior + sum(odds[t] for t in r["tokens"])) for r in rows.values())
