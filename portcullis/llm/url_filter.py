"""URL filters: rules, then host word segmentation and naive Bayes.

1. Lexicon: words (a-z) of the pages' texts are counted over all pages and written. All of them form a unigram model,
   together with the seed words. Those with more than total / 2**LEXICON_BITS occurrences, so at most 2**LEXICON_BITS,
   and those of up to SHORT letters are broadcast; the others are found by a join with the parts of the URLs' names.
2. Every label of a host, and every run of letters of a path (a name), is split into words by Viterbi under that model,
   each distinct name once. Names with more than total / 2**NAME_BITS occurrences are broadcast with their words,
   the others joined to the URLs that have them.
3. Labelled URLs: a URL with a BLOCK seed among its host words is a block example, any other an allow example. The
   tokens of both classes are counted over all pages and written. Tokens with more than total / 2**TOKEN_BITS
   occurrences, and seeds, are broadcast; the other tokens of a URL are joined with their counts. Multinomial naive
   Bayes with the counts of all tokens then scores all URLs, so words that stand beside seeds count as well, in hosts
   without a seed too. BIAS is the log odds that a block needs.
4. The longest rule that fits a URL, if any, overrides the method.

Defined cases: a null url, or one without ``://``, has an empty host and path, no tokens, and is judged by the prior alone;
null html adds no words; repeated rows are judged alike; of rules of the same length the one with the longer host
wins; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import ChainMap, Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portcullis.llm.common import ROW, checkpointed, with_row

LEXICON_BITS, NAME_BITS, TOKEN_BITS, SHORT, LONGEST, FLUSH, KEPT, BIAS = 16, 16, 16, 3, 24, 500_000, 200_000, 2.0

# The rules of the contract, as host/path and verdict.
RULES = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}

# Words that name unwanted sites.
BLOCK_SEEDS = ("adult bet betting bonus casino cheap clickbait crack cracked dating diet escort gambling hacked jackpot keygen loan loans lottery malware nude payday phishing pharmacy pills poker porn replica scam sex slots spam spyware torrent viagra warez weightloss xxx").split()
# Words of host names that the texts of pages may lack.
HOST_WORDS = ("api app blog cdn com de en es example farm forum fr free host html mail mobile net news online org photo post shop site store tech test video web wiki www").split()

_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Scripts and styles up to their closing tags, or to the end, and tags; linear in the text.
_TAG = re.compile(rb"<(?:script|style)\b(?:(?!</(?:script|style)).)*|<[^<>]*>", re.I | re.S)
_END_OF_HOST, _END_OF_PATH = re.compile(r"[/?#]"), re.compile(r"[?#]")
_UPPER = {c: c + 32 for c in range(65, 91)}
_RUN = re.compile(r"[a-z]+|[0-9]+|[^a-z0-9]+", re.I)


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = m.start() if (m := _END_OF_HOST.search(rest)) else len(rest)
    after = rest[end:]
    return rest[:end].translate(_UPPER), after[: m.start()] if (m := _END_OF_PATH.search(after)) else after


class Rules:
    """Finds the longest rule that fits a host or a parent of it, and the path."""

    def __init__(self, rules: dict[str, str]) -> None:
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for rule, verdict in rules.items():
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host.translate(_UPPER), []).append((slash + path, rule, verdict))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        best = None
        while host:
            for prefix, rule, verdict in self.by_host.get(host, ()):
                if path.startswith(prefix) and (best is None or len(rule) > len(best[0])):
                    best = (rule, verdict)
            host = host.partition(".")[2]
        return best


def runs(text: str) -> Iterator[str]:
    """The runs of letters of a host or path, in lower case, and "0" for each number."""
    for m in _RUN.findall(text):
        if m[0].isdigit() and m.isascii():
            yield "0"
        elif m[0].isalpha() and m.isascii():
            yield m.lower()


class Segmenter:
    """Viterbi under a unigram model; words that it lacks cost more with each letter."""

    def __init__(self, counts: dict[str, int], total: int | None = None) -> None:
        self.total = total = (sum(counts.values()) if total is None else total) + 1
        self.cost = {w: -math.log(n / total) for w, n in counts.items() if len(w) <= LONGEST}
        self.unknown = math.log(total)
        self.kept: dict[str, list[str]] = {}

    def split(self, name: str, more: dict[str, int] | None = None) -> list[str]:
        """The words of a name. more: counts of words in it that the broadcast ones lack."""
        if more:
            return self._viterbi(name, {w: -math.log(n / self.total) for w, n in more.items()})
        if (out := self.kept.get(name)) is None:
            if len(self.kept) >= KEPT:
                self.kept.clear()
            out = self.kept[name] = self._viterbi(name, {})
        return out

    def _viterbi(self, name: str, more: dict[str, float]) -> list[str]:
        n = len(name)
        best, back = [0.0] + [math.inf] * n, [0] * (n + 1)
        for j in range(1, n + 1):
            for i in range(max(0, j - LONGEST), j):
                part = name[i:j]
                c = self.cost.get(part)
                if c is None:
                    c = more.get(part, self.unknown + 2.3 * (j - i))
                c += best[i]
                if c < best[j]:
                    best[j], back[j] = c, i
        out = []
        while n:
            out.append(name[back[n] : n])
            n = back[n]
        return out[::-1]


def tokens_of(host: str, path: str, split: dict[str, list[str]]) -> list[str]:
    """Words of the host as h:word and of the path as p:word; numbers are one token."""
    return [field + w for field, text in (("h:", host), ("p:", path)) for name in runs(text) for w in (("0",) if name == "0" else split[name])]


@dataclass
class Lexicon:
    words: dict[str, int]  # the broadcast ones
    total: int  # occurrences of all words
    others: DataFrame  # word and n of the other ones


@dataclass
class Model:
    lexicon: Lexicon
    odds: dict[str, float]
    other: float  # of tokens that no labelled URL has
    prior: float
    others: DataFrame  # token and more, its odds above other, of tokens that aren't in odds


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[bytes] = Counter()

    def out() -> pa.RecordBatch:
        found = [(w, n) for w, n in counts.items() if w.isascii()]
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array([w.decode() for w, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], names=["word", "n"])

    for b in batches:
        for t in b.column("html"):
            counts.update(_TAG.sub(b" ", (t.as_py() or "").encode()).translate(_LETTERS).split())
        if len(counts) >= FLUSH:
            yield out()
    yield out()


def lexicon(pages: DataFrame) -> Lexicon:
    counts = checkpointed(pages.select("html").mapInArrow(_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    given = [*BLOCK_SEEDS, *HOST_WORDS]
    shared = (F.col("n") > (total >> LEXICON_BITS)) | (F.length("word") <= SHORT) | F.col("word").isin(given)
    words = {r["word"]: r["n"] for r in counts.where(shared).collect()}
    seed_count = max(1, total >> 12)  # as frequent as words in a few thousand
    raised = {w: max(seed_count, words.get(w, 0)) for w in given}
    total += sum(n - words.get(w, 0) for w, n in raised.items())
    return Lexicon(words | raised, total, counts.where(~shared & (F.length("word") <= LONGEST)))


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        b = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["name", "n"])
        counts.clear()
        return b

    for b in batches:
        for url in b.column("url"):
            for text in split_url(url.as_py()):
                counts.update(name for name in runs(text) if name != "0")
        if len(counts) >= FLUSH:
            yield out()
    yield out()


def split_names(pages: DataFrame, words: Lexicon) -> DataFrame:
    """name, n and words of every distinct name of the URLs, written."""
    names = checkpointed(pages.select("url").mapInArrow(_names, "name string, n long").groupBy("name").agg(F.sum("n").alias("n")))
    shared = pages.sparkSession.sparkContext.broadcast((words.words, words.total))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value[0]
        for b in batches:
            found = [(x, p) for x in b.column("name").to_pylist() for p in {x[i:j] for i in range(len(x)) for j in range(i + SHORT + 1, min(i + LONGEST, len(x)) + 1)} if p not in known]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([p for _, p in found], pa.string())], names=["name", "word"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = Segmenter(*shared.value)
        for b in batches:
            more = [{m["word"]: m["n"] for m in x or ()} for x in b.column("more").to_pylist()]
            cut = [segmenter.split(*x) for x in zip(b.column("name").to_pylist(), more, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("name"), b.column("n"), pa.array(cut, pa.list_(pa.string()))], names=["name", "n", "words"])

    inside = names.select("name").mapInArrow(parts, "name string, word string").join(words.others, "word")
    inside = inside.groupBy("name").agg(F.collect_list(F.struct("word", "n")).alias("more"))
    return checkpointed(names.join(inside, "name", "left").mapInArrow(split, "name string, n long, words array<string>"))


def with_words(source: DataFrame, words: Lexicon) -> tuple[DataFrame, dict[str, list[str]]]:
    """source (url and other columns) with ROW and own, the words of each row's names that aren't in the broadcast ones,
    and those; written."""
    names = split_names(source, words)
    total = names.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = F.col("n") > (total >> NAME_BITS)
    common = {r["name"]: r["words"] for r in names.where(often).collect()}
    shared = source.sparkSession.sparkContext.broadcast(frozenset(common))
    rows = with_row(source)

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value | {"0"}
        for b in batches:
            found = [(r, x) for r, u in zip(b.column(ROW).to_pylist(), b.column("url").to_pylist(), strict=True) for x in {x for text in split_url(u) for x in runs(text)} - known]
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in found], pa.int64()), pa.array([x for _, x in found], pa.string())], names=[ROW, "name"])

    own = rows.select(ROW, "url").mapInArrow(rare, f"{ROW} long, name string").join(names.where(~often), "name")
    own = own.groupBy(ROW).agg(F.collect_list(F.struct("name", "words")).alias("own"))
    return checkpointed(rows.join(own, ROW, "left")), common


def _tokens(b: pa.RecordBatch, common: dict[str, list[str]]) -> Iterator[tuple[str, str, list[str]]]:
    """Host, path and tokens of each row of a batch that has url and own."""
    for url, own in zip(b.column("url").to_pylist(), b.column("own").to_pylist(), strict=True):
        host, path = split_url(url)
        yield host, path, tokens_of(host, path, ChainMap({x["name"]: x["words"] for x in own}, common) if own else common)


def fit(pages: DataFrame) -> Model:
    words = lexicon(pages)
    urls, common = with_words(pages.select("url"), words)
    shared = pages.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = {f"h:{w}" for w in BLOCK_SEEDS}
        counts: Counter[tuple[str, bool]] = Counter()

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array([t for t, _ in counts], pa.string()), pa.array([c for _, c in counts], pa.bool_()), pa.array(list(counts.values()), pa.int64())], names=["token", "block", "n"])
            counts.clear()
            return b

        for b in batches:
            for _, _, tokens in _tokens(b, shared.value):
                block = not seeds.isdisjoint(tokens)
                counts.update((t, block) for t in tokens)
                counts["", block] += 1
            if len(counts) >= FLUSH:
                yield out()
        yield out()

    n_of = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    found = checkpointed(urls.select("url", "own").mapInArrow(run, "token string, block boolean, n long").groupBy("token").agg(n_of(F.col("block")).alias("block"), n_of(~F.col("block")).alias("allow"), F.sum("n").alias("n")))
    row = found.agg(F.coalesce(F.sum("block"), F.lit(0)), F.coalesce(F.sum("allow"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("token") == "", F.col("block"))), F.lit(0)), F.coalesce(F.sum(F.when(F.col("token") == "", F.col("allow"))), F.lit(0))).first()
    total, size = found.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("token") != "", 1)) + 1).first()
    shared = (F.col("n") > (total >> TOKEN_BITS)) | F.col("token").isin([f + w for w in BLOCK_SEEDS for f in ("h:", "p:")])
    block, allow = row[0] - row[2], row[1] - row[3]
    odds = lambda b, a: math.log((b + 1) / (block + size)) - math.log((a + 1) / (allow + size))
    kept = {r["token"]: odds(r["block"], r["allow"]) for r in found.where(shared).orderBy("token").collect() if r["token"]}
    others = found.where(~shared & (F.col("token") != "")).select("token", (F.log(F.col("block") + 1) - F.log(F.col("allow") + 1)).alias("more"))
    return Model(words, kept, odds(0, 0), math.log(row[2] + 1) - math.log(row[3] + 1), others)


def evaluate(train: DataFrame, test: DataFrame) -> tuple[float, float]:
    """Precision and recall of the method on test, learned from train: its URLs are judged without their seed words, so by what
    stands beside seeds alone, and those that have seeds are the ones to be blocked. Nothing to block or blocked counts as 1."""
    found = filter_urls(test, fit(train), {}, seeds=False)
    wanted = F.arrays_overlap("tokens", F.array(*[F.lit(f"h:{w}") for w in BLOCK_SEEDS]))
    blocked = F.col("verdict") == "block"
    hit, n_blocked, n_wanted = found.agg(F.count_if(wanted & blocked), F.count_if(blocked), F.count_if(wanted)).first()
    return hit / n_blocked if n_blocked else 1.0, hit / n_wanted if n_wanted else 1.0


def filter_urls(pages: DataFrame, model: Model, rules: dict[str, str] = RULES, key: str = "page_id", url: str = "url", seeds: bool = True) -> DataFrame:
    """key, host, path, rule, verdict, score (log odds of block) and tokens of every row of pages. seeds: whether seed words of
    hosts count for the score."""
    source, common = with_words(pages.select(F.col(key).alias("key"), F.col(url).alias("url")), model.lexicon)
    shared = pages.sparkSession.sparkContext.broadcast((common, model.odds, model.other, model.prior, rules))
    names = [ROW, "key", "host", "path", "rule", "verdict", "score", "tokens", "rare"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, odds, other, prior, given = shared.value
        fits = Rules(given)
        silent = set() if seeds else {f"h:{w}" for w in BLOCK_SEEDS}
        for b in batches:
            rows = []
            for host, path, tokens in _tokens(b, common):
                score = prior + sum(odds.get(t, other) for t in tokens if t not in silent)
                rule = fits.find(host, path)
                rows.append((host, path, *(rule or (None, None)), score, tokens, [t for t in tokens if t not in odds]))
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(ROW), b.column("key"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    kind = source.schema["key"].dataType.simpleString()
    scored = checkpointed(source.mapInArrow(run, f"{ROW} long, key {kind}, host string, path string, rule string, verdict string, score double, tokens array<string>, rare array<string>"))
    more = scored.select(ROW, F.explode("rare").alias("token")).join(model.others, "token").groupBy(ROW).agg(F.sum("more").alias("more"))
    score = F.col("score") + F.coalesce("more", F.lit(0.0))
    verdict = F.coalesce("verdict", F.when(score > BIAS, "block").otherwise("allow"))
    return scored.join(more, ROW, "left").select(F.col("key").alias(key), "host", "path", "rule", verdict.alias("verdict"), score.alias("score"), "tokens")
