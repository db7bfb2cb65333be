"""License scans with a generalised suffix automaton over the tokens of license templates.

The automaton holds all templates and base phrases. A text's words are streamed through it, giving at each word the
state and the length of the longest match that ends there (matching statistics). Two things are read off:

- base places: a phrase ends at a word if the phrase is a suffix of the match there, which each state knows for
  itself and for its suffix links;
- spans: maximal matches of MIN_MATCH words or more are put to their places in the templates and chained in order,
  over gaps of up to MAX_GAP words on either side; the words a chain covers give the template's coverage. Coverage of
  MIN_COVER or more adds the template's label, if the chain has a match that no template of another label holds: what
  several licenses share doesn't tell which one it is.

Templates of fewer than MIN_MATCH words, as SPDX tags, are found as wholes, by the state at their last word.

score is 1 where there is a base place, else the best coverage of a template: 0 to 1.

Words are runs of digits, letters a-z (A-Z lower-cased) and characters beyond ASCII; whole texts are read.
Defined cases: null text counts as empty (no words, no labels: '', null first and last word, score 0); repeated rows
are scanned alike; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portcullis.llm.license_texts import TEMPLATES

MIN_MATCH, MAX_GAP, MIN_COVER = 8, 12, 0.5

# The base phrases and the labels of the contract.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,from:int,to:int,cover:double>>"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORD_BYTES).split()


class Automaton:
    """Generalised suffix automaton of token sequences; state 0 is the root."""

    def __init__(self, sequences: list[list[bytes]]) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]  # (sequence, end) of the places of the state's longest string
        last_states = []
        for s, sequence in enumerate(sequences):
            last = 0
            for i, w in enumerate(sequence):
                last = self._extend(last, self.vocabulary.setdefault(w, len(self.vocabulary)))
                last_states.append((last, s, i + 1))
        for state, s, i in last_states:  # a place of a string is one of all its suffixes
            while state > 0:
                self.ends[state].append((s, i))
                state = self.link[state]

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.ends.append([])
        return len(self.next) - 1

    def _extend(self, last: int, w: int) -> int:
        if (q := self.next[last].get(w)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, w)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
        return new

    def _split(self, p: int, q: int, w: int) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def statistics(self, ids: list[int | None]) -> Iterator[tuple[int, int, int]]:
        """(place, state, length of the longest match that ends at the place), where that is 2 or more."""
        following, link, length = self.next, self.link, self.length
        state = matched = 0
        for i, w in enumerate(ids):
            if w is None:
                state = matched = 0
                continue
            to = following[state].get(w)
            if to is None:
                while state > 0 and w not in following[state]:
                    state = link[state]
                matched = length[state]
                to = following[state].get(w)
                if to is None:
                    state = matched = 0
                    continue
            state = to
            matched += 1
            if matched > 1:
                yield i, state, matched


class Scanner:
    def __init__(self, phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES) -> None:
        split = [words(p) for p in phrases]
        if any(len(p) < 2 for p in split):
            raise ValueError("phrases have two words or more")
        self.templates = [(label, words(t)) for label, t in templates]
        self.automaton = a = Automaton([*(t for _, t in self.templates), *split])
        # sequences that are found as wholes: the base phrases, and templates that are too short for chains
        named = [(t, label, False) for label, t in self.templates if len(t) < MIN_MATCH] + [(p, label, True) for p, label in zip(split, phrases.values(), strict=True)]
        own: dict[int, list[tuple[int, str, bool]]] = defaultdict(list)
        for sequence, label, is_base in named:
            state = 0
            for w in sequence:
                state = a.next[state][a.vocabulary[w]]
            own[state].append((len(sequence), label, is_base))
        # for each state those that are suffixes of its strings
        self.suffixes: list[tuple[tuple[int, str, bool], ...]] = [()] * len(a.next)
        for state in sorted(range(1, len(a.next)), key=a.length.__getitem__):
            self.suffixes[state] = (*own.get(state, ()), *self.suffixes[a.link[state]])

    def scan(self, text: str | None) -> tuple:
        found = words(text)
        ids = list(map(self.automaton.vocabulary.get, found))
        base, starts, matches, spans, told = set(), [], [], [], set()
        before = (-2, 0, 0)
        for place in self.automaton.statistics(ids):
            i, state, n = place
            for size, label, is_base in self.suffixes[state]:
                if n < size:
                    continue
                if is_base:
                    base.add(label)
                    starts.append(i - size + 1)
                else:
                    spans.append((label, i - size + 1, i + 1, 1.0))
                    told.add(label)
            if before[2] >= MIN_MATCH and (i != before[0] + 1 or n <= before[2]):
                matches.append(before)
            before = place
        if before[2] >= MIN_MATCH:
            matches.append(before)
        chains = self._chains(matches)
        spans = sorted(spans + [span for span, _ in chains])
        labels = base | told | {label for (label, _, _, cover), tells in chains if tells and cover >= MIN_COVER}
        score = 1.0 if base else min(1.0, max((c for *_, c in spans), default=0.0))
        return len(found), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, spans

    def _chains(self, matches: list[tuple[int, int, int]]) -> list[tuple[tuple[str, int, int, float], bool]]:
        """(label, first word, end, coverage) of the best chain of each template that has a match, and whether a match
        of it is in templates of that label alone; such chains come first."""
        by_template = defaultdict(list)
        for i, state, n in matches:
            places = [(s, end) for s, end in self.automaton.ends[state] if s < len(self.templates) and end >= n]
            tells = len({self.templates[s][0] for s, _ in places}) == 1
            for s, end in places:
                by_template[s].append((i + 1 - n, i + 1, end - n, end, tells))
        out = []
        for s, places in by_template.items():
            best, recent = (False, 0, 0, 0), []  # recent: chains that may go on: (text end, template end, covered, text start, tells)
            for a, b, x, y, tells in sorted(places):
                recent = [r for r in recent if a - r[0] <= MAX_GAP]
                may = [r for r in recent if r[1] < y and x - r[1] <= MAX_GAP and r[0] < b]
                ahead = {max(may, key=lambda r: r[2]), max(may, key=lambda r: (r[4], r[2]))} if may else {None}
                for r in ahead:
                    gain = min(b - a, b - r[0], y - r[1]) if r else b - a
                    chain = (b, y, gain + (r[2] if r else 0), r[3] if r else a, tells or bool(r and r[4]))
                    recent.append(chain)
                    best = max(best, (chain[4], chain[2], chain[3], b))
            tells, covered, a, b = best
            out.append(((self.templates[s][0], a, b, min(1.0, covered / len(self.templates[s][1]))), tells))
        return out


def license_scan(docs: DataFrame, key: str = "doc_id", text: str = "text", phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """key and SCHEMA for each row of docs."""
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    names = [key, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("from", pa.int32()), ("to", pa.int32()), ("cover", pa.float64())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, templates)
        for b in batches:
            rows = [scanner.scan(t.as_py()) for t in b.column("text")]
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            columns[-1] = [[dict(zip(("label", "from", "to", "cover"), s, strict=True)) for s in spans] for spans in columns[-1]]
            yield pa.RecordBatch.from_arrays([b.column("key"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    return source.mapInArrow(run, f"{key} {source.schema['key'].dataType.simpleString()}, {SCHEMA}")
