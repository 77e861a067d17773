"""Toxicity by a lexicon, Levenshtein automata and context windows.

The lexicon is learned from labelled documents: words, and stems that words begin with, that stand in
toxic documents far oftener than in others. They are a trie; the Levenshtein automata of distance one
are intersected with it lazily, as one deterministic automaton whose states are sets of (trie node,
errors), so that a word is followed letter by letter until no entry can match. A misspelt word counts
for the term itself, at ``DISCOUNT``; words within one edit that ordinary documents hold as well
(``INNOCENT`` of them or more, and not far oftener in toxic ones) count nothing. A stem accepts any
ending, and no error: one edit in a beginning meets ordinary words.

A hit counts by its context: a window of ``WINDOW`` tokens on either side raises it with every
other hit there, and lowers it if the hit stands in quotation marks or after a word that reports
speech. A document's features are its weighted hits, in all and a token, by term; a logistic
regression gives the score.

Edge cases: null and empty texts have no hits and get the score of a text without any; repeated
rows get equal scores; without labelled rows of both classes the score is the share of label 1.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from sys import intern

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewise.llm.common import batch_of, held, text_slices
from placewise.llm.fitting import labelled_sample, logistic, sigmoid

#: Labelled documents of each class that the classifier is fitted on, at most.
PER_CLASS = 3000
#: Terms of the lexicon at most (the surest ones), and the least share and number of toxic documents that hold one.
TERMS, LEAST_SHARE, LEAST = 60, 0.01, 4
#: How many times oftener a term stands in toxic documents than in others, and by how many standard errors, at least.
RATIO, SURE = 8, 6
#: Letters of a stem; of the toxic documents with a stem, the share that may hold one and the same word.
STEM_SIZES, STEM_WORD = (3, 4, 5, 6, 7, 8), 0.5
#: Ends a stem in the lexicon.
OPEN = "*"
#: What a misspelt term counts, and the ordinary documents that make a word next to a term an innocent one.
DISCOUNT, INNOCENT = 0.7, 3
#: Terms shorter than this are matched as they are.
FUZZY_FROM = 5
WINDOW = 8
QUOTED, REPORTED, CLOSE = 0.4, 0.6, 0.5
CACHE = 150_000
THRESHOLD = 0.3
HELD_OUT = (4, 2)
QUOTES = "\"“”„«»‟"
#: Words that report speech (fixed values).
REPORTING = ["said", "says", "quote", "quoted", "called", "wrote", "term", "word", "sagte", "dit", "dijo"]
_LETTERS = re.compile(r"[^\W_]+")


class Automaton:
    """All words within one edit of a term (none for short terms), and all that begin with a stem, determinised as far as words lead."""

    def __init__(self, terms: list[str], fuzzy_from: int = FUZZY_FROM):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[int] = [-1]
        self.stem: list[int] = [-1]
        self.budget: list[bool] = [False]  # whether some term below the node may have an error
        self.fuzzy = [len(t) >= fuzzy_from and not t.endswith(OPEN) for t in terms]
        for i, t in enumerate(terms):
            node = 0
            self.budget[0] |= self.fuzzy[i]
            for c in t.removesuffix(OPEN):
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term.append(-1)
                    self.stem.append(-1)
                    self.budget.append(False)
                node = self.children[node][c]
                self.budget[node] |= self.fuzzy[i]
            (self.stem if t.endswith(OPEN) else self.term)[node] = i
        self.start = self._closed({(0, 0)})
        self.moves: dict[tuple[frozenset, str], frozenset] = {}
        self.ends: dict[frozenset, tuple[int, int]] = {}
        self.open: dict[frozenset, int] = {}  # states that have read a stem

    def _closed(self, states: set[tuple[int, int]]) -> frozenset:
        """With the states that the deletion of a term's letter leads to."""
        more = {(child, 1) for node, e in states if e == 0 and self.budget[node] for child in self.children[node].values()}
        out = states | more
        return frozenset(s for s in out if s[1] == 0 or (s[0], 0) not in out)

    def _move(self, state: frozenset, c: str) -> frozenset:
        out = set()
        for node, e in state:
            if c in self.children[node]:
                out.add((self.children[node][c], e))
            if e == 0 and self.budget[node]:
                out.add((node, 1))  # a letter too many
                out |= {(child, 1) for child in self.children[node].values()}  # another letter
        return self._closed(out)

    def _end(self, state: frozenset) -> tuple[int, int]:
        found = [(e, self.term[node]) for node, e in state if self.term[node] >= 0 and (e == 0 or self.fuzzy[self.term[node]])]
        return min(found, default=(2, -1))

    def match(self, word: str) -> tuple[int, int]:
        """(edits, term) of the stem that the word begins with or the nearest term, the first of equally near ones; (2, -1) if none is within one edit."""
        state, moves = self.start, self.moves
        for c in word:
            key = (state, c)
            state = moves.get(key)
            if state is None:
                if len(moves) > 200_000:
                    moves.clear()
                state = moves[key] = self._move(key[0], c)
                if read := [self.stem[node] for node, e in state if e == 0 and self.stem[node] >= 0]:
                    self.open[state] = min(read)
            if not state:
                return 2, -1
            if state in self.open:
                return 0, self.open[state]
        found = self.ends.get(state)
        if found is None:
            found = self.ends[state] = self._end(state)
        return found


@dataclass
class Model:
    terms: list[str]
    innocent: list[str]
    weights: np.ndarray
    prior: float
    made: dict = field(default_factory=dict, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return {"terms": self.terms, "innocent": self.innocent, "weights": self.weights, "prior": self.prior, "made": {}}

    def _tools(self) -> tuple:
        if not self.made:
            self.made["tools"] = Automaton(self.terms), frozenset(self.innocent), {}
        return self.made["tools"]

    def hits_of(self, token: str) -> tuple[tuple[int, float], ...]:
        """The terms that a token's words hit, each with what the hit counts."""
        automaton, innocent, _ = self._tools()
        out = []
        for word in _LETTERS.findall(token.lower()):
            edits, term = automaton.match(word)
            if term >= 0 and word not in innocent:
                out.append((term, 1.0 if edits == 0 else DISCOUNT))
        return tuple(out)

    @property
    def n_features(self) -> int:
        return 2 * len(self.terms)

    def features(self, texts: list[str]) -> np.ndarray:
        n = len(self.terms)
        cache = self._tools()[2]
        split = [t.split() for t in texts]
        if len(cache) > CACHE:
            cache.clear()
        for token in set().union(*split).difference(cache):
            cache[token] = self.hits_of(token)
        out = np.zeros((len(texts), 2 * n))
        for row, tokens in zip(out, split, strict=True):
            found = [(p, h) for p, h in enumerate(map(cache.__getitem__, tokens)) if h]
            if found:
                for p, i, weight in self._in_context(tokens, found):
                    row[i] += weight
            row[n:] = np.log1p(100 * row[:n] / max(len(tokens), 1))
            row[:n] = np.log1p(row[:n])
        return out

    @staticmethod
    def _in_context(tokens: list[str], found: list[tuple[int, tuple]]) -> Iterator[tuple[int, int, float]]:
        at = np.array([p for p, _ in found])
        close = np.searchsorted(at, at + WINDOW, side="right") - np.searchsorted(at, at - WINDOW) - 1
        for (p, hits), others in zip(found, close.tolist(), strict=True):
            weight = 1 + CLOSE * min(others, 2)
            before, own, after = tokens[max(0, p - WINDOW) : p], tokens[p], tokens[p + 1 : p + 1 + WINDOW]
            opened = any(t[0] in QUOTES for t in before) or own[0] in QUOTES
            closed = any(t.rstrip(".,;:!?")[-1:] in tuple(QUOTES) for t in after) or own.rstrip(".,;:!?")[-1:] in tuple(QUOTES)
            if opened and closed:
                weight *= QUOTED
            if any(t.strip(".,:;").lower() in REPORTING for t in before[-3:]):
                weight *= REPORTED
            for i, w in hits:
                yield p, i, w * weight

    def score(self, texts: list[str]) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(texts), self.prior)
        return sigmoid(self.features(texts) @ self.weights[:-1] + self.weights[-1])


def _ranked(toxic: Counter, clean: Counter, n_toxic: float, n_clean: float, least: int, ratio: float) -> list[tuple[float, str]]:
    """Entries by how surely they stand oftener in toxic documents."""
    out = []
    for entry, a in toxic.items():
        b = clean[entry]
        p, q = a / n_toxic, (b + 0.5) / n_clean
        if a >= least and p > ratio * q:
            pooled = (a + b) / (n_toxic + n_clean)
            out.append(((p - q) / np.sqrt(pooled * (1 - min(pooled, 0.999)) * (1 / n_toxic + 1 / n_clean)), entry))
    return sorted(out, key=lambda x: (-x[0], x[1].endswith(OPEN), -len(x[1]), x[1]))


def _entries(text: str) -> set[str]:
    """The words of a text and the stems that they begin with."""
    words = {w for t in text.split() for w in _LETTERS.findall(t.lower()) if len(w) > 2}
    return {intern(w) for w in words} | {intern(w[:k] + OPEN) for w in words for k in STEM_SIZES if k < len(w)}


def lexicon(texts: list[str], y: np.ndarray, terms: int = TERMS) -> tuple[list[str], list[str]]:
    """Words and stems, by the documents that hold them, the surest first and none within another; and the innocent words within one edit of a term."""
    toxic, clean, top = Counter(), Counter(), Counter()
    n_toxic, n_clean = max(1, sum(y)), max(1, sum(1 - y))
    for text in itertools.compress(texts, y):
        toxic.update(_entries(text))
    for w, n in toxic.items():
        if not w.endswith(OPEN):
            for stem in (w[:k] + OPEN for k in STEM_SIZES if k < len(w)):
                top[stem] = max(top[stem], n)
    least = max(LEAST, LEAST_SHARE * n_toxic)
    likely = Counter({t: n for t, n in toxic.items() if n >= least and top[t] <= STEM_WORD * n})
    words = Counter()
    for text in itertools.compress(texts, 1 - y):
        own = _entries(text)
        clean.update(own & likely.keys())
        words.update(w for w in own if not w.endswith(OPEN))
    found: list[str] = []
    for z, t in _ranked(likely, clean, n_toxic, n_clean, least, RATIO):
        if z <= SURE or len(found) == terms:
            break
        own = t.removesuffix(OPEN)
        if not any((f.endswith(OPEN) and own.startswith(f[:-1])) or (t.endswith(OPEN) and f.startswith(own)) for f in found):
            found.append(t)
    automaton = Automaton(found)
    near = [w for w, n in words.items() if n >= INNOCENT and toxic[w] / n_toxic <= RATIO * n / n_clean and automaton.match(w)[0] == 1]
    return found, sorted(near)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, held_out: tuple[int, int] = HELD_OUT) -> Model:
    return fit_texts(*labelled_sample(docs, labels, "toxic", *held_out, per_class))


def fit_texts(texts: list[str], y: np.ndarray, weights: np.ndarray, ridge: float = 1.0) -> Model:
    prior = float((weights * y).sum() / weights.sum()) if len(y) else 0.0
    if len(set(y.tolist())) < 2:
        return Model([], [], np.zeros(0), prior)
    model = Model(*lexicon(texts, y), np.zeros(0), prior)
    x = np.vstack([model.features(texts[k : k + 200]) for k in range(0, len(texts), 200)])
    model.weights = logistic(x, y, weights, ridge)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Rows (doc_id, score) for every row of ``docs``."""
    fields = [pa.field("doc_id", pa.int64()), pa.field("score", pa.float64())]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("toxicity")
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, texts in text_slices(batch):
                yield batch_of(fields, {"doc_id": ids[first : first + len(texts)], "score": model.score(texts)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    return score(docs, model).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, whole, whose texts score under the threshold."""
    schema = docs.schema
    at = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("toxicity")
        for batch in batches:
            scores = [model.score(texts) for _, texts in text_slices(batch, "text")]
            yield batch.filter(pa.array(np.concatenate(scores) < threshold)) if scores else batch

    assert at >= 0
    return docs.mapInArrow(run, schema)


def held_out_column(modulus: int = HELD_OUT[0], remainder: int = HELD_OUT[1]) -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))
