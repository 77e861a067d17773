"""Document quality by a linear-chain conditional random field over lines.

Every line has features of its own, of the line before and of the line after. The chain labels each
line good or bad; its potentials are linear in the features, with one weight for staying in a label.
It is trained on documents' labels in rounds, the first without neighbours: all lines of good documents
are good; in bad documents the lines that the model of the round before takes for good are good, but
for the worst. Forward-backward
marginals, weighted by line length, give a document's share of good text, and a logistic curve
fitted on the same documents makes that share its score.

Edge cases: null and empty texts are one empty line; repeated rows get equal scores; without
labelled rows of both classes the score is the share of label 1.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewise.llm.common import batch_of, text_slices
from placewise.llm.fitting import labelled_sample, logistic, sigmoid

#: Labelled documents of each class that the classifier is fitted on, at most.
PER_CLASS = 1500
HELD_OUT = (5, 0)
THRESHOLD = 0.3
ROUNDS, STEPS, RATE, RIDGE = 3, 150, 0.3, 1e-3
_SYMBOLS = "#$%&*|<>{}=_\\^~@[]+"
_DIGITS = "0123456789"
N = 12


def line_features(line: str, seen: int) -> list[float]:
    """``N`` numbers from 0 to about 1; ``seen``: how often the line stood before in its document."""
    words = line.split()
    n, chars = len(words), max(len(line), 1)
    if not n:
        return [0.0] * (N - 1) + [1.0]
    symbols = sum(map(line.count, _SYMBOLS)) / chars
    bangs = line.count("!") / n
    return [
        min(symbols * 5, 1.5),
        min(line.count("|") / n * 2, 1.5),
        min(bangs, 1.5),
        sum(map(str.isupper, words)) / n,
        min(sum(map(eq, words, words[1:])) / n * 2, 1.5),
        1 - len(set(words)) / n,
        min(sum(map(line.count, _DIGITS)) / chars * 3, 1.5),
        min(seen, 3) / 3,
        min(np.log1p(n) / 6, 1.5),
        min(chars / n / 12, 1.5),
        1.0 if line.rstrip()[-1:] in (".", "?", "!") else 0.0,
        0.0,
    ]


def document_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features of each line with those of its neighbours, and line lengths (a character more than they have)."""
    lines = text.split("\n")
    seen: dict[str, int] = {}
    rows = []
    for line in lines:
        rows.append(line_features(line, seen.get(line, 0)))
        seen[line] = seen.get(line, 0) + 1
    own = np.array(rows)
    edge = np.zeros((1, N))
    return np.hstack([own, np.vstack([edge, own[:-1]]), np.vstack([own[1:], edge]), np.ones((len(own), 1))]), np.array([len(x) + 1.0 for x in lines])


def marginals(unary: np.ndarray, stay: float, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of chains laid end to end, each beginning at one of ``starts``: P(line is good), and P(it has the label of the line before; 0 at a start).

    ``unary`` is the log odds of good by the line alone, ``stay`` the log weight of keeping the label.
    Chains run in step, longest first."""
    n = len(unary)
    lengths = np.diff(np.append(starts, n))
    order = np.argsort(-lengths, kind="stable")
    at, left = starts[order], lengths[order]
    counts = np.searchsorted(-left, -np.arange(left[0] if len(left) else 0), side="left")
    forward, backward = np.zeros(n), np.zeros(n)  # log odds of good given what stands before and itself; what stands after

    def across(odds: np.ndarray) -> np.ndarray:
        """The log odds that a neighbour's log odds give through the link."""
        return np.logaddexp(odds + stay, 0) - np.logaddexp(odds, stay)

    for k, c in enumerate(counts.tolist()):
        i = at[:c] + k
        forward[i] = unary[i] + (across(forward[i - 1]) if k else 0)
    for k in range(len(counts) - 2, -1, -1):
        i = at[: counts[k + 1]] + k
        backward[i] = across(unary[i + 1] + backward[i + 1])
    good = sigmoid(forward + backward)
    same = np.zeros(n)
    inside = np.ones(n, bool)
    inside[starts] = False
    i = np.flatnonzero(inside)
    if len(i):
        a, b = forward[i - 1], unary[i] + backward[i]
        terms = np.stack([a + b + stay, np.full(len(i), stay), a, b])
        terms -= terms.max(axis=0)
        e = np.exp(terms)
        same[i] = (e[0] + e[1]) / e.sum(axis=0)
    return good, same


@dataclass
class Model:
    weights: np.ndarray
    stay: float
    curve: tuple[float, float]
    prior: float

    def good_shares(self, texts: list[str]) -> np.ndarray:
        both = [document_features(t) for t in texts]
        x, size = np.vstack([b[0] for b in both]), np.concatenate([b[1] for b in both])
        starts = np.concatenate([[0], np.cumsum([len(b[1]) for b in both])[:-1]])
        good, _ = marginals(x @ self.weights, self.stay, starts)
        return np.add.reduceat(good * size, starts) / np.add.reduceat(size, starts)

    def label_lines(self, text: str) -> np.ndarray:
        """P(good) of each line."""
        x, _ = document_features(text)
        return marginals(x @ self.weights, self.stay, np.zeros(1, np.int64))[0]

    def score(self, texts: list[str]) -> np.ndarray:
        if not texts or not len(self.weights):
            return np.full(len(texts), self.prior)
        return sigmoid(self.curve[0] * self.good_shares(texts) + self.curve[1])


def train(x: np.ndarray, y: np.ndarray, starts: np.ndarray, line_weights: np.ndarray, alone: bool = False) -> tuple[np.ndarray, float]:
    """Weights by gradient ascent (Adam) on the conditional log likelihood of the line labels; ``alone`` leaves out all that neighbours say."""
    theta = np.zeros(x.shape[1] + 1)
    used = np.ones_like(theta)
    if alone:
        used[N : 3 * N] = used[-1] = 0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    inside = np.ones(len(y), bool)
    inside[starts] = False
    kept = np.zeros(len(y))
    i = np.flatnonzero(inside)
    kept[i] = y[i] == y[i - 1]
    total = line_weights.sum()
    for t in range(1, STEPS + 1):
        good, same = marginals(x @ theta[:-1], theta[-1], starts)
        g = np.append(x.T @ (line_weights * (y - good)), (line_weights * inside * (kept - same)).sum()) / total - RIDGE * theta
        g *= used
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta + RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta[:-1], float(theta[-1])


def fit_texts(texts: list[str], y: np.ndarray, weights: np.ndarray) -> Model:
    prior = float((weights * y).sum() / weights.sum()) if len(y) else 1.0
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(0), 0.0, (0.0, 0.0), prior)
    both = [document_features(t) for t in texts]
    x, sizes = np.vstack([b[0] for b in both]), np.array([len(b[1]) for b in both])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    owner = np.repeat(np.arange(len(texts)), sizes)
    # a document counts as one, whatever its number of lines
    line_weights = (1 / sizes)[owner]
    labels = y[owner].copy()
    for k in range(ROUNDS):
        # the first round tells junk lines from plain ones that stand beside them
        w, stay = train(x, labels, starts, line_weights, alone=k == 0)
        good, _ = marginals(x @ w, stay, starts)
        worst = np.zeros(len(good), bool)
        for a, n in zip(starts.tolist(), sizes.tolist(), strict=True):
            worst[a + int(good[a : a + n].argmin())] = True
        labels = np.where(y[owner] == 1, 1.0, np.where(worst, 0.0, (good > 0.5).astype(float)))
    model = Model(w, stay, (1.0, 0.0), prior)
    shares = np.concatenate([model.good_shares(texts[k : k + 200]) for k in range(0, len(texts), 200)])
    a, b = logistic(shares[:, None], y, weights, ridge=0.01)
    model.curve = float(a), float(b)
    return model


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, held_out: tuple[int, int] = HELD_OUT) -> Model:
    return fit_texts(*labelled_sample(docs, labels, "quality", *held_out, per_class))


def classify(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (doc_id, score, predicted) for every row of ``docs``."""
    fields = [pa.field("doc_id", pa.int64()), pa.field("score", pa.float64())]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, texts in text_slices(batch):
                yield batch_of(fields, {"doc_id": ids[first : first + len(texts)], "score": model.score(texts)})

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
