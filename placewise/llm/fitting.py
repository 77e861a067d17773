"""Labelled samples of bounded size, and a weighted logistic regression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEED = 7
#: Bytes of text of each class that are collected at most.
CLASS_BYTES = 32 << 20


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, per_class: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts, labels and weights of at most ``per_class`` labelled documents of each class, picked by a hash of the id.

    In that order documents are taken as long as all texts of their class come to ``CLASS_BYTES`` at most; texts are whole.
    Ids whose crc32 (of their decimal text) leaves ``held_out`` are left out. A weight is the class's
    size over its part of the sample, so that weighted counts are those of all labelled rows."""
    key = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (key % modulus != held_out))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    sizes = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    # at most 2 * per_class rows: small enough to send to every task
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    whole = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    # a window over at most per_class rows of a class
    order = Window.partitionBy("y").orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id")
    sized = whole.withColumn("size", F.sum(F.octet_length("text").cast("long")).over(order)).where(F.col("size") <= CLASS_BYTES)
    rows = sized.select("doc_id", "text", "y").orderBy("doc_id").collect()
    y = np.array([r.y for r in rows], np.float64)
    weights = np.array([sizes[r.y] / max(1, sum(y == r.y)) for r in rows]) if rows else np.zeros(0)
    return [r.text for r in rows], y, weights


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray, ridge: float, rounds: int = 30) -> np.ndarray:
    """Coefficients, the last one the intercept, by Newton's method; the intercept isn't penalised."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    weights = weights * (len(y) / max(weights.sum(), 1e-9))
    for _ in range(rounds):
        p = sigmoid(x @ w)
        grad = x.T @ (weights * (p - y)) + penalty * w
        hess = (x * (weights * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w
