"""What the trained operators share: labelled samples, held-out rows and a logistic fit on bounded data."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

#: Labelled rows of each class that a model may be fitted on. They bound what the driver holds.
MAX_PER_CLASS = 6000


def held_out(mod: int, rest: int):
    """Rows kept from training: crc32 of the identifier as text, modulo mod, is rest."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod == rest


def sample(docs: DataFrame, labels: DataFrame, label: str, mod: int, rest: int, per_class: int = MAX_PER_CLASS) -> DataFrame:
    """(doc_id, text, label) of at most per_class rows of each label 0 and 1 outside the held-out ones, those first by a hash of doc_id.

    Of rows that share a doc_id the text with the least hash is taken, so that the sample is bounded and the same in every run.
    An identifier that has both labels stands once for each.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("label")).filter(~held_out(mod, rest)).distinct()
    order = F.xxhash64("doc_id")
    both = [known.filter(F.col("label") == y).orderBy(order, "doc_id").limit(per_class) for y in (0, 1)]
    met = docs.select("doc_id", "text").join(F.broadcast(both[0].union(both[1])), "doc_id")
    return met.groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("doc_id", "text", "label")


def logistic(x: np.ndarray, y: np.ndarray, l2: float, rounds: int = 50, intercept: bool = True) -> np.ndarray:
    """Weights (intercept last) that minimise logistic loss with an L2 penalty, by Newton's method."""
    if intercept:
        x = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], l2)
    if intercept:
        penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (p - y) + penalty * w)
        w = w - step
        if np.abs(step).max() < 1e-7:
            break
    return w


def sigmoid(z: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))
