"""What the trained operators share: the split by id, bounded labelled samples, and a small weighted logistic regression."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import TEXT_BYTES, by_bytes


def remainder(doc_id: Column | str, n: int) -> Column:
    """crc32(doc_id as text) mod n; a null id's is that of empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def share(key: str, seed: int = 1) -> Column:
    """A hash of the key as a number from 0 to 1: rows are sampled in its order, the same at every size and however rows are dealt."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key)), 1) / float(1 << 63)


def cutoff(n: int, of: int) -> float:
    """A share under which, of so many rows, about twice n lie: fewer than n do with no chance to speak of, and what is sorted is bounded."""
    return 1.0 if of <= 4 * n + 64 else (2 * n + 64) / of


def some_of(df: DataFrame, key: str, n: int, of: int, seed: int = 1) -> DataFrame:
    """The n rows of df, which has so many, that come first by share()."""
    return df.where(share(key, seed) < cutoff(n, of)).orderBy(share(key, seed), key).limit(n)


def labelled(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, a_class: int) -> tuple[DataFrame, dict[int, int]]:
    """At most a_class labelled texts of each class (text, y), chosen by a hash of the id, and how many rows each class has.

    allowed is a condition on the labels' doc_id; only those rows are looked at. The chosen ids are so few, by a_class, that they
    are broadcast: texts are not shuffled.
    """
    own = labels.where(allowed & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("label_id")).agg(F.max(label).cast("int").alias("y"))
    sizes = {int(r["y"]): int(r["n"]) for r in own.groupBy("y").agg(F.count("*").alias("n")).collect()}
    ids = some_of(own.where("y = 1"), "label_id", a_class, sizes.get(1, 0)).unionByName(some_of(own.where("y = 0"), "label_id", a_class, sizes.get(0, 0)))
    return texts_of(docs, ids, "label_id", "y"), sizes


def texts_of(docs: DataFrame, ids: DataFrame, key: str, *more: str) -> DataFrame:
    """doc_id, text (the least of those that share an id, so that an id with many rows is still one) and more columns of ids, which are few."""
    met = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col(key))
    return met.groupBy("doc_id").agg(F.min("text").alias("text"), *[F.min(c).alias(c) for c in more])


def class_weights(y: np.ndarray, sizes: dict[int, int]) -> np.ndarray:
    """Weights that give a sample by class the shares of all labelled rows."""
    w = np.ones(len(y))
    total = sum(sizes.values()) or 1
    for c, n in sizes.items():
        if (of := y == c).any():
            w[of] = n / total / of.mean()
    return w


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights (the last is the intercept) by Newton steps on the weighted, ridge-penalised log loss; x should be of unit scale."""
    a = np.hstack([x, np.ones((len(x), 1))])
    beta, penalty = np.zeros(a.shape[1]), np.full(a.shape[1], ridge)
    penalty[-1] = 1e-6
    loss = lambda b: float((weight * np.logaddexp(0, np.where(y == 1, -1, 1) * (a @ b))).sum() + 0.5 * (penalty * b * b).sum())
    at = loss(beta)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        g = a.T @ (weight * (p - y)) + penalty * beta
        h = (a * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ a + np.diag(penalty)
        step, scale = np.linalg.solve(h, g), 1.0
        while scale > 1e-4 and (new := loss(beta - scale * step)) > at:
            scale /= 2
        if scale <= 1e-4:
            break
        beta, before, at = beta - scale * step, at, new
        if before - at < 1e-9 * max(1.0, before):
            break
    return beta


def logistic(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ beta[:-1] + beta[-1], -30, 30)))


def batches_of(frames: Iterator[pd.DataFrame], text: str = "text", limit: int = TEXT_BYTES) -> Iterator[pd.DataFrame]:
    """Frames cut so that each holds about limit characters of text."""
    for f in frames:
        for lo, hi in by_bytes(f[text], limit):
            yield f.iloc[lo:hi]
