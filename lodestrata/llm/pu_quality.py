"""Quality by positive-unlabelled learning.

Trusted positives (labelled 1) and unlabelled web text train a linear model on features of form (shares of character classes,
repetition of words and lines, word lengths). It minimises the non-negative unbiased risk of Kiryo et al. (2017) under the
logistic loss: prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)). The class prior is estimated from positives
and unlabelled texts alone, by the best bin of Garg et al. (2021): where a held-out classifier of the two puts its highest scores,
the unlabelled texts' share over the positives' is the prior. Rows labelled 0 are never read as such. The score is the model's
probability of label 1.

Cases: null and empty texts have the features of no words and get one and the same score; repeated texts the same score; without
positives every score is 0.5; very long texts are measured whole; an empty table gives no rows;
columns other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import with_results
from lodestrata.llm.hashing import hashed, joined_bytes, runs, word_bytes
from lodestrata.llm.learning import batches_of, fit_logistic, logistic, remainder, some_of, texts_of
from lodestrata.session import found_by_workers

THRESHOLD = 0.3
#: Trusted positives and unlabelled texts to learn from, at most.
POSITIVES, UNLABELLED = 6000, 12000
FEATURES = ("length", "upper", "digit", "symbol", "bar", "bang", "mark", "space", "line", "word_length", "long_words", "repeat_word", "repeat_pair", "repeat_line", "distinct", "other")


def _share(mask: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return (total[first[1:]] - total[first[:-1]]).astype(float)


def _repeats(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many of each text's values came before in it."""
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((values, text))
    same = np.zeros(len(values), dtype=bool)
    if len(values) > 1:
        v, t = values[order], text[order]
        same[1:] = (v[1:] == v[:-1]) & (t[1:] == t[:-1])
    return np.bincount(text[order], weights=same, minlength=len(at) - 1)


def features(texts: list[str | None]) -> np.ndarray:
    """A row of FEATURES for each text; shares are shrunk, so that a few words prove little."""
    raw, first = joined_bytes(texts, lower=False)
    upper = (raw >= 0x41) & (raw <= 0x5A)
    data = np.where(upper, raw + 32, raw).astype(np.uint8)
    starts, ends = runs(word_bytes(data))
    at = np.searchsorted(starts, first)
    words = hashed(data, starts, ends)
    n, chars = np.diff(at).astype(float), np.diff(first) - 1.0
    rate = lambda count, of, least: count / (of + least)
    char = lambda mask: rate(_share(mask, first), chars, 40)
    text = np.repeat(np.arange(len(texts)), np.diff(at))
    next_same = np.zeros(len(words))
    pairs = words.copy()
    if len(words) > 1:
        near = text[1:] == text[:-1]
        next_same[1:] = near & (words[1:] == words[:-1])
        pairs[1:] = words[1:] * np.uint64(31) + words[:-1]
    of_text = lambda x: np.bincount(text, weights=x, minlength=len(texts))
    length = (ends - starts).astype(float)
    line_starts, line_ends = runs(raw != 0x0A)
    lines = hashed(data, line_starts, line_ends)
    line_at = np.searchsorted(line_starts, first)
    letter = ((data >= 0x61) & (data <= 0x7A)) | (data >= 0x80)
    symbol = np.isin(raw, np.frombuffer(b"#$%&*@^~_=+<>\\/", dtype=np.uint8))
    out = np.stack([
        np.minimum(np.log1p(n) / 8, 1.5), char(upper) * 4, char((raw >= 0x30) & (raw <= 0x39)) * 4, char(symbol) * 4, char(raw == 0x7C) * 8, char(raw == 0x21) * 8,
        char((raw == 0x2E) | (raw == 0x2C)) * 8, char(raw == 0x20) * 2, char(raw == 0x0A) * 8, rate(of_text(length), n, 10) / 8, rate(of_text(length > 16), n, 10) * 2,
        rate(of_text(next_same), n, 10) * 4, rate(_repeats(pairs, at), n, 20) * 2, rate(_repeats(lines, line_at), np.diff(line_at), 3) * 2, rate(_repeats(words, at), n, 30), char(~letter & (raw > 0x20)) * 2,
    ], axis=1)
    return np.minimum(out, 4.0)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return 1 / (1 + np.exp(-np.clip(z @ self.weights[:-1] + self.weights[-1], -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 1500, rate: float = 0.05, ridge: float = 1e-4) -> Model:
    """Adam on the non-negative risk; where the negative part is below zero its gradient is reversed, as published."""
    both = np.vstack([positive, unlabelled])
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-6
    a, b = (np.hstack([np.clip((x - mean) / scale, -8, 8), np.ones((len(x), 1))]) for x in (positive, unlabelled))
    w = np.zeros(a.shape[1])
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    sigmoid = lambda t: 1 / (1 + np.exp(-np.clip(t, -30, 30)))
    for t in range(1, steps + 1):
        ga, gb = a @ w, b @ w
        negative = np.logaddexp(0, gb).mean() - prior * np.logaddexp(0, ga).mean()
        up = -prior * (a * sigmoid(-ga)[:, None]).mean(axis=0)
        down = (b * sigmoid(gb)[:, None]).mean(axis=0) - prior * (a * sigmoid(ga)[:, None]).mean(axis=0)
        g = (up + down if negative >= 0 else -down) + ridge * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(mean, scale, w, prior)


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1, gamma: float = 0.01) -> float:
    """The share of positives among the unlabelled, by the best bin, the mean of two halves that are scored by the other's classifier."""
    found = []
    for k in (0, 1):
        (p, q), (u, v) = ((x[k::2], x[1 - k :: 2]) for x in (positive, unlabelled))
        if not all(map(len, (p, q, u, v))):
            continue
        both = np.vstack([p, u])
        mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-6
        of = lambda x: np.clip((x - mean) / scale, -8, 8)  # noqa: E731, B023
        beta = fit_logistic(of(both), np.r_[np.ones(len(p)), np.zeros(len(u))], np.r_[np.full(len(p), 1 / len(p)), np.full(len(u), 1 / len(u))] * len(both) / 2)
        at, other = np.sort(logistic(of(q), beta)), np.sort(logistic(of(v), beta))
        share = 1 - np.arange(len(at)) / len(at)
        ratio = (1 - np.searchsorted(other, at, side="left") / len(other)) / share
        slack = (np.sqrt(np.log(4 / delta) / (2 * len(other))) + np.sqrt(np.log(4 / delta) / (2 * len(at)))) * (1 + gamma) / share
        found.append(ratio[np.argmin(ratio + slack)])
    return float(np.mean(found)) if found else 0.5


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """From rows whose crc32(doc_id as text) mod 5 is not 0; texts are sampled by a hash of the id, up to the given numbers."""
    found_by_workers(docs.sparkSession)
    allowed = (remainder("doc_id", 5) != 0) & F.col("doc_id").isNotNull()
    trusted, web = labels.where(allowed & (F.col("quality") == 1)).select("doc_id").distinct(), docs.where(allowed).select("doc_id")
    kind = lambda k: [F.lit(k == c).alias(c) for c in ("trusted", "web")]
    ids = some_of(trusted, "doc_id", positives, trusted.count(), 1).select(F.col("doc_id").alias("own_id"), *kind("trusted"))
    ids = ids.unionByName(some_of(web, "doc_id", unlabelled, web.count(), 5).select(F.col("doc_id").alias("own_id"), *kind("web")))
    # bounded by the given numbers; texts are read once for both
    ids = ids.groupBy("own_id").agg(F.max("trusted").alias("trusted"), F.max("web").alias("web"))
    sample = texts_of(docs, ids, "own_id", "trusted", "web")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches_of(frames):
            yield pd.DataFrame({"trusted": f["trusted"].to_numpy(), "web": f["web"].to_numpy(), "x": list(features(list(f["text"])))})

    got = sorted(sample.select("trusted", "web", "text").mapInPandas(run, "trusted boolean, web boolean, x array<double>").collect(), key=lambda r: r["x"])
    p, u = (np.asarray([r["x"] for r in got if r[kind]]).reshape(-1, len(FEATURES)) for kind in ("trusted", "web"))
    if not len(p) or not len(u):
        return Model(np.zeros(len(FEATURES)), np.ones(len(FEATURES)), np.zeros(len(FEATURES) + 1), 0.5)
    return fit(p, u, float(np.clip(estimated_prior(p, u), 0.02, 0.98)))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted of every whole text."""

    def run(texts: list[str | None]) -> dict[str, pa.Array]:
        p = model(features(texts))
        return {"score": pa.array(p, pa.float64()), "predicted": pa.array((p >= threshold).astype(np.int32), pa.int32())}

    return with_results(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")), "text", "score double, predicted int", lambda: run)
