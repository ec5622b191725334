"""Language identification by a byte convolutional network.

Windows of a fixed length of a text's lowered UTF-8 bytes go through an embedding, convolutions of several widths, a rectifier, the
maximum over the window and a softmax; the network is trained in numpy by Adam on a bounded sample of labelled texts, cut to windows
of different fullness. A whole text is its windows, which overlap so that no filter misses a place; their probabilities are averaged
by the bytes they hold. Trained filters are folded into tables of bytes and byte pairs, so applying one is a few look-ups a byte.

Cases: null text, and text without a letter, is ``und`` with score 0; texts repeat with the same result; very long texts are read
whole, some windows at a time; without labelled rows all is ``und``; with one language that is the answer for all texts with letters;
an empty table gives no rows; lang, source and doc_id are never read to predict; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.common import with_results
from lodestrata.llm.learning import batches_of, cutoff, remainder, share, texts_of
from lodestrata.session import found_by_workers

LENGTH = 192
WIDTHS = (2, 3, 4)
FILTERS, EMBEDDING = 16, 8
#: Labelled texts to learn from, at most: of each language, and of all. Windows of each text.
A_LANGUAGE, IN_ALL, WINDOWS = 1500, 12000, 3
_LETTER = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]")


def has_letter(text: str) -> bool:
    return bool(_LETTER.search(text)) or any(c.isalpha() for c in text)


def windows_of(data: bytes, length: int = LENGTH) -> np.ndarray:
    """All windows of the bytes, the last filled with zeros; each begins with the last bytes of the one before."""
    step = length - max(WIDTHS) + 1
    n = max(1, -(-(len(data) - max(WIDTHS) + 1) // step))
    padded = np.zeros(n * step + max(WIDTHS) - 1, dtype=np.uint8)
    padded[: len(data)] = np.frombuffer(data, dtype=np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, length)[::step]


@dataclass
class Network:
    languages: list[str]
    embedding: np.ndarray
    filters: dict[int, np.ndarray]  # width: (width, EMBEDDING, FILTERS)
    biases: dict[int, np.ndarray]
    dense: np.ndarray
    offset: np.ndarray

    def tables(self) -> dict[int, list[tuple[int, np.ndarray]]]:
        """For each width, (place, table) whose look-ups add up to the convolution: pairs of bytes first, then single bytes."""
        out = {}
        for w, f in self.filters.items():
            single = [(self.embedding @ f[j]).astype(np.float32) for j in range(w)]
            single[0] = single[0] + self.biases[w].astype(np.float32)
            out[w] = [(j, (single[j][:, None, :] + single[j + 1][None, :, :]).reshape(65536, -1)) for j in range(0, w - 1, 2)]
            if w % 2:
                out[w].append((w - 1, single[w - 1]))
        return out

    def pooled(self, windows: np.ndarray, tables) -> np.ndarray:
        out = []
        pairs = windows[:, :-1].astype(np.int32) * 256 + windows[:, 1:]
        n = windows.shape[1]
        for w, parts in tables.items():
            total = None
            for j, t in parts:
                index = pairs[:, j : j + n - w + 1] if len(t) == 65536 else windows[:, j : j + n - w + 1]
                total = t[index] if total is None else total + t[index]
            out.append(np.maximum(total.max(axis=1), 0))
        return np.hstack(out)

    def probabilities(self, windows: np.ndarray, tables) -> np.ndarray:
        z = self.pooled(windows, tables) @ self.dense + self.offset
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def train_network(windows: np.ndarray, y: np.ndarray, languages: list[str], steps: int = 700, batch: int = 192, rate: float = 0.004, seed: int = 11) -> Network:
    """Cross-entropy by Adam; the maximum passes its gradient to one place a filter, so a step touches few rows."""
    r = np.random.default_rng(seed)
    p: dict[str, np.ndarray] = {"e": r.normal(0, 0.3, (256, EMBEDDING)), "d": r.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))), "o": np.zeros(len(languages))}
    for w in WIDTHS:
        p[f"f{w}"], p[f"b{w}"] = r.normal(0, 1 / np.sqrt(w * EMBEDDING), (w, EMBEDDING, FILTERS)), np.zeros(FILTERS)
    p = {k: x.astype(np.float32) for k, x in p.items()}
    p["e"][0] = 0
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    by_class = [np.flatnonzero(y == c) for c in range(len(languages))]
    for t in range(1, steps + 1):
        # languages in turn, whatever their shares
        own = np.concatenate([r.choice(c, max(1, batch // len(by_class))) for c in by_class if len(c)])
        x, of = windows[own], y[own]
        rows = np.arange(len(own))
        # all filters' places in one product, a row each, so that sums and maxima run along the text
        every = np.ascontiguousarray(np.concatenate([p[f"f{w}"][j] for w in WIDTHS for j in range(w)], axis=1).T)
        made = (every @ np.take(np.ascontiguousarray(p["e"].T), x.ravel(), axis=1)).reshape(sum(WIDTHS), FILTERS, len(own), -1)
        hidden, where, first = [], {}, 0
        for w in WIDTHS:
            n = x.shape[1] - w + 1
            z = made[first][:, :, :n] + made[first + 1][:, :, 1 : n + 1]
            for j in range(2, w):
                z += made[first + j][:, :, j : j + n]
            first += w
            where[w] = z.argmax(axis=2).T
            hidden.append(np.take_along_axis(z, where[w].T[:, :, None], axis=2)[:, :, 0].T + p[f"b{w}"])
        h = np.hstack(hidden)
        a = np.maximum(h, 0)
        z = a @ p["d"] + p["o"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        q = z / z.sum(axis=1, keepdims=True)
        q[rows, of] -= 1
        q /= len(own)
        g = {k: np.zeros_like(u) for k, u in p.items()}
        g["d"], g["o"] = a.T @ q + 1e-4 * p["d"], q.sum(axis=0)
        back = (q @ p["d"].T) * (h > 0)
        for i, w in enumerate(WIDTHS):
            gh = back[:, i * FILTERS : (i + 1) * FILTERS]
            g[f"b{w}"] = gh.sum(axis=0)
            for j in range(w):
                at = x[rows[:, None], where[w] + j]  # the byte under each filter's best place
                g[f"f{w}"][j] = (p["e"][at] * gh[:, :, None]).sum(axis=0).T
                back_e = gh[:, :, None] * p[f"f{w}"][j].T[None]
                cells = at.astype(np.int64)[:, :, None] * EMBEDDING + np.arange(EMBEDDING)
                g["e"] += np.bincount(cells.ravel(), weights=back_e.ravel(), minlength=256 * EMBEDDING).reshape(256, EMBEDDING).astype(np.float32)
        g["e"][0] = 0
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
            p[k] = (p[k] - rate * (1 - 0.9 * t / steps) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    p["e"][0] = 0
    return Network(languages, p["e"], {w: p[f"f{w}"] for w in WIDTHS}, {w: p[f"b{w}"] for w in WIDTHS}, p["d"].astype(np.float32), p["o"].astype(np.float32))


def train(docs: DataFrame, a_language: int = A_LANGUAGE, in_all: int = IN_ALL, n_windows: int = WINDOWS) -> Network:
    """From text and non-null lang of rows whose crc32(doc_id as text) mod 3 is not 1."""
    found_by_workers(docs.sparkSession)
    own = docs.select("doc_id", "lang", "text").where((remainder("doc_id", 3) != 1) & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["n"] for r in own.where("doc_id is not null").groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Network([], *[None] * 5)
    each = max(1, min(a_language, in_all // len(languages)))
    # ids only, chosen by a hash: a language's rows are cut to about twice what is wanted before they are ranked, so a common one is
    # no more work than others
    under = F.element_at(F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, cutoff(each, n))]), F.col("lang"))
    first = Window.partitionBy("lang").orderBy(share("doc_id"), "doc_id")
    ids = own.where(F.col("doc_id").isNotNull() & (share("doc_id") < under)).select("doc_id", "lang").withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= each)
    ids = ids.groupBy(F.col("doc_id").alias("own_id")).agg(F.min("lang").alias("own_lang"))
    number = {lang: k for k, lang in enumerate(languages)}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches_of(frames):
            rows = []
            for text, lang, key in zip(f["text"], f["lang"], f["own_id"], strict=True):
                if text and has_letter(text):
                    r = np.random.default_rng(abs(int(key)) % (1 << 32))
                    data = text.lower().encode("utf-8", "replace")
                    for k in range(n_windows):
                        size = LENGTH if k == 0 else int(r.integers(24, LENGTH))
                        at = int(r.integers(0, max(1, len(data) - size + 1)))
                        part = data[at : at + size]
                        rows.append((number[lang], part + b"\0" * (LENGTH - len(part))))
            yield pd.DataFrame(rows, columns=["y", "w"])

    rows = texts_of(own, ids, "own_id", "own_lang").select("text", F.col("own_lang").alias("lang"), F.col("doc_id").alias("own_id"))
    got = rows.mapInPandas(run, "y int, w binary").collect()
    if not got:
        return Network([], *[None] * 5)
    got.sort(key=lambda r: (r["y"], bytes(r["w"])))
    x = np.frombuffer(b"".join(bytes(r["w"]) for r in got), dtype=np.uint8).reshape(-1, LENGTH)
    return train_network(x, np.asarray([r["y"] for r in got]), languages)


def predict(docs: DataFrame, network: Network) -> DataFrame:
    """doc_id, lang_pred, score of every whole text."""

    def make():
        tables = network.tables() if network.languages else None

        def run(texts: list[str | None]) -> dict[str, pa.Array]:
            lang, top = ["und"] * len(texts), np.zeros(len(texts))
            some = [k for k, t in enumerate(texts) if t and network.languages and has_letter(t)]
            if some:
                made = [windows_of(texts[k].lower().encode("utf-8", "replace")) for k in some]
                owner = np.repeat(np.arange(len(some)), [len(w) for w in made])
                every = np.concatenate(made)
                p = np.concatenate([network.probabilities(every[lo : lo + 128], tables) for lo in range(0, len(every), 128)])
                weight = (every != 0).sum(axis=1).astype(float)
                total = np.zeros((len(some), len(network.languages)))
                np.add.at(total, owner, p * weight[:, None])
                total /= total.sum(axis=1, keepdims=True)
                for k, row in zip(some, total, strict=True):
                    best = int(row.argmax())
                    lang[k], top[k] = network.languages[best], float(row[best])
            return {"lang_pred": pa.array(lang, pa.string()), "score": pa.array(np.clip(top, 0, 1), pa.float64())}

        return run

    return with_results(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")), "text", "lang_pred string, score double", make)
