"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context windows.

Lexicon: a few fixed terms, and terms and stems (prefixes of STEM_LETTERS letters, which any ending may follow) learned from labelled
texts: what toxic texts have many times as often as others, the longest that loses no support. Whole terms stay beside a stem that
covers them. Whole terms of five letters or more allow one edit, and so do stems of five or more whose misspelled forms clean texts
hardly have; words that only an edit brings near a term, but that clean texts of the sample use, are ordinary and no match, and a
whole term near which clean texts keep bringing new words allows no edit. The trie
of the terms is intersected with Levenshtein automata and the result is determinised once into tables (one without edits, which goes
first, and one with them); a batch's words then run through a table together, a character a step.

Each match is scored by the window around it: matches nearby add to it, and one between quotation marks or after a word of report
counts as quotation, not as abuse. A misspelled match is evidence like a plain one. A logistic regression over these window features
gives the score; it is fitted on a bounded sample of labelled rows, on their copies in which every matched term is misspelled
(labelled alike), and on copies in which every matched term is quoted (labelled clean). Weights of evidence are kept at or above 0.

Cases: null and empty texts have no words and get the score of a text without matches; texts repeat as often as they come; rows
without matches, whatever their length, get one and the same score; labels that repeat or contradict one another count once, as
toxic if any says so; without labels of both classes the weights are fixed ones; characters beyond U+FFFF divide words;
an empty table gives no rows; columns other than doc_id and text are passed on by clean() and ignored by score().
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import cut, slices, with_results
from lodestrata.llm.hashing import code_points, lowered
from lodestrata.llm.learning import batches_of, class_weights, fit_logistic, labelled, logistic, remainder
from lodestrata.session import found_by_workers

THRESHOLD = 0.7
#: Labelled rows a class to learn from, at most.
A_CLASS = 3000
#: Learned lexicon entries, at most; None is all, whose number the sample and the support they need bound.
ENTRIES: int | None = None
#: Letters of stems; support and odds that an entry needs; shares of clean texts up to which a stem's misspelled forms may come, and
#: forms near a whole term that no text before had.
STEM_LETTERS = (4, 12)
SUPPORT, ODDS, MISSPELLED_CLEAN, NEW_CLEAN = 4, 50.0, 0.002, 0.0005
WINDOW = 12
#: Terms that are always in the lexicon, and words that announce quotation.
TERMS = "asshole bastard bitch clown crap creep cretin disgusting dumbass fool freak garbage idiot imbecile jerk kill loser moron pathetic scum stupid trash ugly worthless".split()
REPORTS = "said says saying wrote writes called calls quoted quote quotes quoting reported dit dijo sagte schrieb escribió écrit".split()
QUOTES = "\"“”„«»"
#: Weights used where labels of both classes are missing; in the order of features(), the intercept last.
FIXED_WEIGHTS = (1.5, 2.0, 1.0, 0.0, 1.0, -1.0, -3.0)


def allowance(entry: str) -> int:
    """Edits that an entry allows: one for whole terms ("term$") and open stems ("stem~") of five letters or more, none for closed
    whole terms ("term!$")."""
    return int(entry[-1:] in ("$", "~") and not entry.endswith("!$") and len(entry) >= 6)


def bare(entry: str) -> str:
    return entry.rstrip("!$~")


class Table:
    """A deterministic table of the trie of terms (ending in "$": whole words; else stems) and the edits allowed."""

    def __init__(self, entries: list[tuple[int, str, int]], symbol: np.ndarray, size: int):
        children: list[dict[int, int]] = [{}]
        wholes, stems = [-1], [-1]  # of each node: the whole term and the stem that end there
        room = [0]  # edits the terms below allow
        allowed = {}
        for n, e, edits in entries:
            node, allowed[n] = 0, edits
            room[0] = max(room[0], edits)
            for c in bare(e):
                s = int(symbol[ord(c)]) if ord(c) < 0x10000 else 0
                if s not in children[node]:
                    children[node][s] = len(children)
                    children.append({})
                    wholes.append(-1)
                    stems.append(-1)
                    room.append(0)
                node = children[node][s]
                room[node] = max(room[node], edits)
            (wholes if e.endswith("$") else stems)[node] = n

        def closed(states: dict[int, int]) -> frozenset:
            """With a term's letters left out, one edit each."""
            todo = list(states.items())
            while todo:
                node, used = todo.pop()
                for child in children[node].values():
                    if used + 1 <= room[child] and states.get(child, 9) > used + 1:
                        states[child] = used + 1
                        todo.append((child, used + 1))
            return frozenset(states.items())

        start = closed({0: 0})
        number, rows, queue = {start: 1}, [[0] * size, [0] * size], [start]
        accept = [(-1, 9), (-1, 9)]
        stem_of: dict[tuple[int, int], int] = {}
        for at in queue:
            k = number[at]
            row = rows[k]
            best = (-1, 9)
            for node, used in sorted(at):
                n = wholes[node]
                if n >= 0 and used <= allowed[n] and used < best[1]:
                    best = (n, used)
            accept[k] = best
            for s in range(size):
                to: dict[int, int] = {}
                for node, used in at:
                    child = children[node].get(s) if s else None
                    if child is not None and (used <= room[child] or used == 0):
                        to[child] = min(to.get(child, 9), used)
                    if used + 1 <= room[node]:  # a letter too many
                        to[node] = min(to.get(node, 9), used + 1)
                    for other, c in children[node].items():  # another letter instead
                        if other != s and used + 1 <= room[c]:
                            to[c] = min(to.get(c, 9), used + 1)
                if not to:
                    continue
                key = closed(to)
                stem = min(((used, stems[node]) for node, used in key if stems[node] >= 0 and used <= allowed[stems[node]]), default=None)
                if stem is not None:  # whatever follows
                    if stem not in stem_of:
                        stem_of[stem] = len(rows)
                        rows.append([len(rows)] * size)
                        accept.append((stem[1], stem[0]))
                    row[s] = stem_of[stem]
                    continue
                if key not in number:
                    number[key] = len(rows)
                    rows.append([0] * size)
                    accept.append((-1, 9))
                    queue.append(key)
                row[s] = number[key]
        self.next = np.asarray(rows, dtype=np.int32)
        self.entry = np.asarray([a for a, _ in accept], dtype=np.int32)
        self.edits = np.asarray([e for _, e in accept], dtype=np.int32)

    def __call__(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the given words those that match, their entries and edits."""
        state, at = np.ones(len(word), dtype=np.int32), starts[word]
        out = [(word[:0], self.entry[:0], self.edits[:0])]
        while len(word):
            state = self.next[state, symbols[at]]
            at = at + 1
            over = at >= ends[word]
            hit = over & (self.entry[state] >= 0)
            if hit.any():
                out.append((word[hit], self.entry[state[hit]], self.edits[state[hit]]))
            go = (state != 0) & ~over
            word, state, at = word[go], state[go], at[go]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Matcher:
    """The tables of a lexicon: of all entries without edits, and of those that allow edits with them."""

    def __init__(self, entries: list[str], ordinary: frozenset[str] = frozenset(), edits: bool = True):
        letters = sorted({c for e in entries for c in bare(e)})
        self.ordinary = ordinary
        self.symbol = np.zeros(0x10000, dtype=np.int32)  # 0: any other character
        for i, c in enumerate(letters):
            if ord(c) < 0x10000:
                self.symbol[ord(c)] = i + 1
        numbered = list(enumerate(entries))
        self.plain = Table([(n, e, 0) for n, e in numbered], self.symbol, len(letters) + 1)
        self.fuzzy = Table([(n, e, 1) for n, e in numbered if allowance(e)], self.symbol, len(letters) + 1) if edits else None

    def __call__(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """word (its index), entry and edits of every word that matches; without edits where that is possible."""
        symbols = self.symbol[np.minimum(points, 0xFFFF)]
        word, entry, edits = self.plain(symbols, starts, ends, np.arange(len(starts)))
        if self.fuzzy is not None:
            others = np.ones(len(starts), dtype=bool)
            others[word] = False
            w, e, d = self.fuzzy(symbols, starts, ends, np.flatnonzero(others))
            if self.ordinary and len(w):
                go = np.fromiter((points[starts[k] : ends[k]].tobytes().decode("utf-32-le", "replace") not in self.ordinary for k in w), dtype=bool, count=len(w))
                w, e, d = w[go], e[go], d[go]
            word, entry, edits = np.concatenate([word, w]), np.concatenate([entry, e]), np.concatenate([edits, d])
        order = np.argsort(word, kind="stable")
        return word[order], entry[order], edits[order]


@lru_cache(maxsize=4)
def matcher_of(entries: tuple[str, ...], ordinary: frozenset[str] = frozenset(), edits: bool = True) -> Matcher:
    """One for each worker process and lexicon: the tables outlive a task."""
    return Matcher(list(entries), ordinary, edits)


_LETTER = np.zeros(0x10000, dtype=bool)
for _c in range(0x10000):
    _LETTER[_c] = chr(_c).isalnum()


def split_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the joined texts, the start and end of every word in them, and the start of every text."""
    joined = "\n".join(texts) + "\n"
    points = code_points(joined)
    inside = np.zeros(len(points) + 2, dtype=np.int8)
    inside[1:-1] = _LETTER[np.minimum(points, 0xFFFF)] & (points < 0x10000)
    step = np.diff(inside)
    first = np.cumsum([0] + [len(t) + 1 for t in texts])
    return points, np.flatnonzero(step == 1), np.flatnonzero(step == -1), first


#: Of these the first EVIDENCE speak for toxicity.
FEATURES = ("any", "several", "matches", "fuzzy", "dense", "quoted")
EVIDENCE = 5


def features(texts: list[str], matcher: Matcher) -> tuple[np.ndarray, list[list[tuple[int, int, int, int, bool]]]]:
    """A row of FEATURES for each text, and its matches (start, end, entry, edits, quoted)."""
    low = [lowered(t) for t in texts]
    points, starts, ends, first = split_words(low)
    word, entry, edits = matcher(points, starts, ends)
    text_of = np.searchsorted(first, starts[word], side="right") - 1
    n_words = np.diff(np.searchsorted(starts, first))
    x, spans = np.zeros((len(texts), len(FEATURES))), [[] for _ in texts]
    reports = set(REPORTS)
    for t in np.unique(text_of):
        own = np.flatnonzero(text_of == t) if len(word) < 64 else np.arange(*np.searchsorted(text_of, [t, t + 1]))
        whole = texts[t]
        positions = word[own]
        plain = fuzzy = quoted = 0.0
        nearest = 0
        for j, k in enumerate(own):
            s, e = int(starts[word[k]] - first[t]), int(ends[word[k]] - first[t])
            # from the end of the word before the window to the start of the one behind it, so that marks at its ends count
            lo = max(0, int(ends[word[k] - WINDOW - 1] - first[t])) if word[k] > WINDOW else 0
            hi = min(len(whole), int(starts[word[k] + WINDOW + 1] - first[t])) if word[k] + WINDOW + 1 < len(starts) else len(whole)
            before, after = whole[lo:s], whole[e:hi]
            opened = sum(before.count(q) for q in QUOTES) % 2 == 1 and any(q in after for q in QUOTES)
            told = opened or any(w.strip(".,:;'" + QUOTES) in reports for w in before.lower().split()[-3:])
            around = int(np.searchsorted(positions, positions[j] + WINDOW, side="right") - np.searchsorted(positions, positions[j] - WINDOW))
            nearest = max(nearest, around)
            if told:
                quoted += 1
            elif edits[k]:
                fuzzy += 1
            else:
                plain += 1
            spans[t].append((s, e, int(entry[k]), int(edits[k]), told))
        total = plain + fuzzy
        dense = min(3.0, np.log1p(1000 * total / max(1, n_words[t])) / 2 + (nearest - 1) / WINDOW) if total else 0.0
        x[t] = (float(total > 0), float(total >= 2), np.log1p(total), np.log1p(fuzzy), dense, np.log1p(quoted))
    return x, spans


@dataclass
class Model:
    """Lexicon ("term$", "stem" or, open to an edit, "stem~"), words that no edit makes a match, weights (the intercept last)."""

    entries: list[str]
    weights: np.ndarray
    ordinary: frozenset[str] = frozenset()

    def matcher(self) -> Matcher:
        return matcher_of(tuple(self.entries), self.ordinary)


def learn_entries(sample: DataFrame, entries: int | None = ENTRIES, support: int = SUPPORT, times: float = ODDS) -> list[str]:
    """The lexicon: TERMS and what sample (text, y) teaches, as "term$" or "stem"."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        least, most = STEM_LETTERS
        for b in batches_of(frames):
            of = (Counter(), Counter())
            for text, y in zip(b["text"], b["y"], strict=True):
                low = lowered(text or "")
                points, starts, ends, _ = split_words([low])
                own = set()
                for w in {low[s:e] for s, e in zip(starts, ends, strict=True)}:
                    if not w.isdigit():
                        own.update(w[:k] for k in range(least, min(len(w), most) + 1))
                        if len(w) >= 4:
                            own.add(w + "$")
                of[int(y)].update(own)
            keys = list(of[0].keys() | of[1].keys())
            yield pd.DataFrame({"term": keys, "pos": [of[1][k] for k in keys], "neg": [of[0][k] for k in keys]})

    n = {int(r["y"]): int(r["n"]) for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        return [t + "$" for t in TERMS]
    counts = sample.select("text", "y").mapInPandas(count, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    odds = ((F.col("pos") + 0.5) / n[1]) / ((F.col("neg") + 0.5) / n[0])
    # each row needs its support among the sample's texts, which bounds how many there are
    found = counts.where((F.col("pos") >= max(support, 0.005 * n[1])) & (odds >= times)).orderBy(F.desc("pos"), F.desc(F.length("term")), "term").collect()
    chosen: set[str] = set()
    stems: set[str] = set()
    begun: set[str] = set()  # all prefixes of what is chosen
    beside: set[str] = set()  # whole terms that others cover: beyond the bound, so that they displace nothing
    for r in found:
        term, own = r["term"], bare(r["term"])
        if own in begun or any(own[:k] in stems for k in range(1, len(own) + 1)):
            if term.endswith("$"):
                beside.add(term)
        elif entries is None or len(chosen) < entries:
            chosen.add(term)
            begun.update(own[:k] for k in range(1, len(own) + 1))
            if not term.endswith("$"):
                stems.add(own)
    learned = chosen | beside
    fixed = [t + "$" for t in TERMS if t + "$" not in learned]
    return sorted(learned) + fixed


def opened(sample: DataFrame, entries: list[str]) -> tuple[list[str], frozenset[str]]:
    """The lexicon with its stems open to an edit where clean texts hardly have such forms, its whole terms closed where clean texts
    keep bringing new forms near them (by Good and Turing: as often as forms that one text alone has), and the ordinary words near
    whole terms: those that two clean texts of the sample have, or one and no toxic text."""
    wide = [e if e.endswith("$") or len(e) < 5 else e + "~" for e in entries]

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = matcher_of(tuple(wide))
        for b in batches_of(frames):
            for text, y in zip(b["text"], b["y"], strict=True):
                low = lowered(text or "")
                points, starts, ends, _ = split_words([low])
                word, entry, edits = matcher(points, starts, ends)
                own = {(int(e), low[starts[w] : ends[w]] if wide[e].endswith("$") else "") for w, e, d in zip(word, entry, edits, strict=True) if d}
                if own:
                    yield pd.DataFrame({"entry": [e for e, _ in own], "form": [f for _, f in own], "y": [int(y)] * len(own)})

    got = sample.select("text", "y").mapInPandas(count, "entry int, form string, y int").groupBy("entry", "form").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")).where("neg > 0").collect()
    clean = sample.where("y = 0").count()
    often = {r["entry"] for r in got if not r["form"] and r["neg"] > MISSPELLED_CLEAN * clean}
    once = Counter(r["entry"] for r in got if r["form"] and r["neg"] == 1)
    busy = {e for e, n in once.items() if n > max(1, NEW_CLEAN * clean)}
    ordinary = frozenset(r["form"] for r in got if r["form"] and r["entry"] not in busy and (r["neg"] > 1 or not r["pos"]))
    return [e if k in often else e[:-1] + "!$" if k in busy else w for k, (e, w) in enumerate(zip(entries, wide, strict=True))], ordinary


def misspelled(word: str, r: np.random.Generator) -> str:
    """With one letter doubled, left out, changed or swapped in."""
    k, kind = int(r.integers(1, len(word))), int(r.integers(4))
    other = "abcdefghijklmnopqrstuvwxyz"[int(r.integers(26))]
    return (word[:k] + word[k - 1 :], word[:k] + word[k + 1 :], word[:k] + other + word[k + 1 :], word[:k] + other + word[k:])[kind]


def with_copies(texts: list[str], y: np.ndarray, matcher: Matcher, seed: int = 5) -> tuple[list[str], list[int], list[float]]:
    """Texts, labels and weights: the given ones and, of each toxic one, a copy with its matched terms misspelled and one with them quoted."""
    _, spans = features(texts, matcher)
    out, label, weight = list(texts), [int(v) for v in y], [1.0] * len(texts)
    for text, own, v in zip(texts, spans, y, strict=True):
        own = [s for s in own if not s[3] and s[1] - s[0] >= 5]
        if v == 1 and own:
            r = np.random.default_rng([seed, len(text), len(own)])
            wrong, told, at = [], [], 0
            for s, e, *_ in own:
                wrong += [text[at:s], misspelled(text[s:e], r)]
                told += [text[at:s], 'said "', text[s:e], '"']
                at = e
            out += ["".join([*wrong, text[at:]]), "".join([*told, text[at:]])]
            label += [1, 0]
            weight += [0.25, 0.25]
    return out, label, weight


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic weights; a feature of evidence whose weight would be under 0 is left out, with weight 0."""
    use = np.ones(x.shape[1], dtype=bool)
    while True:
        got = fit_logistic(x[:, use], y, weight)
        beta = np.zeros(x.shape[1] + 1)
        beta[np.append(use, True)] = got
        below = np.flatnonzero(beta[:EVIDENCE] < 0)
        if not len(below):
            return beta
        use[below[np.argmin(beta[below])]] = False


def train(docs: DataFrame, labels: DataFrame, a_class: int = A_CLASS) -> Model:
    """From rows whose crc32(doc_id as text) mod 3 is not 1, a_class of each class at most."""
    found_by_workers(docs.sparkSession)
    sample, sizes = labelled(docs, labels, "toxic", remainder("doc_id", 3) != 1, a_class)
    sample = cut(sample.select("text", "y"))  # bounded by a_class, and read several times
    entries, ordinary = opened(sample, learn_entries(sample))

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = matcher_of(tuple(entries), ordinary)
        for b in batches_of(frames):
            texts, y, weight = with_copies([t or "" for t in b["text"]], b["y"].to_numpy(), matcher)
            yield pd.DataFrame({"y": y, "weight": weight, "copy": [k >= len(b) for k in range(len(y))], "x": list(features(texts, matcher)[0])})

    got = sample.mapInPandas(measure, "y int, weight double, copy boolean, x array<double>").collect()
    y, own = np.asarray([r["y"] for r in got]), np.asarray([not r["copy"] for r in got], dtype=bool)
    if len(set(y[own].tolist())) < 2:
        return Model(entries, np.asarray(FIXED_WEIGHTS), ordinary)
    x, weight = np.asarray([r["x"] for r in got]), np.asarray([r["weight"] for r in got])
    weight[own] *= class_weights(y[own], sizes)
    return Model(entries, fit(x, y, weight), ordinary)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted, n_matches and matches (start, end, term, edits, quoted) of every whole text."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("term", pa.string()), ("edits", pa.int32()), ("quoted", pa.bool_())]))

    def make():
        matcher = model.matcher()

        def run(texts: list[str | None]) -> dict[str, pa.Array]:
            x, spans = features([t or "" for t in texts], matcher)
            p = logistic(x, model.weights)
            found = [[{"start": s, "end": e, "term": bare(model.entries[n]), "edits": d, "quoted": q} for s, e, n, d, q in own] for own in spans]
            return {
                "score": pa.array(p, pa.float64()), "predicted": pa.array((p >= threshold).astype(np.int32), pa.int32()),
                "n_matches": pa.array([len(s) for s in spans], pa.int64()), "matches": pa.array(found, kind),
            }

        return run

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return with_results(own, "text", "score double, predicted int, n_matches long, matches array<struct<start:int,end:int,term:string,edits:int,quoted:boolean>>", make)


def clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, whose score is under threshold."""
    text = docs.columns[[c.lower() for c in docs.columns].index("text")]
    found_by_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = model.matcher()
        for b in batches:
            for part in slices(b, text):
                x, _ = features([t or "" for t in part.column(part.schema.get_field_index(text)).to_pylist()], matcher)
                yield part.filter(pa.array(logistic(x, model.weights) < threshold))

    return docs.mapInArrow(run, docs.schema)
