"""Text analysis for full-text search: a simple analyser in the JVM, an English one with stop words and a stemmer, and ranks."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NOT_WORD = r"[^a-z0-9]+"

#: English stop words of full-text search.
STOP_WORDS = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those am is are was were be been "
    "being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off over under again further then "
    "once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now".split()
)


def tokens(text: Column) -> Column:
    """All words in order: lower case, split at what is neither a-z nor 0-9."""
    return F.array_remove(F.split(F.lower(text), NOT_WORD), "")


def terms(text: Column) -> Column:
    """Distinct words, sorted."""
    return F.array_sort(F.array_distinct(tokens(text)))


# The Porter2 stemmer, from its published definition.
_V = "aeiouy"
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
#: Fixed values of that definition: exceptions, and suffixes with what replaces them.
_EXCEPTIONS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"} | {w: w for w in "sky news howe atlas cosmos bias andes".split()}
_KEPT_AFTER_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
_STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful",
    "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less",
}
_STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize".split()
#: The suffixes of each step, the longest first.
_ENDS2, _ENDS3, _ENDS4 = (tuple(sorted(e, key=len, reverse=True)) for e in ([*_STEP2, "ogi", "li"], [*_STEP3, "ative"], [*_STEP4, "ion"]))


def _region(w: str, start: int) -> int:
    """Where the part after the first non-vowel behind a vowel, from start on, begins."""
    for k in range(start + 1, len(w)):
        if w[k] not in _V and w[k - 1] in _V:
            return k + 1
    return len(w)


def _short_end(w: str) -> bool:
    if len(w) == 2:
        return w[0] in _V and w[1] not in _V
    return len(w) > 2 and w[-1] not in _V + "wxY" and w[-2] in _V and w[-3] not in _V


def stem(word: str) -> str:
    w = word[1:] if word.startswith("'") else word
    if len(w) <= 2:
        return w
    if w in _EXCEPTIONS:
        return _EXCEPTIONS[w]
    w = "".join("Y" if c == "y" and (k == 0 or w[k - 1] in _V) else c for k, c in enumerate(w))
    head = next((p for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = len(head) if head else _region(w, 0)
    r2 = _region(w, r1)
    for s in ("'s'", "'s", "'"):
        if w.endswith(s):
            w = w[: -len(s)]
            break
    # step 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in _V for c in w[:-2]):
        w = w[:-1]
    if w in _KEPT_AFTER_1A:
        return w
    # step 1b
    for s in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if w.endswith(s):
            base = w[: -len(s)]
            if s in ("eed", "eedly"):
                if len(base) >= r1:
                    w = base + "ee"
            elif any(c in _V for c in base):
                w = base
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif w.endswith(_DOUBLES):
                    w = w[:-1]
                elif r1 >= len(w) and _short_end(w):
                    w += "e"
            break
    # step 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    # step 2
    for s in _ENDS2 if w.endswith(_ENDS2) else ():
        if w.endswith(s):
            base = w[: -len(s)]
            if len(base) >= r1:
                if s == "ogi":
                    w = base + "og" if base.endswith("l") else w
                elif s == "li":
                    w = base if base and base[-1] in "cdeghkmnrt" else w
                else:
                    w = base + _STEP2[s]
            break
    # step 3
    for s in _ENDS3 if w.endswith(_ENDS3) else ():
        if w.endswith(s):
            base = w[: -len(s)]
            if s == "ative":
                w = base if len(base) >= r2 else w
            elif len(base) >= r1:
                w = base + _STEP3[s]
            break
    # step 4
    for s in _ENDS4 if w.endswith(_ENDS4) else ():
        if w.endswith(s):
            base = w[: -len(s)]
            if len(base) >= r2 and (s != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    # step 5
    if w.endswith("e"):
        base = w[:-1]
        if len(base) >= r2 or (len(base) >= r1 and not _short_end(base)):
            w = base
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


_WORD = re.compile(r"[a-z0-9]+(?:'[a-z]+)?")


class _Lexemes(dict):
    """The lexeme of each word seen, None for a stop word; emptied once it holds so many, as texts bring new words without end."""

    MOST = 250_000

    def __missing__(self, word: str) -> str | None:
        if len(self) >= self.MOST:
            self.clear()
        self[word] = found = None if word in STOP_WORDS else stem(word)
        return found


_LEXEMES = _Lexemes()


def english(text: str | None) -> dict[str, list[int]]:
    """Lexemes with their positions from 1; stop words have positions but are no lexemes."""
    out: dict[str, list[int]] = {}
    known = _LEXEMES
    for k, word in enumerate(_WORD.findall((text or "").lower()), start=1):
        term = known[word]
        if term is not None:
            held = out.get(term)
            if held is None:
                out[term] = [k]
            else:
                held.append(k)
    return out


#: Types as objects: DDL strings would need a session when this module is imported.
VECTOR = T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("positions", T.ArrayType(T.IntegerType()))]))


#: What stays of the bytes of a text in lower case where words are runs of letters and digits, and where these may hold quotes; others part them.
PLAIN = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for c in range(256))
QUOTED = PLAIN[:39] + b"'" + PLAIN[40:]


def runs(texts: pa.Array, kept: bytes = PLAIN) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The runs of kept bytes of all texts as numbers, how many each text has, and what each number stands for; a null text has none."""
    texts = pc.fill_null(texts, "")
    _, offsets, data = texts.buffers()
    clean = pa.py_buffer(data.to_pybytes().translate(kept) if data else b"")
    split = pc.ascii_split_whitespace(pa.Array.from_buffers(texts.type, len(texts), [None, offsets, clean], offset=texts.offset))
    coded = split.flatten().dictionary_encode()
    found, sizes = coded.indices.to_numpy().astype(np.int64), split.value_lengths().to_numpy().astype(np.int64)
    names = coded.dictionary.to_pylist()
    if "" in names:  # before the first and behind the last of a text
        whole = found != names.index("")
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[whole], minlength=len(sizes))
        found = found[whole]
    return found, sizes, names


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The words of texts, stop words too, as numbers: all of them in order, how many each text has, and what each number stands for."""
    found, sizes, names = runs(pa.array([(t or "").lower() for t in texts], pa.string()), QUOTED)
    quoted = {k: _WORD.findall(name) for k, name in enumerate(names) if "'" in name}
    if not quoted:
        return found, sizes, names
    # a run with quotes holds any number of words
    number = {name: k for k, name in enumerate(names)}
    parts, starts, counts = list(range(len(names))), np.arange(len(names)), np.ones(len(names), dtype=np.int64)
    for k, own in quoted.items():
        starts[k], counts[k] = len(parts), len(own)
        parts += [number.setdefault(w, len(number)) for w in own]
    n = counts[found]
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - starts[found], n)
    text = np.repeat(np.arange(len(sizes)), sizes)
    return np.array(parts)[at], np.bincount(text, n, len(sizes)).astype(np.int64), list(number)


def postings(found: np.ndarray, sizes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where numbered words (under n, negative ones left out) of some texts stand, by text and number: the text, the number, and the first of their places among all; places count from 1 in each text."""
    at = np.flatnonzero(found >= 0)
    text = np.repeat(np.arange(len(sizes)), sizes)[at]
    key = text * n + found[at]
    order = np.argsort(key, kind="stable")
    key, place = key[order], (at - (np.cumsum(sizes) - sizes)[text] + 1)[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, dtype=np.int64)
    return *np.divmod(key[first], max(n, 1)), first, place


def _offsets(sizes: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))


def _vectors(texts: list[str | None]) -> pa.Array:
    found, sizes, names = words(texts)
    lexemes = [_LEXEMES[w] if w else None for w in names]
    terms = sorted({t for t in lexemes if t is not None})
    number = {t: k for k, t in enumerate(terms)}
    text, term, first, place = postings(np.array([number.get(t, -1) for t in lexemes], dtype=np.int64)[found], sizes, len(terms))
    positions = pa.ListArray.from_arrays(_offsets(np.diff(np.append(first, len(place)))), pa.array(place.astype(np.int32)))
    each = pa.StructArray.from_arrays([pa.array(terms, pa.string()).take(pa.array(term)), positions], names=["term", "positions"])
    return pa.ListArray.from_arrays(_offsets(np.bincount(text, minlength=len(sizes))), each)


#: Characters of texts that are turned into columns at once, about.
AT_ONCE = 1 << 20


def vectors(texts: pa.Array) -> pa.Array:
    """english() of texts, terms sorted, straight into Arrow's columns: words become numbers, and no object stands for a term or a row."""
    made, held, n = [], [], 0
    for text in texts:
        held.append(text.as_py())
        n += len(held[-1] or "")
        if n >= AT_ONCE:
            made.append(_vectors(held))
            held, n = [], 0
    return pa.concat_arrays([*made, _vectors(held)])


@F.arrow_udf(VECTOR)
def english_vector(text: pa.Array) -> pa.Array:
    return vectors(text)


@F.arrow_udf(T.ArrayType(T.StringType()))
def english_query(text: pa.Array) -> pa.Array:
    return pa.array([sorted(english(t.as_py())) for t in text], pa.list_(pa.string()))


#: Fixed values of full-text ranks: the weight of an unlabelled lexeme, and the sum of 1/n^2.
WEIGHT, SQUARES = 0.1, 1.64493406685


#: How far apart two words count, and what a pair so many places apart leaves of 1 - rank; the last for all farther ones.
REACH = 100
_LEFT = [1.0, *[1.0 - math.sqrt(WEIGHT * WEIGHT / (1.005 + 0.05 * math.exp(d / 1.5 - 2))) for d in range(1, REACH + 1)], 1.0 - math.sqrt(WEIGHT * WEIGHT * 1e-30)]
_LOG_LEFT = np.log(_LEFT)
#: Pairs of places that are multiplied one by one; more are added up as logarithms, at once.
FEW = 100


def frequency_rank(n: int) -> float:
    """Rank of a text that has the only lexeme asked n times; all weights alike: the largest is the first."""
    return sum(WEIGHT / j**2 for j in range(1, n + 1)) / SQUARES


def nearness(a: list[int], b: list[int]) -> float:
    """The product of what each pair of places leaves of 1 - rank. Only pairs within REACH are formed, the others counted."""
    left = 1.0
    if len(a) * len(b) <= FEW:
        for p in a:
            for q in b:
                left *= _LEFT[min(abs(p - q), REACH + 1)]
        return left
    a, b = np.asarray(min(a, b, key=len), dtype=np.int64), np.asarray(max(b, a, key=len), dtype=np.int64)
    low = np.searchsorted(b, a - REACH)
    n = np.searchsorted(b, a + REACH, side="right") - low
    near = int(n.sum())
    at = np.arange(near) - np.repeat(np.cumsum(n) - n - low, n)
    total = _LOG_LEFT[np.abs(np.repeat(a, n) - b[at])].sum() + (len(a) * len(b) - near) * _LOG_LEFT[-1]
    return math.exp(total)


def rank(vector: dict[str, list[int]], query: list[str]) -> float:
    """Rank of a text for an AND query by how often, or for several lexemes how near to each other, they occur."""
    if not query:
        return 0.0
    if len(query) == 1:
        return frequency_rank(len(vector.get(query[0], ())))
    left = 1.0
    for i, a in enumerate(query):
        for b in query[:i]:
            left *= nearness(vector.get(a, []), vector.get(b, []))
    return 1.0 - left


@F.arrow_udf(T.DoubleType())
def english_rank(vector: pa.Array, query: pa.Array) -> pa.Array:
    """rank() of english_vector() columns, to nine digits: a sum's last bits depend on its order, and ranks that are equal should tie."""
    return pa.array([round(rank({t["term"]: t["positions"] for t in v.as_py() or []}, q.as_py()), 9) for v, q in zip(vector, query, strict=True)], pa.float64())
