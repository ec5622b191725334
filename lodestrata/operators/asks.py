"""Questions of English lexemes ranked over texts that no index holds, a block of texts at a time, as arrays.

A task numbers the asked lexemes, finds where they stand in a block of texts, and joins those postings with the asks in numpy: an ask is
looked up under one of its lexemes, the others in the text's row of a matrix, so work goes with what texts and asks have in common.

Once k matches of an ask are known, the k-th score is the least that counts. What a text can reach at most follows from how often it has two
lexemes: n and m places, n <= m, leave of 1 - rank no less than if each of the n had the m as near as places can be. Asks that a
text can't bring above their least score are not ranked, so pruning changes no result. bounds() finds least scores from some texts
beforehand: tasks tell the scores at a few of their ranks, and the c-th largest of the scores at rank r is one that r * c matches reach.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

from lodestrata.functions import analysis

#: Matches that a task holds before it cuts each ask's to the best k; joined rows, and pairs of places, that are looked at at once.
HELD, JOINED, PLACES = 1_000_000, 1_000_000, 2_000_000
#: Cells of a block's matrix (texts x asked lexemes), texts and characters of a block, about.
CELLS, TEXTS, CHARACTERS = 8_000_000, 256, 2_000_000
#: A score may be rounded up by half a unit of its ninth digit; what is that near to the least is ranked.
SLACK = 2e-9
_NEAR = -analysis._LOG_LEFT[1:-1]
#: The most that n places can take off the logarithm of 1 - rank beside one place: two at each distance.
_MOST = np.concatenate(([0.0], np.cumsum(np.repeat(_NEAR, 2))))
_COUNT = (1 << 20) - 1


class _Numbers(dict):
    """The number of each word's lexeme, -1 if nobody asks for it; emptied once it holds so many."""

    MOST = 250_000

    def __init__(self, terms: list[str]):
        super().__init__()
        self.of = {t: k for k, t in enumerate(terms)}

    def __missing__(self, word: str) -> int:
        if len(self) >= self.MOST:
            self.clear()
        self[word] = found = -1 if word in analysis.STOP_WORDS else self.of.get(analysis.stem(word), -1)
        return found


class Best:
    """The matches of one task: the best k of each ask, by score and then by chunk_id. Of a chunk only id and department stay."""

    def __init__(self, k: int):
        self.k, self.chunks, self.n = k, [], 0
        self._held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.asks = self.scores = self.at = ()

    asks = property(lambda self: self._column(0), lambda self, values: self._put(0, values))
    scores = property(lambda self: self._column(1), lambda self, values: self._put(1, values))
    at = property(lambda self: self._column(2), lambda self, values: self._put(2, values))
    _KINDS = (np.int64, np.float64, np.int64)

    def _arrays(self) -> list[np.ndarray]:
        return [np.concatenate([np.empty(0, kind), *(held[c] for held in self._held if len(held[c]))]).astype(kind) for c, kind in enumerate(self._KINDS)]

    def _column(self, c: int) -> list:
        return self._arrays()[c].tolist()

    def _put(self, c: int, values) -> None:
        held = self._arrays()
        held[c] = np.asarray(values, dtype=self._KINDS[c])
        self._held, self.n = [tuple(held)], len(held[0])

    def add(self, asks: np.ndarray, scores: np.ndarray, at: np.ndarray) -> None:
        self._held.append((asks, scores, at))
        self.n += len(asks)

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        asks, scores, at = self._arrays()
        ids = [i for i, _ in self.chunks]
        place = np.empty(len(ids), dtype=np.int64)
        place[sorted(range(len(ids)), key=ids.__getitem__)] = np.arange(len(ids))
        order = np.lexsort((place[at], -scores, asks))
        asks, scores, at = asks[order], scores[order], at[order]
        first = np.searchsorted(asks, asks)
        best = np.arange(len(asks)) - first < self.k
        self._held, self.n = [(asks[best], scores[best], at[best])], int(best.sum())
        return self._held[0]


@dataclass
class Asks:
    """Asks as arrays: an id, the numbers of its lexemes (those of ask k are flat[starts[k]:starts[k + 1]]), of its set of departments, and its least score (-1 without one)."""

    ids: np.ndarray
    terms: list[str]
    starts: np.ndarray
    flat: np.ndarray
    of_set: np.ndarray
    sets: list[list[str]]
    least: np.ndarray = field(default=None)

    @classmethod
    def from_arrow(cls, ask: pa.Array, q: pa.ListArray, of_set: pa.Array, sets: list[list[str]]) -> Asks:
        flat = q.flatten().dictionary_encode()
        starts = np.concatenate(([0], np.cumsum(q.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
        return cls(ask.to_numpy(), flat.dictionary.to_pylist(), starts, flat.indices.to_numpy().astype(np.int32), of_set.to_numpy().astype(np.int64), sets, np.full(len(ask), -1.0))


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each start on, so many each."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts - starts, counts)


def _parts(weights: np.ndarray, most: int) -> Iterator[slice]:
    """Slices whose weights add up to about most."""
    ends, at = np.cumsum(weights), 0
    while at < len(weights):
        end = max(at + 1, int(np.searchsorted(ends, most + (ends[at - 1] if at else 0), side="right")))
        yield slice(at, end)
        at = end


class _Group:
    """Asks of m lexemes, sorted by the one under which they are looked up (that of them that the fewest asks have) and by how often a text must have it."""

    def __init__(self, asks: Asks, m: int, common: np.ndarray):
        self.m, self.of = m, np.flatnonzero(np.diff(asks.starts) == m)
        q = asks.flat[asks.starts[self.of][:, None] + np.arange(m)]
        self.q = np.take_along_axis(q, np.lexsort((q, common[q])), axis=1)

    def sort(self, least: np.ndarray) -> None:
        own = least[self.of]
        self.need = np.where(own > SLACK, -np.log1p(-np.clip(own - SLACK, 0.0, None)), 0.0)
        count = np.ceil(self.need / _MOST[-1] - 1e-6) if self.m == 2 else np.zeros(len(own))
        key = (self.q[:, 0].astype(np.int64) << 20) | np.clip(count, 0, _COUNT).astype(np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.q, self.of, self.need = key[order], self.q[order], self.of[order], self.need[order]


class Ranker:
    """The best k texts of each ask among those that a task is given."""

    def __init__(self, asks: Asks, k: int, held: int = HELD):
        self.asks, self.best, self.held = asks, Best(k), held
        self.least, self.limit = asks.least.copy(), held
        self.known = _Numbers(asks.terms)
        self.departments = {d: n for n, d in enumerate(sorted({d for s in asks.sets for d in s}))}
        self.allowed = np.zeros((len(asks.sets), len(self.departments)), dtype=bool)
        for n, s in enumerate(asks.sets):
            self.allowed[n, [self.departments[d] for d in s]] = True
        common = np.bincount(asks.flat, minlength=len(asks.terms))
        self.groups = [_Group(asks, int(m), common) for m in np.unique(np.diff(asks.starts)) if m]
        for g in self.groups:
            g.sort(self.least)
        self.rows = int(np.clip(CELLS // max(1, len(asks.terms)), 1, TEXTS))
        self.matrix = np.zeros((self.rows, max(1, len(asks.terms))), dtype=np.int32)
        self.often = np.zeros(1)

    def add(self, ids: list, departments: list[str], texts: Iterator[str | None]) -> None:
        own, held, n = [], [], 0
        for chunk_id, department, text in zip(ids, departments, texts, strict=True):
            if department not in self.departments:
                continue
            own.append((chunk_id, department))
            held.append(text)
            n += len(text or "")
            if len(own) >= self.rows or n >= CHARACTERS:
                self._block(held, own)
                own, held, n = [], [], 0
        if own:
            self._block(held, own)

    def _block(self, texts: list[str | None], own: list[tuple]) -> None:
        found, sizes, names = analysis.words(texts)
        number = np.array([self.known[w] for w in names], dtype=np.int64)
        self.text, self.lexeme, self.first, self.place = analysis.postings(number[found], sizes, len(self.asks.terms))
        if not len(self.first):
            return
        self.n = np.diff(np.append(self.first, len(self.place)))
        # the places of all postings in one order, those of two postings farther from each other than counts
        self.width = int(sizes.max()) + 2 * analysis.REACH + 2
        self.spot = np.repeat(np.arange(len(self.n)), self.n) * self.width + self.place
        self.matrix[self.text, self.lexeme] = np.arange(1, len(self.n) + 1)
        self.department = np.array([self.departments[d] for _, d in own])
        at, before = len(self.best.chunks), self.best.n
        for g in self.groups:
            self._joined(g, at)
        self.matrix[self.text, self.lexeme] = 0
        if self.best.n > before:
            self.best.chunks += own
        if self.best.n > self.limit:
            self._cut()

    def _cut(self) -> None:
        asks, scores, _ = self.best.cut()
        self.limit = self.held + self.best.n
        last = np.flatnonzero(np.arange(len(asks)) - np.searchsorted(asks, asks) == self.best.k - 1)
        self.least[asks[last]] = np.maximum(self.least[asks[last]], scores[last])
        for g in self.groups:
            g.sort(self.least)

    def _joined(self, g: _Group, at: int) -> None:
        low = np.searchsorted(g.key, self.lexeme << 20)
        counts = np.searchsorted(g.key, (self.lexeme << 20) | np.minimum(self.n, _COUNT), side="right") - low
        some = np.flatnonzero(counts)
        for part in _parts(counts[some], JOINED):
            own = some[part]
            posting, row = np.repeat(own, counts[own]), _ranges(low[own], counts[own])
            found = [posting]
            for j in range(1, g.m):
                other = self.matrix[self.text[posting], g.q[row, j]] - 1
                held = np.flatnonzero(other >= 0)
                posting, row, found = posting[held], row[held], [*(f[held] for f in found), other[held]]
            held = self.allowed[self.asks.of_set[g.of[row]], self.department[self.text[posting]]]
            if g.m > 1:
                held &= self._reach(found) >= g.need[row]
            found, row = [f[held] for f in found], row[held]
            scores = self._often(self.n[found[0]]) if g.m == 1 else self._near(found)
            asks = g.of[row]
            held = scores >= self.least[asks]
            self.best.add(asks[held], scores[held], at + self.text[found[0]][held])

    def _reach(self, found: list[np.ndarray]) -> np.ndarray:
        """The most that -log(1 - rank) can be, by how often the lexemes occur."""
        out = np.zeros(len(found[0]))
        for i, a in enumerate(found):
            for b in found[:i]:
                n, m = self.n[a], self.n[b]
                out += np.minimum(n, m) * _MOST[np.minimum(np.maximum(n, m), len(_MOST) - 1)]
        return out

    def _often(self, n: np.ndarray) -> np.ndarray:
        """frequency_rank() of counts, to nine digits."""
        most = int(n.max(initial=0))
        if most >= len(self.often):
            self.often = np.round(np.concatenate(([0.0], np.cumsum(analysis.WEIGHT / np.arange(1, 2 * most + 1) ** 2.0))) / analysis.SQUARES, 9)
        return self.often[n]

    def _near(self, found: list[np.ndarray]) -> np.ndarray:
        """rank() of texts by the places of the lexemes, to nine digits."""
        left = np.zeros(len(found[0]))
        for i, a in enumerate(found):
            for b in found[:i]:
                few, many = np.where(self.n[a] <= self.n[b], a, b), np.where(self.n[a] <= self.n[b], b, a)
                for part in _parts(self.n[few] * np.minimum(self.n[many], 2 * analysis.REACH), PLACES):
                    left[part] += self._nearness(few[part], many[part])
        return np.round(1.0 - np.exp(left), 9)

    def _nearness(self, few: np.ndarray, many: np.ndarray) -> np.ndarray:
        """The logarithm of nearness() of pairs of postings. Only pairs of places within REACH are formed, the others counted."""
        n = self.n[few]
        pair = np.repeat(np.arange(len(few)), n)
        spot = many[pair] * self.width + self.place[_ranges(self.first[few], n)]
        low = np.searchsorted(self.spot, spot - analysis.REACH)
        near = np.searchsorted(self.spot, spot + analysis.REACH, side="right") - low
        far = np.abs(self.spot[_ranges(low, near)] - np.repeat(spot, near))
        total = np.bincount(np.repeat(pair, near), analysis._LOG_LEFT[far], len(few))
        return total + (n * self.n[many] - np.bincount(pair, near, len(few))) * analysis._LOG_LEFT[-1]

    def ranked(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ask ids, scores and places in best.chunks of the best k of each ask."""
        asks, scores, at = self.best.cut()
        return self.asks.ids[asks], scores, at

    def told(self, ranks: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ask ids, ranks and the scores there."""
        asks, scores, _ = self.best.cut()
        place = np.arange(len(asks)) - np.searchsorted(asks, asks) + 1
        some = np.isin(place, ranks)
        return self.asks.ids[asks[some]], place[some], scores[some]
