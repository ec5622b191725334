"""Substring dedup by hashing lines and their parts.

Units: a line is cut behind each word that ranks first among the REACH words on either side of it (words that end a sentence rank
before others, else a hash decides); so only what is near decides, and a passage copied from anywhere into the middle of another line
falls, but for its ends, into the same units in both. Runs of up to REACH
words that recur in turn are cut about every eighth word. What is too short at a line's ends
belongs to the part next to it. A unit is normalised (lower case, words without the marks around them) and digested to 128 bits.
Digests are grouped over all texts; the occurrence of the earliest rank (doc_id, then place in the text) stays, every other goes.
Parts of lines count from LEAST_WORDS words, whole lines from LEAST_LINE; as a few words recur by chance, neighbouring units inside a
line go only if they have LEAST_RUN words together. Lines under LEAST_LINE words that follow one another are cut as one line (best
behind a line), and their parts go like those inside a line. What is still too short to count is digested together with the units on
either side, so it goes within a repeated passage and stays elsewhere. What goes is reported as spans of the original text.

At scale: a digest's occurrences are never gathered; the earliest text is a minimum, taken before the shuffle too, and only digests
that occur twice meet their occurrences again, in a join whose hot keys can be split. Each text is shuffled once, to meet the
numbers of its units that go.

Cases: null text stays null and has no units; empty and blank texts have none; a null doc_id ranks last, by the text's hash; rows
that repeat a doc_id are one document, whose rows keep what they share; texts whose every unit is a copy keep what is too short to
count, or nothing; repeats inside a text go too; very long lines are cut like others; an empty table gives no rows; other columns are
passed on, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import by_bytes, cut, fresh, mix64, quoted, slices
from lodestrata.llm.hashing import BASE, code_points, hashed, lowered, powers, runs
from lodestrata.session import found_by_workers

#: Words from which a part of a line counts, and a whole line.
LEAST_WORDS, LEAST_LINE = 6, 3
#: Words from which neighbouring parts inside a line go.
LEAST_RUN = 13
#: Words on either side that a cut is chosen among, and the length (at least) that runs of so many words in turn are cut to.
REACH, RUN = 5, 8
MARKS = ".,;:!?\"'()[]|*#$%&-–—…«»“”"
ENDS = ".!?"
SECOND = 0xD1342543DE82EF95
#: Characters that are worked at once.
AT_ONCE = 1 << 19

_SPACE, _MARK, _END = (np.zeros(0x10000, dtype=bool) for _ in range(3))
for _c in range(0x10000):
    _SPACE[_c] = chr(_c).isspace()
_MARK[[ord(c) for c in MARKS]] = True
_END[[ord(c) for c in ENDS]] = True


@dataclass
class Units:
    """Of several texts: text (which), number (in it), start, end (code points in it), words, begins and finishes (a line, or short
    lines that adjoin), counts (by itself), short (of lines too short to count), between (counts with its neighbours), d1, d2 (digest)."""

    text: np.ndarray
    number: np.ndarray
    start: np.ndarray
    end: np.ndarray
    words: np.ndarray
    begins: np.ndarray
    finishes: np.ndarray
    counts: np.ndarray
    short: np.ndarray
    between: np.ndarray
    d1: np.ndarray
    d2: np.ndarray


def _total(mask: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])


def cuts(h: np.ndarray, ends_sentence: np.ndarray, line_end: np.ndarray) -> np.ndarray:
    """Behind which words a line is cut; h: the words' hashes."""
    key = (h >> np.uint64(1)) | (np.uint64(1 << 63) * (~ends_sentence).astype(np.uint64))
    line = _total(line_end)[:-1]
    out = np.ones(len(h), dtype=bool)
    for k in range(1, min(REACH, len(h) - 1) + 1):
        near = line[k:] == line[:-k]
        out[k:] &= ~near | (key[k:] < key[:-k])  # before all that precede it, and not behind any that follow
        out[:-k] &= ~near | (key[:-k] <= key[k:])
    # where up to REACH words recur in turn none is first; cut by place, so that the parts are alike
    place, covered = np.arange(len(h)), np.zeros(len(h), dtype=bool)
    for p in range(1, min(REACH, len(h) - 1) + 1):
        same = np.zeros(len(h), dtype=bool)
        same[p:] = (h[p:] == h[:-p]) & (line[p:] == line[:-p]) & ~covered[p:]
        start = np.maximum.accumulate(np.where(same, 0, place))
        step = -(-RUN // p) * p
        out |= same & ((place - start + p) % step == 0)
        if p < REACH:
            covered |= same & (np.bincount(start, minlength=len(h))[start] > step - p)
    return out


def units(texts: list[str | None], least_words: int = LEAST_WORDS, least_line: int = LEAST_LINE) -> Units:
    points = code_points("".join(lowered(t) + "\n" if t else "\n" for t in texts))
    first = np.concatenate([[0], np.cumsum([len(t or "") + 1 for t in texts])]).astype(np.int64)
    low = np.minimum(points, 0xFFFF)
    space = _SPACE[low] & (points < 0x10000)
    core = ~space & ~(_MARK[low] & (points < 0x10000))
    starts, ends = runs(~space)
    within = _total(core)
    real = within[ends] > within[starts]  # a run of marks alone is no word
    at, to = starts[real], ends[real]
    if not len(at):
        none = np.zeros(0, dtype=np.int64)
        return Units(none, none, none, none, none, *[none.astype(bool)] * 5, none, none)
    places = np.flatnonzero(core)
    head, tail = places[np.searchsorted(places, at)], places[np.searchsorted(places, to) - 1] + 1
    h = hashed(points, head, tail)
    # up to the next word: whether a sentence or the line ends there, and where the last run of marks does
    following = np.append(at[1:], len(points))
    sentence, newlines = _total(_END[low]), np.flatnonzero(points == 10)
    next_line = newlines[np.searchsorted(newlines, to)]
    line_end = next_line < following
    stop = ends[np.searchsorted(starts, np.minimum(following, next_line)) - 1]
    # lines too short to count that adjoin are one line, whose inner line ends rank like sentence ends
    line, of = _total(line_end)[:-1], np.searchsorted(first, at, side="right") - 1
    tiny = (np.bincount(line) < least_line)[line]
    inner = np.append(line_end[:-1] & tiny[:-1] & tiny[1:] & (of[1:] == of[:-1]), False)
    line_end = line_end & ~inner
    b = np.flatnonzero(line_end | cuts(h, (sentence[to] > sentence[tail]) | inner, line_end))
    a = np.concatenate([[0], b[:-1] + 1])
    # short ends of a line belong to their neighbour in it
    begins, finishes, short = line_end[a - 1] | (a == 0), line_end[b], b - a + 1 < least_words
    glued = begins & ~finishes & short
    glued[:-1] |= (finishes & ~begins & short)[1:]
    b = b[~glued]
    a = np.concatenate([[0], b[:-1] + 1])
    n = b - a + 1
    begins, finishes = line_end[a - 1] | (a == 0), line_end[b]
    text, tiny = of[a], tiny[a]
    counts = (n >= least_words) | (begins & finishes & ~tiny & (n >= least_line))
    between = np.zeros(len(a), dtype=bool)
    between[1:-1] = ~counts[1:-1] & counts[:-2] & counts[2:] & (text[1:-1] == text[:-2]) & (text[1:-1] == text[2:])

    def digest(values: np.ndarray, base: int) -> np.ndarray:
        up, down = powers(len(values), base)
        total = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * up[: len(values)], out=total[1:])
        return mix64((total[b + 1] - total[a]) * down[a] + n.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)

    def with_neighbours(d: np.ndarray) -> np.ndarray:
        k, x = np.flatnonzero(between), d.view(np.uint64)
        out = x.copy()
        out[k] = mix64(mix64(mix64(x[k - 1]) + x[k] * BASE) + x[k + 1])
        return out.view(np.int64)

    number = np.arange(len(a)) - np.searchsorted(text, text)
    d1, d2 = with_neighbours(digest(h, int(BASE))), with_neighbours(digest(mix64(h ^ BASE), SECOND))
    return Units(text, number, at[a] - first[text], stop[b] - first[text], n, begins, finishes, counts, tiny, between, d1, d2)


def rank(doc_id: str = "doc_id", text: str = "text") -> Column:
    """doc_id; for a null one a number beyond all ids, from the text."""
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64(text), 2))


def occurrences(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """rank and h (of the document and its text), d1, d2 (a digest), unit (the number of the first unit in the text that has it), more
    (the numbers of others, else null), for every digest of a unit that counts: a row for each text and digest."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for lo, hi in by_bytes(f["text"], AT_ONCE):
                u = units(list(f["text"].iloc[lo:hi]), least_words)
                own = np.flatnonzero(u.counts | u.between)
                order = own[np.lexsort((u.number[own], u.d2[own], u.d1[own], u.text[own]))]
                t, d1, d2, number = u.text[order], u.d1[order], u.d2[order], u.number[order].astype(np.int32)
                new = np.ones(len(order), dtype=bool)
                new[1:] = (t[1:] != t[:-1]) | (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])
                starts = np.flatnonzero(new)
                ends = np.append(starts[1:], len(order))
                more = np.full(len(starts), None, dtype=object)
                for k in np.flatnonzero(ends - starts > 1):
                    more[k] = number[starts[k] + 1 : ends[k]]
                at = lo + t[starts]
                yield pd.DataFrame({"rank": f["rank"].to_numpy()[at], "h": f["h"].to_numpy()[at], "unit": number[starts], "d1": d1[starts], "d2": d2[starts], "more": more})

    found_by_workers(docs.sparkSession)
    return docs.select(rank().alias("rank"), F.xxhash64("text").alias("h"), "text").mapInPandas(run, "rank long, h long, unit int, d1 long, d2 long, more array<int>")


def copies(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """rank, h, gone (sorted numbers of the units that are not the earliest of their digest)."""
    every = occurrences(docs, least_words)
    again = F.col("more").isNotNull()
    first = every.groupBy("d1", "d2").agg(F.min("rank").alias("first"), F.count("*").alias("n"), F.max(again).alias("again")).where("n > 1 or again")
    # written, so that the join has an exchange on both sides, which lets Spark split a hot digest's partition
    first = cut(first.select(F.col("d1").alias("f1"), F.col("d2").alias("f2"), "first"))
    met = every.join(first, (F.col("d1") == F.col("f1")) & (F.col("d2") == F.col("f2"))).where((F.col("rank") != F.col("first")) | again)
    more = F.coalesce("more", F.array().cast("array<int>"))
    gone = F.when(F.col("rank") != F.col("first"), F.concat(F.array("unit"), more)).otherwise(more)
    return met.groupBy("rank", "h").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(gone)))).alias("gone"))


def remaining(text: str, u: Units, gone, least_run: int = LEAST_RUN) -> tuple[str, list[tuple[int, int]]]:
    """The text without the units that go, and their spans; units that follow one another are one span. u: the units of this text."""

    def together(numbers: list[int]) -> list[list[int]]:
        out: list[list[int]] = []
        for k in numbers:
            if out and out[-1][-1] == k - 1:
                out[-1].append(k)
            else:
                out.append([k])
        return out

    alone = u.counts & ~u.short

    def goes(g: list[int]) -> bool:
        return int(u.words[g].sum()) >= least_run or bool(u.begins[g[0]] and u.finishes[g[-1]] and alone[g[0]] and alone[g[-1]])

    spans = []
    for g in together(sorted(int(k) for k in gone)):
        # short lines next to it don't keep a line from going
        for part in [g] if goes(g) else together([k for k in g if alone[k]]):
            if goes(part):
                spans.append((int(u.start[part[0]]), int(u.end[part[-1]])))
    out, at = [], 0
    for s, e in spans:
        out.append(text[at:s])
        at = e
        while at < len(text) and text[at].isspace():  # the blanks behind a span go with it
            at += 1
    out.append(text[at:])
    left = "".join(out)
    return (left.rstrip() if spans and at >= len(text) else left), spans


def dedup(docs: DataFrame, least_words: int = LEAST_WORDS, spans: str | None = None, least_run: int = LEAST_RUN) -> DataFrame:
    """docs with repeated units cut from text; with spans, a column of that name has what was cut (start, end in code points).

    With a least_run of 1 every repeated unit goes, however short the run it stands in.
    """
    key_rank, key_h, gone = fresh(docs, "rank", "h", "gone")
    found = copies(docs, least_words).select(F.col("rank").alias(key_rank), F.col("h").alias(key_h), F.col("gone").alias(gone))
    met = docs.join(found, (rank() == F.col(key_rank)) & (F.xxhash64("text") == F.col(key_h)), "left").select(*[quoted(c) for c in docs.columns], gone)
    at = [c.lower() for c in docs.columns].index("text")
    text_name = docs.columns[at]
    schema = docs.select(*[quoted(c) for c in docs.columns], *([F.lit(None).cast("array<struct<start:int,end:int>>").alias(spans)] if spans else [])).schema

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for b in (part for whole in batches for part in slices(whole, text_name)):
            texts, lists = b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist()
            cuts: list[list[tuple[int, int]]] = [[] for _ in texts]
            some = [k for k, g in enumerate(lists) if g]
            for lo, hi in by_bytes(pd.Series([texts[k] for k in some], dtype=object), AT_ONCE):
                u = units([texts[k] for k in some[lo:hi]], least_words)
                edges = np.searchsorted(u.text, np.arange(hi - lo + 1))
                for j, k in enumerate(some[lo:hi]):
                    own = slice(edges[j], edges[j + 1])
                    texts[k], cuts[k] = remaining(texts[k], Units(*[getattr(u, n)[own] for n in u.__dataclass_fields__]), lists[k], least_run)
            columns, names = list(b.columns[:-1]), b.schema.names[:-1]
            columns[at] = pa.array(texts, type=pa.string())
            if spans:
                columns.append(pa.array([[{"start": s, "end": e} for s, e in x] for x in cuts], type=kind))
                names = [*names, spans]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return met.mapInArrow(run, schema)
