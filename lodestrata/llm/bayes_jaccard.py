"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of five-word shingles (words: runs of letters and digits, lower case; 64-bit hashes of them). Pairs of Jaccard
similarity of at least 0.8 are links. MinHash signatures of candidates are compared a few values at a time; a pair is dropped once
the posterior probability (uniform prior) that its similarity reaches the threshold is under a tolerance; every other pair is
verified exactly on the shingle sets.

At scale: documents with equal sets are one class from the start, with its number of copies. Candidates are pairs of classes that
share one of 32 bands of 4 MinHash values (a linked pair shares none with probability 5e-8 at most, at the threshold), and no
others are compared. A pair is judged once, in the first band it shares. Pairs are never written: a bucket goes to one task or, if
large (in members or in bytes of shingles), is dealt into chunks, and each pair of chunks goes to one task. A first pass carries
signatures alone and prunes; only members with a pair that is left meet their shingle sets in the second, which verifies and sends
on a count and a root for each member. So a hot bucket costs many small tasks; all links between different texts count, and
nothing is capped. What is broadcast (bucket sizes, the members left) is measured first and shuffled where it is too large.

Cases: null and empty texts, and texts without letters and digits, have no shingles: no links, a class each. Texts of one to four
words are one shingle. Repeated rows are copies of each other; rows that share an id but not their text are told apart by the
text's hash. A null doc_id gets a stand-in below zero from its text's hash, which shows as its class id. Ties: the least doc_id
names a class. Very long texts are worked whole. An empty table gives no rows; columns other than doc_id and text are passed on by
keep_one(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.common import bounded, cut, fresh, mix64, quoted, with_results
from lodestrata.llm.components import components
from lodestrata.llm.hashing import BASE, word_hashes
from lodestrata.session import found_by_workers

WORDS = 5
THRESHOLD = 0.8
BANDS, BAND_ROWS = 32, 4
#: MinHash values compared at a time, and the posterior probability under which a pair is dropped.
STEP = 16
TOLERANCE = 1e-7
#: Members of a chunk of a bucket (a sixteenth of it, within these bounds), and bytes of their shingles, at most.
CHUNK = (256, 2048)
CHUNK_BYTES = 1 << 25
#: Pairs that a task compares at once.
PAIRS = 1 << 19


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    word, at = word_hashes(texts)
    out = []
    odd = [np.uint64(((2 * k + 3) * int(BASE)) & 0xFFFFFFFFFFFFFFFF | 1) for k in range(words)]
    n = len(word) - words + 1
    every = np.zeros(max(n, 0), dtype=np.uint64)
    for k in range(words):
        if n > 0:
            every += word[k : k + n] * odd[k]
    every = mix64(every)
    for lo, hi in zip(at[:-1], at[1:], strict=True):
        if hi - lo >= words:
            out.append(np.unique(every[lo : hi - words + 1]))
        elif hi > lo:
            few = (word[lo:hi] * np.asarray(odd[: hi - lo], dtype=np.uint64)).sum(dtype=np.uint64, keepdims=True)
            out.append(mix64(few + np.asarray([hi - lo], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


@lru_cache(maxsize=1)
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    seed = mix64(np.arange(1, 2 * BANDS * BAND_ROWS + 1, dtype=np.uint64) * BASE)
    return seed[: BANDS * BAND_ROWS] | np.uint64(1), seed[BANDS * BAND_ROWS :]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values (a row for each set, which must not be empty)."""
    a, b = _permutations()
    out = np.full((len(sets), len(a)), 0xFFFFFFFF, dtype=np.uint32)
    if not sets:
        return out
    every = np.concatenate(sets)
    first = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    slice_ = 2048
    for lo in range(0, len(every), slice_):
        x = every[lo : lo + slice_]
        h = ((x[None, :] * a[:, None] + b[:, None]) >> np.uint64(32)).astype(np.uint32)
        f, t = np.searchsorted(first, lo, side="right") - 1, np.searchsorted(first, lo + len(x) - 1, side="right")
        edges = np.maximum(first[f:t] - lo, 0)
        out[f:t] = np.minimum(out[f:t], np.minimum.reduceat(h, edges, axis=1).T)
    # 16 bits of each are kept: chance makes a few more values equal, which never drops a pair, and a band is one 64-bit number
    return ((out * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(values compared, matches under which a pair is dropped): the posterior of the similarity is Beta(matches + 1, others + 1)."""
    out = []
    for n in range(STEP, BANDS * BAND_ROWS + 1, STEP):
        for m in range(n + 1):
            # P(J >= t) for Beta(m + 1, n - m + 1) is a binomial sum
            if sum(comb(n + 1, j) * threshold**j * (1 - threshold) ** (n + 1 - j) for j in range(m + 1)) >= tolerance:
                out.append((n, m))
                break
    return out


def node_id(doc_id: str = "doc_id", text: str = "text") -> Column:
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(-1).cast("long") - F.shiftrightunsigned(F.xxhash64(text), 1))


def sketched(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """id, h (of the text), n (shingles), s1, s2 (a 128-bit hash of the set), signature (null without shingles), for each row."""

    def run(texts: list[str | None]) -> dict[str, pa.Array]:
        sets = shingle_sets(texts, words)
        full = [k for k, s in enumerate(sets) if len(s)]
        made: list[bytes | None] = [None] * len(sets)
        for k, row in zip(full, signatures([sets[k] for k in full]), strict=True):
            made[k] = row.tobytes()
        total = lambda s: int(s.sum(dtype=np.uint64).view(np.int64))
        return {
            "n": pa.array([len(s) for s in sets], pa.int64()), "s1": pa.array([total(s) for s in sets], pa.int64()),
            "s2": pa.array([total(mix64(s ^ BASE)) for s in sets], pa.int64()), "signature": pa.array(made, pa.binary()),
        }

    rows = docs.select(node_id().alias("id"), F.xxhash64("text").alias("h"), F.col("text").alias("text"))
    return with_results(rows, "text", "n long, s1 long, s2 long, signature binary", lambda: run)


class Cells:
    """Rows of whole cells, sorted by cell and side. A cell is a chunk of a bucket with itself (i = j), or two chunks across."""

    def __init__(self, rows: pa.Table):
        column = lambda c: rows.column(c).to_numpy()
        key, i, j, side = (column(c) for c in ("key", "i", "j", "side"))
        self.node, self.size, self.band = column("node"), column("n"), column("band").astype(np.int64)
        self.signature = np.frombuffer(b"".join(rows.column("signature").to_pylist()), dtype=np.uint16).reshape(len(key), -1)
        self.bands = self.signature.view(np.uint64)
        first = np.ones(len(key), dtype=bool)
        first[1:] = (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        starts = np.flatnonzero(first)
        self.cell = np.cumsum(first) - 1
        ends = np.append(starts[1:], len(key))[self.cell]
        # the partners of a row: all behind it in a chunk with itself, the other side's rows for a row of the first side
        within, left = i == j, side == i
        other = (starts + np.add.reduceat(left.astype(np.int64), starts))[self.cell] if len(starts) else starts
        self.low = np.where(within, np.arange(len(key)) + 1, np.where(left, other, ends))
        self.high = ends

    def pairs(self, threshold: float, drop: list[tuple[int, int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows whose first shared band is their bucket's and that no comparison drops, some at a time."""
        total = np.cumsum(self.high - self.low)
        at = 0
        while at < len(total):
            end = min(len(total), int(np.searchsorted(total, PAIRS + (total[at - 1] if at else 0))) + 1)
            n = (self.high - self.low)[at:end]
            a = np.repeat(np.arange(at, end), n)
            b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n - self.low[at:end], n)
            at = end
            small, large = np.minimum(self.size[a], self.size[b]), np.maximum(self.size[a], self.size[b])
            go = (small >= threshold * large - 1e-9) & (self.band[a] == self.band[b]) & (self.node[a] != self.node[b])
            a, b = a[go], b[go]
            go = self.bands[a, self.band[a]] == self.bands[b, self.band[b]]
            a, b = a[go], b[go]
            for k in range(BANDS):  # judged where an earlier band is shared
                earlier = self.band[a] > k
                if not earlier.any():
                    break
                go = ~(earlier & (self.bands[a, k] == self.bands[b, k]))
                a, b = a[go], b[go]
            matches = np.zeros(len(a), dtype=np.int32)
            for n, least in drop:
                if not len(a):
                    break
                matches += (self.signature[a, n - STEP : n] == self.signature[b, n - STEP : n]).sum(axis=1, dtype=np.int32)
                go = matches >= least
                a, b, matches = a[go], b[go], matches[go]
            if len(a):
                yield a, b


def common(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the pairs' intersections, exactly."""
    if len(i) < 200:
        return np.fromiter((len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j, strict=True)), dtype=np.int64, count=len(i))
    some, place = np.unique(np.concatenate([i, j]), return_inverse=True)
    sets, i, j = [sets[k] for k in some], place[: len(i)], place[len(i) :]
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    often = np.bincount(place, minlength=len(values)) > 1  # others are in no intersection
    number = np.cumsum(often) - 1
    owner, place = owner[often[place]], number[place[often[place]]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    out, width = np.zeros((len(sets), len(sets)), dtype=np.float32), 4096
    for lo in range(0, int(often.sum()), width):
        s, e = np.searchsorted(place, [lo, lo + width])
        has = np.zeros((len(sets), width), dtype=np.float32)
        has[owner[s:e], place[s:e] - lo] = 1
        out += has @ has.T
    return out[i, j].astype(np.int64)  # counts under 2**24 are exact in 32-bit floats


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n places the least place that links lead to."""
    up = np.arange(n)
    while True:
        low = up.copy()
        np.minimum.at(low, i, up[j])
        np.minimum.at(low, j, up[i])
        low = low[low]
        if (low == up).all():
            return up
        up = low


def whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted batches as tables that end with a cell; what is held back is part of one cell, whose size is bounded."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([held, t]) if held is not None else t
        key, i, j = (t.column(c).to_numpy() for c in ("key", "i", "j"))
        at = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))
        end = int(at[-1]) + 1 if len(at) else 0
        held = t.slice(end).combine_chunks()
        if end:
            yield t.slice(0, end)
    if held is not None:
        yield held


CELL = "key long, i int, j int, side int, band int, node long, n long, signature binary"


def pruned(dealt: DataFrame, threshold: float) -> DataFrame:
    """The rows of CELL with at least one pair that the comparison of signatures leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop = least_matches(threshold)
        for t in whole_cells(batches):
            cells = Cells(t)
            left = np.zeros(t.num_rows, dtype=bool)
            for a, b in cells.pairs(threshold, drop):
                left[a] = left[b] = True
            yield from t.filter(pa.array(left)).to_batches()

    found_by_workers(dealt.sparkSession)
    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side").mapInArrow(run, CELL)


FOUND = "node long, n_class_links long, n_doc_links long, low long"


def verified(dealt: DataFrame, threshold: float) -> DataFrame:
    """dealt: CELL with copies and shingles; a row of FOUND for each row with links, in which low is one node of its component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop = least_matches(threshold)
        for t in whole_cells(batches):
            cells = Cells(t)
            n, copies = t.num_rows, t.column("copies").to_numpy()
            sets = [np.frombuffer(s, dtype=np.uint64) for s in t.column("shingles").to_pylist()]
            links = np.zeros(n, dtype=np.int64)
            weight, up = np.zeros(n), np.arange(n)
            for a, b in cells.pairs(threshold, drop):
                shared = np.zeros(len(a), dtype=np.int64)
                edges = np.flatnonzero(np.diff(cells.cell[a], prepend=-1, append=-1))
                for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                    shared[lo:hi] = common(sets, a[lo:hi], b[lo:hi])
                good = shared >= threshold * (cells.size[a] + cells.size[b] - shared) - 1e-9
                a, b = a[good], b[good]
                links += np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
                weight += np.bincount(a, weights=copies[b], minlength=n) + np.bincount(b, weights=copies[a], minlength=n)
                up = up[roots(n, up[a], up[b])]
            some = np.flatnonzero(links)
            made = (cells.node[some], links[some], weight[some].astype(np.int64), cells.node[up[some]])
            yield pa.RecordBatch.from_arrays([pa.array(m, pa.int64()) for m in made], names=["node", "n_class_links", "n_doc_links", "low"])

    found_by_workers(dealt.sparkSession)
    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side").mapInArrow(run, FOUND)


def join(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, chunk: tuple[int, int] = CHUNK) -> DataFrame:
    """id, h, s1, s2, class_id, class_h, n_links (documents linked to it, copies included), n_copies, for each row of docs."""
    base = cut(sketched(docs, words))
    some = base.where("n > 0").groupBy("s1", "s2").agg(F.min(F.struct("id", "h", "n", "signature")).alias("m"), F.count("*").alias("copies"))
    # numbered inside the checkpoint, so that a class keeps its number
    classes = cut(some.select(F.monotonically_increasing_id().alias("node"), "s1", "s2", F.col("m.id").alias("rep"), F.col("m.h").alias("rep_h"), "copies", F.col("m.n").alias("n"), F.col("m.signature").alias("signature")))
    band_keys = F.expr(f"transform(sequence(0, {BANDS - 1}), k -> xxhash64(k, substring(signature, {2 * BAND_ROWS} * k + 1, {2 * BAND_ROWS})))")
    keys = classes.select("node", "n", F.posexplode(band_keys).alias("band", "key"))
    size = F.count("*")
    member_chunks = F.ceil(size / F.greatest(F.lit(chunk[0]), F.least(F.lit(chunk[1]), F.ceil(size / 16))))
    chunks = F.greatest(member_chunks, F.ceil(F.sum("n") * 8 / CHUNK_BYTES)).cast("int")
    # written, so that the join has an exchange on both sides, which lets Spark split a hot bucket
    shared = cut(keys.groupBy("key").agg(size.alias("size"), chunks.alias("chunks")).where("size > 1").select(F.col("key").alias("shared"), "chunks"))
    if bounded(shared):
        met = classes.select("node", "n", "signature", F.posexplode(band_keys).alias("band", "key")).join(F.broadcast(shared), F.col("key") == F.col("shared"))
    else:
        met = keys.select("node", "band", "key").join(shared.hint("merge"), F.col("key") == F.col("shared"))
        met = met.join(classes.select(F.col("node").alias("of"), "n", "signature"), F.col("node") == F.col("of"))
    met = met.withColumn("side", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    left = cut(pruned(met.select("key", F.least("side", "with").alias("i"), F.greatest("side", "with").alias("j"), "side", "band", "node", "n", "signature"), threshold))

    # a member's cells are as many as its bands and chunks; its set is made once and dealt to them
    wanted = left.groupBy("node").agg(F.collect_list(F.struct("key", "i", "j", "side", "band")).alias("cells"))
    wanted = wanted.join(classes.select(F.col("node").alias("of"), "rep", "rep_h", "copies", F.col("n").alias("size"), "signature"), F.col("node") == F.col("of")).drop("of")
    wanted = cut(wanted)
    texts = docs.select(node_id().alias("id"), F.xxhash64("text").alias("h"), F.col("text").alias("text"))
    near = texts.join(F.broadcast(wanted) if bounded(wanted) else wanted, (F.col("id") == F.col("rep")) & (F.col("h") == F.col("rep_h")))
    to_sets = lambda: lambda ts: {"shingles": pa.array([s.tobytes() for s in shingle_sets(ts, words)], pa.binary())}
    sets = with_results(near.select("node", "copies", F.col("size").alias("n"), "signature", "cells", "text"), "text", "shingles binary", to_sets)
    if base.groupBy("id", "h").agg(F.count("*").alias("times")).where("times > 1").limit(1).count():
        sets = sets.dropDuplicates(["node"])  # rows that repeat bring their set more than once
    dealt = sets.select("node", "copies", "n", "signature", "shingles", F.explode("cells").alias("c")).select("c.key", "c.i", "c.j", "c.side", "c.band", "node", "n", "signature", "copies", "shingles")
    links = cut(verified(dealt, threshold))

    joined = components(links.select(F.col("node").alias("u"), F.col("low").alias("v")))
    total = links.groupBy(F.col("node").alias("linked")).agg(F.sum("n_doc_links").alias("n_doc_links"))
    total = total.join(joined, F.col("linked") == F.col("node"), "left").select("linked", "n_doc_links", F.coalesce("root", "linked").alias("root"))
    found = cut(classes.select("node", "s1", "s2", "rep", "rep_h", "copies").join(total, F.col("node") == F.col("linked"), "left"))
    names = found.where("root is not null").groupBy(F.col("root").alias("of_root")).agg(F.min(F.struct("rep", "rep_h")).alias("name"))
    named = found.join(names, F.col("root") == F.col("of_root"), "left")
    named = named.select(F.col("s1").alias("c1"), F.col("s2").alias("c2"), F.coalesce("name.rep", "rep").alias("class_id"), F.coalesce("name.rep_h", "rep_h").alias("class_h"), (F.coalesce("n_doc_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "copies")
    out = base.join(named, (F.col("n") > 0) & (F.col("s1") == F.col("c1")) & (F.col("s2") == F.col("c2")), "left")
    return out.select(
        "id", "h", "s1", "s2", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("class_h", "h").alias("class_h"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"),
    )


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS) -> DataFrame:
    """The rows of docs, with all their columns, that name their class: one document of each group stays."""
    found = cut(join(docs, threshold, words))
    gone_id, gone_h, own = fresh(docs, "gone", "hash", "own")
    gone = found.where("id <> class_id or h <> class_h").select(F.col("id").alias(gone_id), F.col("h").alias(gone_h)).distinct()
    rows = docs.withColumn(own, node_id())
    kept = rows.join(F.broadcast(gone) if bounded(gone) else gone, (F.col(own) == F.col(gone_id)) & (F.xxhash64("text") == F.col(gone_h)), "left_anti")
    if found.groupBy("id", "h").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        (nth,) = fresh(kept, "nth")
        same = Window.partitionBy(own, F.xxhash64("text")).orderBy(own)
        kept = kept.withColumn(nth, F.row_number().over(same)).where(F.col(nth) == 1)
    return kept.select(*[quoted(c) for c in docs.columns])
