"""Exact top-k search over binary codes by incremental multi-index hashing.

Codes are cut into segments, each with a table from segment value to rows. For a query the segments' search radii grow one
segment at a time; once the first a+1 segments have been searched to radius r and the others to r-1, every row within distance
m*r+a has been seen (pigeonhole), so the search ends when the k-th verified distance is within what is covered: the result is
exact, ties broken by id.

At scale: of rows with equal codes only the k+1 smallest ids can appear in any result, so others leave before anything else (a
window whose group limit works before the shuffle). Rows are dealt once into blocks by code; queries travel to the blocks, each of
which builds one index and searches the queries that stream past it, some at a time. A first pass searches each query in one block,
which bounds its k-th distance; the second pass searches all blocks only up to that bound, so what a block sends on is near k rows
a query in all. Within a block a row is verified once a query, however many segments find it; once a query has taken more look-ups
than the block has rows, the rows it has not seen are verified all at once, which is cheaper and covers every distance.

Cases: a null vector or id is neither indexed nor a query; NaN and zero components give bit 0; vectors of different lengths are
filled with bit 0 to the longest; a query does not find its own row (id), but finds other rows with the same vector; rows that
repeat an id count once; fewer than k rows give fewer results; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.common import cut
from lodestrata.session import found_by_workers

K = 10
ROWS_A_BLOCK = 1 << 16
#: Candidates that are verified at once, and (query, row) pairs of a block that are marked as seen at once.
AT_ONCE = 1 << 20
SEEN = 1 << 25


def width(rows: DataFrame, vector: str) -> int:
    """Bits of the codes: the longest vector's length, up to whole bytes."""
    longest = rows.agg(F.max(F.size(vector))).first()[0] or 1
    return max(8, -(-longest // 8) * 8)


def codes(rows: DataFrame, id_col: str, vector: str, bits: int) -> DataFrame:
    """id, code (binary): a bit for each component, 1 if it is over 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            lengths = b["v"].map(len).to_numpy()
            bit = np.zeros((len(b), bits), dtype=np.uint8)
            for n in np.unique(lengths[lengths > 0]):
                own = np.flatnonzero(lengths == n)
                bit[own, :n] = np.stack(b["v"].iloc[own].to_numpy()).astype(float) > 0
            made = [row.tobytes() for row in np.packbits(bit, axis=1)]
            yield pd.DataFrame({"id": b["id"], "code": made})

    found_by_workers(rows.sparkSession)
    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v")).where("id is not null and v is not null").mapInPandas(run, "id long, code binary")


class Index:
    """The segment tables of one block of rows."""

    def __init__(self, code: np.ndarray, ids: np.ndarray):
        self.code, self.ids, self.verified = code, ids, 0
        bits = code.shape[1] * 8
        size = int(np.clip(np.ceil(np.log2(max(2, len(ids)))), 4, 16))  # a row in each bucket or so
        self.bounds = [(s, min(s + size, bits)) for s in range(0, bits, size)]
        self.tables = []
        for values in self.segments(code):
            order = np.argsort(values, kind="stable")
            n = int(values.max()) + 1 if len(values) else 1
            self.tables.append((order, np.concatenate([[0], np.cumsum(np.bincount(values, minlength=n))])))

    def segments(self, code: np.ndarray) -> list[np.ndarray]:
        bit = np.unpackbits(code, axis=1).astype(np.int64)
        return [bit[:, lo:hi] @ (1 << np.arange(hi - lo)) for lo, hi in self.bounds]

    def search(self, code: np.ndarray, own: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """query (row of code), id, distance of the k nearest within bound of every query."""
        nq, m = len(code), len(self.bounds)
        step = max(1, SEEN // max(1, len(self.ids)))
        if nq > step:
            parts = [self.search(code[lo : lo + step], own[lo : lo + step], bound[lo : lo + step], k) for lo in range(0, nq, step)]
            return tuple(np.concatenate(x) for x in zip(*((q + n * step, i, d) for n, (q, i, d) in enumerate(parts)), strict=True))
        at = self.segments(code)
        seen = np.zeros((nq, len(self.ids)), dtype=bool)
        found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        kth = bound.astype(np.int64).copy()  # what a new row must not exceed
        active = np.arange(nq)
        looked_up = 0
        for radius in range(max(hi - lo for lo, hi in self.bounds) + 1):
            for a, (lo, hi) in enumerate(self.bounds):
                if not len(active):
                    return found
                flips = np.array([sum(1 << i for i in c) for c in combinations(range(hi - lo), radius)], dtype=np.int64)
                looked_up += len(flips)
                if looked_up > max(64, len(self.ids)):  # more look-ups than rows: seeing all rows is cheaper, and covers every distance
                    for q in np.array_split(active, max(1, len(active) * len(self.ids) // AT_ONCE)):
                        found, kth = self.take(found, kth, np.repeat(q, len(self.ids)), np.tile(np.arange(len(self.ids)), len(q)), code, own, k, seen)
                    return found
                order, starts = self.tables[a]
                for q in np.array_split(active, max(1, len(active) * len(flips) // AT_ONCE)):
                    value = at[a][q][:, None] ^ flips[None, :]
                    inside = value < len(starts) - 1
                    value = np.where(inside, value, 0)
                    first, count = starts[value], np.where(inside, starts[value + 1] - starts[value], 0)
                    who, first, count = np.repeat(q, len(flips)), first.ravel(), count.ravel()
                    has = count > 0
                    who, first, count = who[has], first[has], count[has]
                    ends = np.cumsum(count)
                    cutoffs = np.searchsorted(ends, np.arange(AT_ONCE, (ends[-1] if len(ends) else 0) + AT_ONCE, AT_ONCE))
                    for s, e in zip(np.concatenate([[0], cutoffs + 1]), np.concatenate([cutoffs + 1, [len(count)]]), strict=True):
                        c = count[s:e]
                        if len(c):
                            rows = np.repeat(first[s:e] - np.cumsum(c) + c, c) + np.arange(c.sum())
                            found, kth = self.take(found, kth, np.repeat(who[s:e], c), order[rows], code, own, k, seen)
                active = active[kth[active] > m * radius + a]
        return found

    def take(self, found, kth, who, rows, code, own, k, seen):
        """found with those of the given pairs, not seen before, that are near enough, cut to k a query."""
        new = ~seen[who, rows]
        who, rows = who[new], rows[new]
        seen[who, rows] = True
        self.verified += len(who)
        distance = np.bitwise_count(code[who] ^ self.code[rows]).sum(axis=1, dtype=np.int64)
        good = (distance <= kth[who]) & (self.ids[rows] != own[who])
        if not good.any():
            return found, kth
        q, i, d = (np.concatenate(x) for x in zip(found, (who[good], self.ids[rows[good]], distance[good]), strict=True))
        order = np.lexsort((i, d, q))
        q, i, d = q[order], i[order], d[order]
        new = np.ones(len(q), bool)
        new[1:] = (q[1:] != q[:-1]) | (i[1:] != i[:-1]) | (d[1:] != d[:-1])
        q, i, d = q[new], i[new], d[new]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        full = place == k - 1
        kth = kth.copy()
        kth[q[full]] = d[full]
        keep = place < k
        return (q[keep], i[keep], d[keep]), kth


FOUND = "query_id long, neighbor_id long, distance long"


def dealt(rows: DataFrame, asked: DataFrame, blocks: int) -> DataFrame:
    """block, asked (0: a row, once; 1: a query, for each block it is sent to), id, code, bound: a block's rows come before its queries."""
    one = rows.select("block", F.lit(0).alias("asked"), "id", "code", F.lit(0).cast("long").alias("bound"))
    both = one.unionByName(asked.select("block", F.lit(1).alias("asked"), "id", "code", F.col("bound").cast("long").alias("bound")))
    return both.repartition(blocks, "block").sortWithinPartitions("block", "asked")


def searched(both: DataFrame, k: int) -> DataFrame:
    """FOUND: for each block's queries the k nearest of its rows within their bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        as_bytes = lambda c: np.frombuffer(b"".join(c.to_pylist()), dtype=np.uint8).reshape(len(c), -1)
        block, held, index = None, [], None
        for b in batches:
            of, asked = b.column(0).to_numpy(), b.column(1).to_numpy()
            edges = np.flatnonzero(np.diff(of, prepend=of[:1]) | np.diff(asked, prepend=asked[:1])) if len(of) else []
            for lo, hi in zip([0, *edges], [*edges, len(of)], strict=True):
                if lo == hi:
                    continue
                part = b.slice(lo, hi - lo)
                if of[lo] != block:
                    block, held, index = of[lo], [], None
                if not asked[lo]:
                    held.append((as_bytes(part.column(3)), part.column(2).to_numpy()))
                elif held or index is not None:
                    if index is None:
                        index = Index(*(np.concatenate(x) for x in zip(*held, strict=True)))
                        held = []
                    own = part.column(2).to_numpy()
                    q, i, d = index.search(as_bytes(part.column(3)), own, part.column(4).to_numpy(), k)
                    yield pa.RecordBatch.from_arrays([pa.array(own[q]), pa.array(i), pa.array(d)], names=["query_id", "neighbor_id", "distance"])

    found_by_workers(both.sparkSession)
    return both.mapInArrow(run, FOUND)


def search(rows: DataFrame, queries: DataFrame, bits: int, k: int = K) -> DataFrame:
    """query_id, rank (from 1), neighbor_id, distance: the k rows nearest to each query by (Hamming distance, id).

    rows and queries have id and code; equal ids are one row.
    """
    spark = rows.sparkSession
    first = Window.partitionBy("code").orderBy("id")
    rows = rows.dropDuplicates(["id", "code"]).withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k + 1).drop("nth")
    rows = cut(rows)
    n = rows.count()
    blocks = max(1, -(-n // ROWS_A_BLOCK), min(spark.sparkContext.defaultParallelism, n // 4096))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("code"), F.lit(blocks)))
    queries = queries.dropDuplicates(["id"]).select("id", "code")
    whole = F.lit(bits)
    if blocks > 1:
        home = queries.withColumn("bound", whole).withColumn("block", F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(blocks)))
        bound = searched(dealt(rows, home, blocks), k).groupBy("query_id").agg(F.when(F.count("*") >= k, F.max("distance")).otherwise(whole).alias("bound"))
        asked = queries.join(bound, queries.id == bound.query_id, "left").select("id", "code", F.coalesce("bound", whole).alias("bound"))
    else:
        asked = queries.withColumn("bound", whole)
    everywhere = asked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    found = searched(dealt(rows, everywhere, blocks), k)
    best = Window.partitionBy("query_id").orderBy("distance", "neighbor_id")
    return found.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= k).select("query_id", "rank", "neighbor_id", "distance")


def nearest(rows: DataFrame, id_col: str, vector: str, every: int = 50, k: int = K) -> DataFrame:
    """search() with every row whose id is divisible by ``every`` as a query, against all rows."""
    bits = width(rows, vector)
    coded = cut(codes(rows, id_col, vector, bits))  # narrow, and read several times
    return search(coded, coded.where(F.col("id") % every == 0), bits, k)


ORACLE_SQL = f"""
WITH c AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x > 0) AS b FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
p AS (
  SELECT q.id AS query_id, r.id AS neighbor_id, list_sum(list_transform(list_zip(q.b, r.b), lambda z: (z[1] <> z[2])::INT))::BIGINT AS distance
  FROM c q JOIN c r ON q.id % 50 = 0 AND q.id <> r.id
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank, neighbor_id, distance FROM p
QUALIFY rank <= {K}
"""
