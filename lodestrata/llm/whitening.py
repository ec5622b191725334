"""Embedding whitening by hierarchical merging of singular value decompositions.

The fit list is all vectors, as integers x = floor(64 * c) + 1000000. Every task folds its vectors, a block at a time, into one state: how
many there are, their exact sums by dimension, and the singular values and right vectors of the centred ones, at full rank. Two states
merge by stacking both scaled bases and one more row, the difference of their means times sqrt(n1 * n2 / (n1 + n2)), and taking the
decomposition of the stack: its Gram matrix is exactly that of all their vectors about the common mean, so no dimension is lost. States
merge in a tree, MERGED at a time, so no task gets more than MERGED states of at most dims * (dims + 2) numbers, and what reaches the
driver is the last one. V = vectors * values^2 / n is never formed, which keeps small eigenvalues to double precision.

Cases: rows whose vector is null, empty, holds null or non-finite entries, or an entry beyond 2^40, are dropped; if lengths differ, the most
frequent one counts (of equally frequent ones the longer) and rows of other lengths are dropped as well; rows that repeat count each time;
a null vec_id stays null; components without variance (at most RANK of the largest value) can't be scaled and give no row, so one vector
alone gives none; a table without vectors gives no rows; other columns are not read, whatever their names. A deviation that a long can't
hold is null. Equal eigenvalues leave their components free to turn into each other: any basis of them is right.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import cut, fresh
from lodestrata.session import found_by_workers

COMPONENTS = 32
#: The scale and shift under which entries are integers.
SCALE, SHIFT = 64, 1_000_000
#: Vectors that a task decomposes at once, and states that one task merges.
BLOCK, MERGED = 4096, 16
#: Singular values up to this share of the largest one are rounding.
RANK = 1e-12
LARGEST = 2.0**40


class State(NamedTuple):
    """n vectors, their sums by dimension (exact for integers), and the centred vectors' singular values and right vectors."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    def packed(self) -> bytes:
        return np.array([self.n, len(self.values)], dtype="<i8").tobytes() + self.sums.tobytes() + self.values.tobytes() + self.vectors.tobytes()

    @staticmethod
    def unpacked(data: bytes, dims: int, kind: str = "<i8") -> State:
        flat = np.frombuffer(data, dtype="<f8")
        n, rank = (int(v) for v in flat[:2].view("<i8"))
        return State(n, flat[2 : 2 + dims].view(kind), flat[2 + dims : 2 + dims + rank], flat[2 + dims + rank :].reshape(rank, dims))


def decomposed(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Singular values and right vectors, as many as there are rows or dimensions."""
    _, values, vectors = np.linalg.svd(rows, full_matrices=False)
    return values, vectors


def state_of(block: np.ndarray) -> State:
    """The state of some vectors, given as integers x - SHIFT."""
    sums = block.sum(axis=0)
    return State(len(block), sums, *decomposed(block - sums / len(block)))


def merged(states: list[State]) -> State:
    """One state of all vectors of some states."""
    total = states[0]
    for s in states[1:]:
        n = total.n + s.n
        step = np.sqrt(total.n / n * s.n) * (total.sums / total.n - s.sums / s.n)  # the mean-correction row
        total = State(n, total.sums + s.sums, *decomposed(np.vstack([total.values[:, None] * total.vectors, s.values[:, None] * s.vectors, step])))
    return total


def folded(blocks: Iterator[np.ndarray]) -> State | None:
    """One state of all blocks of a task."""
    total = None
    for block in blocks:
        own = state_of(block)
        total = merged([total, own]) if total else own
    return total


def usable(rows: DataFrame, vector: str = "embedding") -> tuple[DataFrame, int]:
    """vec_id and x - SHIFT as array<long> of the rows that count, and their number of dimensions (0 if there are none)."""
    whole = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where("size(v) > 0")
    whole = whole.where(F.forall("v", lambda c: F.coalesce(F.abs(c) < F.lit(LARGEST), F.lit(False))))
    sizes = whole.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    dims = sizes["dims"] if sizes else 0
    return whole.where(F.size("v") == dims).select("vec_id", F.transform("v", lambda c: F.floor(c * F.lit(float(SCALE)))).alias("x")), dims


def _matrix(batch: pa.RecordBatch, column: str, dims: int, kind: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(column)).flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, dims)


def fit(rows: DataFrame, column: str, dims: int, kind: str = "<i8") -> State | None:
    """The state of all vectors of a column of longs or doubles (kind), through a tree of merges; one state of bounded size reaches the driver."""
    spark = rows.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = folded(m[k : k + BLOCK] for b in batches for m in [_matrix(b, column, dims, kind)] for k in range(0, len(m), BLOCK))
        if own:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([own.packed()], pa.binary())], names=["place", "state"])

    def join(group: pd.DataFrame) -> pd.DataFrame:
        own = [State.unpacked(s, dims, kind) for s in group.sort_values("before")["state"]]
        return pd.DataFrame({"place": group["place"].iloc[:1], "state": [merged(own).packed()]})

    found_by_workers(spark)
    states = cut(rows.select(column).mapInArrow(run, "place long, state binary"))
    last = states.agg(F.max("place")).first()[0]
    if last is None:
        return None
    while last > 0:  # one level of the tree; the plan holds them all, and only the last one is collected
        last //= MERGED
        states = states.withColumn("before", F.col("place")).withColumn("place", F.floor(F.col("place") / MERGED)).groupBy("place").applyInPandas(join, "place long, state binary")
    return State.unpacked(states.first()["state"], dims, kind)


class Whitener(NamedTuple):
    """n, sums of x - SHIFT, unit eigenvectors by falling eigenvalue, the eigenvalues, and each one's share of the trace."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray


def whitener(state: State, components: int = COMPONENTS) -> Whitener:
    """The first components of a state; the sign is such that a component's largest entry is positive."""
    eigenvalues = state.values**2 / state.n
    rank = int((state.values > RANK * state.values.max()).sum()) if state.values.max() > 0 else 0
    k = min(components, rank)
    vectors = state.vectors[:k]
    vectors = vectors * np.where(np.take_along_axis(vectors, np.abs(vectors).argmax(axis=1)[:, None], axis=1) < 0, -1.0, 1.0) if k else vectors
    return Whitener(state.n, state.sums, vectors, eigenvalues[:k], eigenvalues[:k] / eigenvalues.sum() if k else eigenvalues[:0])


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sum over dimensions of (n * x - sums)^2 for each row, exact; None past a long."""
    largest = n * max(int(np.abs(x).max(initial=0)), 1) + int(np.abs(sums).max(initial=0))
    if largest * largest * max(x.shape[1], 1) < 1 << 63:
        d = x * n - sums
        return (d * d).sum(axis=1).tolist()
    wide = x.astype(object) * n - sums.astype(object)
    return [v if v < 1 << 63 else None for v in (wide * wide).sum(axis=1).tolist()] if len(x) else []


def whitened(x: DataFrame, w: Whitener, dims: int) -> DataFrame:
    """vec_id, deviation and whitened (array<double>, one for each component) of rows that usable() gives."""
    k, mean, scaled = len(w.components), w.sums / w.n, (w.components / np.sqrt(w.eigenvalues)[:, None]).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _matrix(b, "x", dims, "<i8")
            made = ((m - mean) @ scaled).ravel()
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * k, pa.int32()), pa.array(made))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(deviations(m, w.n, w.sums), pa.int64()), values], names=["vec_id", "deviation", "whitened"])

    found_by_workers(x.sparkSession)
    return x.select("vec_id", "x").mapInArrow(run, "vec_id long, deviation long, whitened array<double>")


def identity_error(rows: DataFrame, k: int) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, from their own tree of states."""
    state = fit(rows, "whitened", k, "<f8")
    return 0.0 if state is None else float(np.abs(covariance(state) - np.eye(k)).max())


def covariance(state: State) -> np.ndarray:
    return (state.vectors.T * (state.values**2 / state.n)) @ state.vectors


def whiten(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector that counts and component."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    x, dims = usable(rows, vector)
    state = fit(x, "x", dims) if dims else None
    w = whitener(state, components) if state else None
    if w is None or not len(w.components):
        return rows.sparkSession.createDataFrame([], schema)
    done = whitened(x, w, dims)
    error = identity_error(done, len(w.components))
    (at,) = fresh(done, "at")
    long = done.select("vec_id", "deviation", F.posexplode("whitened").alias(at, "value"))
    explained = F.element_at(F.array(*[F.lit(float(e)) for e in w.explained]), F.col(at) + 1)
    return long.select(
        "vec_id", (F.col(at) + 1).cast("int").alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation",
        F.col("value").alias("whitened"), explained.alias("explained"), F.lit(error).alias("identity_error"),
    )


__all__ = ["COMPONENTS", "State", "Whitener", "covariance", "deviations", "fit", "identity_error", "merged", "state_of", "usable", "whiten", "whitened", "whitener"]
