"""What several operators share: table access, checkpoints, row keys, ranks, broadcast bounds, batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from lodestrata.session import found_by_workers
from lodestrata.sources.shared import bounded, quoted, removed, shared_folder
from lodestrata.sources.shared import kept as cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_hash(text: Column | str = "text") -> Column:
    """Two 64-bit hashes of a whole text under different seeds, as a struct: equal for equal texts, and for nulls."""
    c = F.col(text) if isinstance(text, str) else text
    return F.struct(F.xxhash64(c).alias("a"), F.xxhash64(F.lit(7), c).alias("b"))


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names that df doesn't have, one for each stem."""
    tag = uuid.uuid5(uuid.NAMESPACE_OID, "|".join(sorted(c.lower() for c in df.columns))).hex[:8]
    taken = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        name = f"__{stem}_{tag}"
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def ranked(df: DataFrame, keys: list[str], out: str = "rank") -> DataFrame:
    """df, whose rows are narrow, with its gapless 0-based rank by keys, found without bringing all rows to one task.

    Rows are range-partitioned and sorted, checkpointed (so that a retry can't deal them anew), and each partition's offset is
    the sum of the counts before it, of which there is one a partition. keys should be unique for a definite rank.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rid, pid, n_rows = fresh(df, "rid", "pid", "rows")
    cols = [F.col(quoted(k)).asc_nulls_last() for k in keys]
    done = cut(df.repartitionByRange(n, *cols).sortWithinPartitions(*cols).withColumn(rid, F.monotonically_increasing_id()))
    done = done.withColumn(pid, F.shiftright(F.col(rid), 33))
    # one row for each partition
    counts = done.groupBy(pid).agg(F.count("*").alias(n_rows))
    starts = counts.select(pid, F.coalesce(F.sum(n_rows).over(Window.orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(n_rows))
    return done.join(F.broadcast(starts), pid).withColumn(out, F.col(n_rows) + F.col(rid).bitwiseAND(F.lit((1 << 33) - 1))).drop(rid, pid, n_rows)


#: Rows of whole texts, and bytes of them, that a Python worker works at once: texts vary from words to megabytes.
TEXT_ROWS, TEXT_BYTES = 500, 1 << 19


def text_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> SparkSession:
    """For jobs (the registered queries, the pipeline's stages) whose executors have little memory: from now on Python workers of this
    session get at most so many rows at once. Operators never change the session; they cut what they get."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))
    return spark


def by_bytes(texts: pd.Series, limit: int = TEXT_BYTES) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of about limit characters, so that a batch of very long texts doesn't fill memory."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t) if t is not None else 0
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def slices(batch: pa.RecordBatch, text: str, limit: int = TEXT_BYTES, rows: int = TEXT_ROWS) -> Iterator[pa.RecordBatch]:
    """The batch cut, without copying, so that each part holds about limit bytes of text and at most so many rows."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < len(sizes):
        end = min(at + rows, len(sizes), int(np.searchsorted(total, limit + (total[at - 1] if at else 0))) + 1)
        yield batch.slice(at, end - at)
        at = end


def with_results(rows: DataFrame, text: str, schema: str, make: Callable[[], Callable[[list[str | None]], dict[str, pa.Array]]]) -> DataFrame:
    """rows, in which the column text gives way to the columns of schema, which a function makes of some texts at once.

    make() gives that function in each task. The other columns stay in Arrow, so a long beside a null stays exact.
    """
    kept = [c for c in rows.columns if c != text]
    found_by_workers(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = None
        for b in batches:
            for part in slices(b, text):
                of = of or make()
                made = of(part.column(part.schema.get_field_index(text)).to_pylist())
                held = {c: part.column(part.schema.get_field_index(c)) for c in kept}
                yield pa.RecordBatch.from_arrays([*held.values(), *made.values()], names=[*held, *made])

    out = rows.select(*[quoted(c) for c in kept]).schema
    for f in DataType.fromDDL(schema):
        out = StructType([*out.fields, f])
    return rows.mapInArrow(run, out)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers (the public splitmix64 one)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


__all__ = ["bounded", "by_bytes", "cut", "fresh", "mix64", "quoted", "ranked", "removed", "shared_folder", "slices", "table", "text_batches", "text_hash", "with_results"]
