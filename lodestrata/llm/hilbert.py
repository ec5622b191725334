"""Sharding along a Hilbert curve.

Several metadata dimensions of a document (its size, language, source and id) are quantised to a few bits each, the cell's index
on the Hilbert curve through that grid is the sort key, and the sorted rows are cut into runs: files of one run span few values
of every dimension, so a reader that filters on any of them skips most files (assign() gives the bounds it prunes by).

Law ``rows``: shard counts are at most one apart. Law ``bytes``: a run ends where its share of all bytes does, so sizes are equal
but for a document at each end. Both come from one distributed rank (range partitions, checkpointed, a count for each).

Groups of equal texts are not kept together: the curve orders metadata, and the laws bound counts or bytes, which a large group would
break. Equal texts with equal metadata adjoin, as a cell's rows are ordered by the text's checksum.

Cases: null text counts as empty (size 16, checksum 0); null metadata comes first in its dimension; languages and sources that
agree in the first six bytes behind what all share take one cell; equal cells are ordered by the text's checksum,
then doc_id (nulls last), and rows equal in all of these are interchangeable; a table with fewer rows than shards leaves shards
empty; an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.common import cut, ranked
from lodestrata.session import found_by_workers

SHARDS = 40
BITS = 6


def curve_index(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of each row of cells (one column a dimension, values under 2**bits), by Skilling's published transform."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            hit = (x[i] & q) != 0
            swap = np.where(hit, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(hit, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, lang, source; lang and source are text, and null where their column is missing."""
    text = F.coalesce(F.col("text"), F.lit(""))
    has = {c.lower() for c in docs.columns}
    dim = lambda c: (F.col(c) if c in has else F.lit(None)).cast("string").alias(c)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(16)).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), dim("lang"), dim("source"),
    )


def ordinal(c: str, skip: int) -> Column:
    """The six bytes of a text behind the first skip ones, as a number in the texts' order."""
    part = F.rpad(F.substring(F.col(c).cast("binary"), skip + 1, 6), 6, F.lit(b"\0"))
    return F.conv(F.hex(part), 16, 10).cast("long")


def on_curve(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """measured(), with the curve's index of each row's cell.

    A dimension's cells are its quantiles (approximate ones, from one bounded sketch of all rows), in the order of its values: so
    cells are equally full, a common value has a cell of its own, and a far outlier takes no room.
    """
    found_by_workers(docs.sparkSession)
    rows = cut(measured(docs))  # narrow; texts are read once
    ends = rows.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("lang", "source") for f in (F.min, F.max)]).first()
    skip = {c: len(os.path.commonprefix([(ends[f"{f}_{c}"] or "").encode() for f in ("min", "max")])) for c in ("lang", "source")}
    places = {"size": F.col("size"), "lang": ordinal("lang", skip["lang"]), "source": ordinal("source", skip["source"]), "doc_id": F.col("doc_id")}
    shares = [k / (1 << bits) for k in range(1, 1 << bits)]
    edges = rows.agg(*[F.percentile_approx(c, shares, 10_000).alias(n) for n, c in places.items()]).first()
    edges = [np.asarray(edges[n] or [], dtype=np.int64) for n in places]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [b.column(b.num_columns - len(edges) + k).to_numpy() for k in range(len(edges))]
            cells = np.stack([np.searchsorted(e, v, side="left") for e, v in zip(edges, own, strict=True)], axis=1).astype(np.int64)
            kept = b.num_columns - len(edges)  # in Arrow, so that an id beside a null stays exact
            yield pa.RecordBatch.from_arrays([*b.columns[:kept], pa.array(curve_index(cells, bits))], names=[*b.schema.names[:kept], "curve"])

    least = F.lit(-(1 << 63)).cast("long")
    return rows.select("*", *[F.coalesce(c, least).alias(f"place_{n}") for n, c in places.items()]).mapInArrow(run, "doc_id long, size long, text_crc32 long, lang string, source string, curve long")


def shard(docs: DataFrame, shards: int = SHARDS, law: str = "rows", bits: int = BITS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard (from 0), slot (gapless in a shard), grown_shard (null: no key law), curve, lang, source."""
    if law not in ("rows", "bytes"):
        raise ValueError("law must be rows or bytes")
    at = ranked(on_curve(docs, bits), ["curve", "text_crc32", "doc_id", "size"], "at")
    if law == "rows":
        n = at.count()
        base, more = divmod(n, shards)
        edge = more * (base + 1)  # the first `more` shards hold one row more
        long_run, short_run = F.lit(base + 1).cast("long"), F.lit(max(base, 1)).cast("long")
        in_long = F.col("at") < edge
        out = at.withColumn("shard", F.when(in_long, F.floor(F.col("at") / long_run)).otherwise(F.lit(more) + F.floor((F.col("at") - edge) / short_run)).cast("int"))
        out = out.withColumn("slot", F.when(in_long, F.col("at") % long_run).otherwise((F.col("at") - edge) % short_run).cast("long"))
    else:
        out = _by_bytes(at, shards)
    return out.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve", "lang", "source")


def _by_bytes(at: DataFrame, shards: int) -> DataFrame:
    """Runs by bytes: a row belongs to the share of all bytes in which its middle lies. Blocks of ranks are summed first, so that a
    running sum is only ever taken within a block."""
    block = 1 << 16
    at = at.withColumn("block", F.floor(F.col("at") / block))
    sums = cut(at.groupBy("block").agg(F.sum("size").alias("bytes")))
    # one row for each 65,536 documents
    sums = sums.withColumn("before", F.coalesce(F.sum("bytes").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    total = sums.agg(F.coalesce(F.sum("bytes"), F.lit(1))).first()[0]
    inside = Window.partitionBy("block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = at.join(sums.select("block", "before"), "block").withColumn("start", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = cut(placed.withColumn("shard", F.least(F.lit(shards - 1), F.floor((F.col("start") + F.col("size") / 2) * shards / F.lit(total))).cast("int")).select("doc_id", "size", "text_crc32", "curve", "lang", "source", "at", "shard"))
    firsts = placed.groupBy("shard").agg(F.min("at").alias("first"))
    return placed.join(F.broadcast(firsts), "shard").withColumn("slot", (F.col("at") - F.col("first")).cast("long"))


def assign(docs: DataFrame, shards: int = SHARDS, law: str = "rows", bits: int = BITS) -> DataFrame:
    """For each shard of shard() the bounds a reader prunes by: least and greatest of every dimension, and the curve's run."""
    out = shard(docs, shards, law, bits)
    bounds = [f(c).alias(f"{f.__name__}_{c}") for c in ("curve", "size", "lang", "source", "doc_id") for f in (F.min, F.max)]
    return out.groupBy("shard").agg(F.count("*").alias("n_docs"), F.sum("size").alias("bytes"), *bounds)
