"""Connected components of an edge table, by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import cut


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """node, root (the least node of its component) of every node of edges (u, v: long) but the roots themselves.

    Each round is a few shuffles of the edges, written to the checkpoint folder; rounds grow with the logarithm of a component's
    extent. No edge reaches the driver, only each round's count and checksum. More than ``most`` rounds are an error, never a result.
    """
    e = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = lambda d: tuple(d.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
    was = mark(e)
    for _ in range(most):
        if not was[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # the minima are written, so that the joins have an exchange on both sides, which lets Spark split a hot node's edges
        least = cut(both.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m")).select("c", F.least("c", "m").alias("m")))
        large = both.where("v > u").join(least, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = cut(large)
        least = cut(large.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m")))
        small = large.join(least, F.col("u") == F.col("c")).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("s")).select("s.u", "s.v")
        e = cut(small.where("u <> v").distinct())
        now = mark(e)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError(f"components are not found after {most} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
