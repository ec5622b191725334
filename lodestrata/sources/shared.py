"""Rows kept in the folder that all executors share, and sizes that decide whether rows may be broadcast."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A relation is broadcast only if its measured size is at most this many bytes.
BROADCAST_BYTES = 32 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; only a local session, as in tests, may go without it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: a cluster needs a folder that all executors share")
    return f"{tempfile.gettempdir()}/lodestrata-checkpoints"


def kept(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared folder; what reads it twice doesn't compute it twice, and it survives lost executors.

    With ``spark.cleaner.referenceTracking.cleanCheckpoints`` Spark removes the files once nothing refers to them.
    """
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def removed(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that this package wrote and nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def _set(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def shuffles_removed(spark: SparkSession):
    """Meanwhile Spark removes an action's shuffle files when it ends; else they stay until the driver happens to collect its garbage."""
    return _set(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


#: Folders that a task writes to at once.
OPEN_FILES = 128


def files_open(spark: SparkSession):
    """Meanwhile a task that writes folders (bucket, department) keeps up to OPEN_FILES files open, so that rows that were dealt by folder aren't sorted by it again; beyond that Spark sorts what is left."""
    return _set(spark, "spark.sql.maxConcurrentOutputFileWriters", str(OPEN_FILES))


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """df with rows of one folder (by) together, so that few files are written; Spark splits what is large and joins what is small."""
    return df.hint("rebalance", *by)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def measured(df: DataFrame) -> int:
    """About how many bytes df's values take, by one aggregate."""
    size = F.lit(0).cast("long")
    for name, kind in df.dtypes:
        c = F.col(quoted(name))
        if kind == "string" or kind == "binary":
            size = size + F.coalesce(F.octet_length(c), F.lit(0)).cast("long")
        elif kind.startswith("array"):
            size = size + F.coalesce(F.octet_length(F.to_json(c)), F.lit(0)).cast("long")
        else:
            size = size + F.lit(16).cast("long")
    return df.agg(F.coalesce(F.sum(size + F.lit(32).cast("long")), F.lit(0)).alias("n")).first()["n"]


def bounded(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether df's values stay under limit bytes, so that it may be broadcast."""
    return measured(df) <= limit


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df, marked to be broadcast if it is measured to be small enough; else Spark shuffles it."""
    return F.broadcast(df) if bounded(df, limit) else df
