"""Ingest as files arrive: a stream only says that something changed, the run itself lists the whole corpus.

A file stream never tells of deletions and hides the names that matter here, so each micro-batch of notices (paths written to a
folder by whatever changes the corpus) starts one full, idempotent run; notices of one batch collapse into one run, and with
``availableNow`` the stream ends when none are left. A batch that is repeated after a failure finds nothing to change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestrata.operators.ingest import Ingest

NOTICE = "path string, changed_at timestamp"


def notices(spark: SparkSession, folder: str, files_at_once: int = 1000) -> DataFrame:
    return spark.readStream.schema(NOTICE).option("maxFilesPerTrigger", files_at_once).json(folder)


def start(spark: SparkSession, ingest: Ingest, folder: str, checkpoint: str, reports: list | None = None) -> StreamingQuery:
    """Runs ingest once for each micro-batch that has notices; reports, if given, collects what the runs return."""

    def on_batch(batch: DataFrame, _: int) -> None:
        if batch.limit(1).count():
            report = ingest.run()
            if reports is not None:
                reports.append(report)

    return notices(spark, folder).writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def lag(stream: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Notices a window, for watching: late ones are dropped behind the watermark."""
    return stream.withWatermark("changed_at", late).groupBy(F.window("changed_at", width)).agg(F.count("*").alias("n"), F.approx_count_distinct("path").alias("paths"))
