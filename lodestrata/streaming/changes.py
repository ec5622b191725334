"""The state of every path as a stream: each notice (a path, its content's hash or null for a deletion, when it was seen) meets what was last known of it.

State is keyed by path: the last hash, whether the path is active, and the time of the newest notice. Of the notices of one path in a
micro-batch only the newest counts, and for the hash the newest that has one, so memory doesn't grow with how often a path is
noticed; a notice older than what is known changes nothing. A path that is not seen again within ``ttl`` is tombstoned by an event-time timer
once the watermark passes it. What comes out is what operators.ingest.diffed() and vanished() say of whole tables: added, updated,
reactivated, unchanged, tombstoned. Sinks get a micro-batch under its number, so one that is repeated replaces its own rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lodestrata.session import found_by_workers

NOTICE = "source_path string, content_hash string, seen_at timestamp"
CHANGE = "source_path string, change string, content_hash string, at timestamp"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class PathState(StatefulProcessor):
    """Rows, not frames: a path has few notices, and a frame for each path costs more than all else. Times are milliseconds."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "content_hash string, active boolean, at long")

    def _keep(self, content_hash: str | None, active: bool, at: int, timed: int | None) -> None:
        """timed: the notice whose timer stands, as every active path has one and no other has."""
        self.last.update((content_hash, active, at))
        if self.ttl_ms is None or (active and timed == at):
            return
        if timed is not None:
            self.handle.deleteTimer(timed + self.ttl_ms)
        if active:
            self.handle.registerTimer(at + self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        newest = hashed = None  # (when in ms, hash)
        for r in rows:
            one = (r["ms"], r["content_hash"] or "")
            newest = max(newest or one, one)
            if r["content_hash"] is not None:
                hashed = max(hashed or one, one)
        known = self.last.get()
        old_hash, active, at = known or (None, False, -1)
        when, content_hash = newest
        timed = at if active else None
        if when < at:
            return
        before = hashed[1] if hashed and hashed[0] >= at else old_hash  # the hash under which a deleted path is remembered
        if not content_hash:
            change = "tombstoned" if active or (known is None and hashed) else None
            self._keep(before, False, when, timed)
        else:
            change = "added" if known is None else "updated" if content_hash != old_hash else "unchanged" if active else "reactivated"
            self._keep(content_hash, True, when, timed)
        if change:
            yield Row(source_path=key[0], change=change, content_hash=content_hash or before, ms=when)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        known = self.last.get()
        if known is None:
            return
        content_hash, active, at = known
        due = expiredTimerInfo.getExpiryTimeInMs()
        if active and at + self.ttl_ms <= due:
            self.last.update((content_hash, False, at))
            yield Row(source_path=key[0], change="tombstoned", content_hash=content_hash, ms=due)

    def close(self) -> None:
        pass


def changes(notices: DataFrame, ttl: str | None = None, late: str = "1 hour") -> DataFrame:
    """source_path, change, content_hash, at of a stream of notices. ttl, such as "1 day": paths not seen for so long are tombstoned."""
    found_by_workers(notices.sparkSession)
    ttl_ms = None if ttl is None else int(pd.Timedelta(ttl).total_seconds() * 1000)
    keyed = notices.where("source_path is not null and seen_at is not null").withWatermark("seen_at", late).select("source_path", "content_hash", "seen_at", F.unix_millis("seen_at").alias("ms")).groupBy("source_path")
    found = keyed.transformWithState(statefulProcessor=PathState(ttl_ms), outputStructType="source_path string, change string, content_hash string, ms long", outputMode="Update", timeMode="None" if ttl is None else "EventTime")
    return found.select("source_path", "change", "content_hash", F.timestamp_millis("ms").alias("at"))


def notices(spark: SparkSession, folder: str, files_at_once: int = 1000) -> DataFrame:
    return spark.readStream.schema(NOTICE).option("maxFilesPerTrigger", files_at_once).parquet(folder)


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB; the session's own setting comes back afterwards."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def start(spark: SparkSession, folder: str, out: str, checkpoint: str, ttl: str | None = None, late: str = "1 hour") -> StreamingQuery:
    """Writes the changes of all notices that wait in folder to out, a folder a micro-batch, and ends."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    with keyed_state(spark):
        return changes(notices(spark, folder), ttl, late).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def present(spark: SparkSession, out: str) -> DataFrame:
    """What the changes written so far make of each path: its last change, hash and whether it is active."""
    rows = spark.read.schema(CHANGE + ", batch long").parquet(out)
    last = rows.groupBy("source_path").agg(F.max_by(F.struct("change", "content_hash"), F.struct("batch", "at")).alias("l"))
    return last.select("source_path", F.col("l.change").alias("change"), F.col("l.content_hash").alias("content_hash"), (F.col("l.change") != "tombstoned").alias("active"))
