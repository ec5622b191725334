"""A transactional sink into a store's table, for batches and streams: tasks write files, one commit shows them, once.

``df.write.format("store_rows")`` and ``df.writeStream.format("store_rows")`` write Parquet files under names of their own; what a task
committed travels to the driver as a message, and the commit adds those files to the table in the store's log. A batch that carries a number
(a stream's always do) is entered under the writer's name: repeated after a failure, it finds itself there and removes its files
again. A failed job's files are removed by abort(), and those of a driver that died are in no manifest, so no reader sees
them and vacuum() takes them. The log's form is that of sources.store, through Arrow's file systems, as no JVM is at hand here.
"""

from __future__ import annotations

import json
import os
import re
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as afs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.streaming import DataStreamWriter

from lodestrata.session import found_by_workers
from lodestrata.sources import schemas

FORMAT = "store_rows"


class Log:
    """The manifests of a store, read and created without Spark."""

    def __init__(self, root: str):
        self.fs, self.root = afs.FileSystem.from_uri(root)

    def newest(self) -> dict:
        found = self.fs.get_file_info(afs.FileSelector(f"{self.root}/_log", allow_not_found=True))
        numbers = [int(f.base_name.removesuffix(".json")) for f in found if re.fullmatch(r"\d{20}\.json", f.base_name)]
        if not numbers:
            return {"version": 0, "tables": {}, "done": {}}
        with self.fs.open_input_stream(f"{self.root}/_log/{max(numbers):020d}.json") as f:
            return json.loads(f.read())

    def create(self, manifest: dict) -> bool:
        """The manifest under its number; False if another writer has it."""
        new, to = f"{self.root}/_log/.{uuid.uuid4().hex}", f"{self.root}/_log/{manifest['version']:020d}.json"
        self.fs.create_dir(f"{self.root}/_log", recursive=True)
        with self.fs.open_output_stream(new) as f:
            f.write(json.dumps(manifest, sort_keys=True).encode())
        try:
            if isinstance(self.fs, afs.LocalFileSystem):  # a local move replaces, a link doesn't
                os.link(new, to)
                return True
            self.fs.move(new, to)
            return True
        except OSError:
            if self.fs.get_file_info(to).type != afs.FileType.File:
                raise
            return False
        finally:
            if self.fs.get_file_info(new).type == afs.FileType.File:
                self.fs.delete_file(new)

    def add(self, table: str, files: list[str], app: str | None, batch: int | None) -> bool:
        """Shows files in a table, unless the batch was committed before."""
        while True:
            now = self.newest()
            if app is not None and batch is not None and now["done"].get(app, -1) >= batch:
                return False
            done = now["done"] | ({app: batch} if app is not None and batch is not None else {})
            tables = now["tables"] | {table: [*now["tables"].get(table, []), *files]}
            if self.create({"version": now["version"] + 1, "at": time.time(), "operation": f"sink {table}", "tables": tables, "done": done}):
                return True


@dataclass
class File(WriterCommitMessage):
    path: str | None
    rows: int


class _Rows:
    def __init__(self, root: str, table: str, app: str | None, batch: int | None):
        self.root, self.table, self.app, self.batch, self.folder = root, table, app, batch, f"v={uuid.uuid4().hex[:12]}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> File:
        from pyspark import TaskContext

        found, root = afs.FileSystem.from_uri(self.root)
        path = f"{self.folder}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex[:12]}.parquet"
        at, rows, out = f"{root}/{self.table}/{path}", 0, None
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                if out is None:
                    found.create_dir(f"{root}/{self.table}/{self.folder}", recursive=True)
                    out = pq.ParquetWriter(at, batch.schema, filesystem=found)
                out.write_batch(batch)
                rows += batch.num_rows
            if out:
                out.close()
        except BaseException:
            if out:
                out.close()
                found.delete_file(at)
            raise
        return File(path if rows else None, rows)

    def show(self, messages: list[File | None], batch: int | None) -> None:
        files = sorted(m.path for m in messages if m and m.path)
        if (files or batch is not None) and not Log(self.root).add(self.table, files, self.app, batch):
            self.remove(messages)

    def sweep(self) -> None:
        """Removes this writer's files that no manifest names: those of the batch that failed, of killed tasks too. What one writes even later, vacuum() takes."""
        found, root = afs.FileSystem.from_uri(self.root)
        named = set(Log(self.root).newest()["tables"].get(self.table, []))
        for f in found.get_file_info(afs.FileSelector(f"{root}/{self.table}/{self.folder}", allow_not_found=True)):
            if f"{self.folder}/{f.base_name}" not in named:
                found.delete_file(f.path)

    def remove(self, messages: list[File | None]) -> None:
        found, root = afs.FileSystem.from_uri(self.root)
        for m in messages:
            if m and m.path and found.get_file_info(f"{root}/{self.table}/{m.path}").type == afs.FileType.File:
                found.delete_file(f"{root}/{self.table}/{m.path}")


class BatchRows(_Rows, DataSourceArrowWriter):
    def commit(self, messages: list[File | None]) -> None:
        self.show(messages, self.batch)

    def abort(self, messages: list[File | None]) -> None:
        self.sweep()


class StreamRows(_Rows, DataSourceStreamArrowWriter):
    def commit(self, messages: list[File | None], batchId: int) -> None:  # noqa: N803
        self.show(messages, batchId)

    def abort(self, messages: list[File | None], batchId: int) -> None:  # noqa: N803
        self.sweep()


class StoreRows(DataSource):
    """Options: ``path`` (the store), ``table``, ``app`` (the writer's name, for a stream the same at each start), ``batch`` (a batch job's number)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _own(self, schema) -> tuple[str, str, str | None, int | None]:
        table = self.options["table"]
        want = schemas.columns(table)
        if [f.name for f in schema] != want:
            raise ValueError(f"{table} takes the columns {want}; shaped() makes them")
        return self.options["path"].rstrip("/"), table, self.options.get("app"), int(self.options["batch"]) if "batch" in self.options else None

    def writer(self, schema, overwrite: bool) -> BatchRows:
        if overwrite:
            raise ValueError("rows are appended; use mode('append')")
        return BatchRows(*self._own(schema))

    def streamWriter(self, schema, overwrite: bool) -> StreamRows:  # noqa: N802
        own = self._own(schema)
        if not own[2]:
            raise ValueError("a stream needs the option app, by which its batches are known again")
        return StreamRows(*own)


def shaped(rows: DataFrame, table: str) -> DataFrame:
    """rows with all columns of a stored table, in its order and types; what they lack is null."""
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.schema(table)])


def _registered(spark: SparkSession) -> None:
    found_by_workers(spark).dataSource.register(StoreRows)


def write(rows: DataFrame, root: str, table: str, app: str | None = None, batch: int | None = None) -> None:
    """rows into a stored table, as one commit; with app and batch only if that batch wasn't committed before."""
    _registered(rows.sparkSession)
    out = shaped(rows, table).write.format(FORMAT).mode("append").option("table", table)
    out = out if app is None else out.option("app", app)
    (out if batch is None else out.option("batch", str(batch))).save(root)


def stream(rows: DataFrame, root: str, table: str, app: str, checkpoint: str) -> DataStreamWriter:
    """A stream's rows into a stored table, each micro-batch as one commit; to be started."""
    _registered(rows.sparkSession)
    return shaped(rows, table).writeStream.format(FORMAT).outputMode("append").option("path", root).option("table", table).option("app", app).option("checkpointLocation", checkpoint)
