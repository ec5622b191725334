"""Answers as a stream of pieces: each micro-batch carries the next few pieces of every pending prompt, as a model makes them.

``spark.readStream.format("answer_pieces")`` reads a folder of prompts (Parquet: qid, prompt), a file a task. Its offset is how many pieces of each
answer were asked for; a micro-batch asks the provider for ``step`` more, from where the last one ended, so a batch that is repeated
after a failure asks for the same ones, and pieces are shown long before an answer is whole. A row with last = true and no piece ends
an answer. A provider is a function (prompt, start) that yields the pieces from place start on, named as ``module:function``.
"""

from __future__ import annotations

import importlib
import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as afs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from lodestrata.session import found_by_workers

FORMAT = "answer_pieces"
PIECE = "qid string, place int, piece string, last boolean"
#: Pieces of an answer in one micro-batch, and at most in all.
STEP, MOST = 32, 4096
Provider = Callable[[str, int], Iterator[str]]


def named(provider: str) -> Provider:
    module, function = provider.split(":")
    return getattr(importlib.import_module(module), function)


def between(provider: Provider, prompt: str, start: int, end: int) -> Iterator[tuple[int, str | None, bool]]:
    """The pieces at places start to end - 1, and the row that ends the answer if it ends there."""
    place = start
    for place, piece in zip(range(start, end), itertools.chain(provider(prompt, start), itertools.repeat(None)), strict=False):
        if piece is None:
            # an answer of n pieces ends at place n, once: what starts behind it has nothing
            if place > start or start == 0 or next(iter(provider(prompt, start - 1)), None) is not None:
                yield place, None, True
            return
        yield place, piece, False


@dataclass
class Ask(InputPartition):
    file: str
    start: int
    end: int


class PieceReader(DataSourceStreamReader):
    def __init__(self, path: str, provider: str, step: int, most: int):
        self.path, self.provider, self.step, self.most = path, provider, step, most
        self.asked = 0

    def initialOffset(self) -> dict:  # noqa: N802
        return {"place": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        self.asked = min(self.asked + self.step, self.most + 1)
        return {"place": self.asked}

    def partitions(self, start: dict, end: dict) -> list[Ask]:
        self.asked = max(self.asked, end["place"])  # after a restart it goes on from the checkpoint
        found, root = afs.FileSystem.from_uri(self.path)
        files = sorted(f.path for f in found.get_file_info(afs.FileSelector(root, recursive=True)) if f.path.endswith(".parquet"))
        return [Ask(f, start["place"], end["place"]) for f in files] if end["place"] > start["place"] else []

    def read(self, partition: Ask) -> Iterator[pa.RecordBatch]:
        found, _ = afs.FileSystem.from_uri(self.path)
        provider = named(self.provider)
        with found.open_input_file(partition.file) as f:
            for batch in pq.ParquetFile(f).iter_batches(columns=["qid", "prompt"], batch_size=64):
                rows = [(q, *r) for q, p in zip(batch["qid"].to_pylist(), batch["prompt"].to_pylist(), strict=True) if p is not None for r in between(provider, p, partition.start, partition.end)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.string(), pa.bool_()), strict=True)], names=["qid", "place", "piece", "last"])

    def commit(self, end: dict) -> None:
        pass


class AnswerPieces(DataSource):
    """Options: ``path`` (the prompts), ``provider``, ``step``, ``most``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return PIECE

    def streamReader(self, schema) -> PieceReader:  # noqa: N802
        return PieceReader(self.options["path"], self.options["provider"], int(self.options.get("step", STEP)), int(self.options.get("most", MOST)))


def stream(spark: SparkSession, prompts: str, provider: str, step: int = STEP, most: int = MOST) -> DataFrame:
    """qid, place, piece, last of the answers to all prompts of a folder."""
    found_by_workers(spark).dataSource.register(AnswerPieces)
    return spark.readStream.format(FORMAT).option("provider", provider).option("step", str(step)).option("most", str(most)).load(prompts)


def told(spark: SparkSession, prompts: str, provider: str, out: str, checkpoint: str, step: int = STEP, most: int = MOST, seconds: float = 600.0) -> DataFrame:
    """Streams the pieces into out until every answer has ended (or most pieces, or seconds), and gives the rows written: qid, place, piece, last, batch."""
    n = spark.read.parquet(prompts).where("prompt is not null").count()

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream(spark, prompts, provider, step, most).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
    rows = lambda: spark.read.schema(PIECE + ", batch int").parquet(out)
    done, seen = 0, -1
    try:
        while query.isActive and done < n and seconds > 0:
            query.awaitTermination(0.2)
            seconds -= 0.2
            last = query.lastProgress
            if last and last["batchId"] > seen:
                seen = last["batchId"]
                done = rows().where("last").count() if n else 0
                if (seen + 1) * step > most:
                    break
        if query.exception():
            raise query.exception()
    finally:
        query.stop()
    return rows()


def joined(rows: DataFrame) -> DataFrame:
    """qid, answer, n_pieces: the pieces of each answer in their order."""
    said = rows.where("piece is not null").groupBy("qid").agg(F.array_sort(F.collect_set(F.struct("place", "piece"))).alias("ps"))  # at most ``most`` pieces an answer
    every = rows.where("last").select("qid").distinct()
    return every.join(said, "qid", "left").select("qid", F.coalesce(F.array_join("ps.piece", ""), F.lit("")).alias("answer"), F.greatest(F.size("ps"), F.lit(0)).cast("long").alias("n_pieces"))
