"""Token ids as length-delimited binary records, with an index of offsets for shuffled reads: a data source that writes and reads them.

A folder holds, for each task that wrote, one data file and one index file, and a manifest that names them in order. A data file is a
run of frames: the payload's length (8 bytes), the masked checksum of those 8 bytes (4), the payload, the payload's masked checksum (4);
all little-endian. A payload is one sequence: a flags byte (1: the id is null, 2: tokens take 4 bytes), the doc_id (8 bytes), the token
ids in 2 bytes each, or 4 if one is beyond 65,535. An index file holds one entry a frame (its offset and size, the tokens before it in
the file, its tokens, the id and flags) and ends in the masked checksum of all entries. The mask is the one that record files use: the
checksum (CRC-32) turned right by 15 bits, plus a constant, so that a checksum of bytes that hold checksums stays telling.

Writing is exact under lost executors: a task writes under a name of its own, only the files of committed tasks come into the
manifest, which shows them at once by a rename, and an aborted job removes what its tasks wrote. Documents are dealt by ranges of their
id and sorted in each task, so files in the manifest's order, and records in each, ascend. Files are read through Arrow's file
systems, so the folder may lie wherever workers can reach it.

Cases: null text is empty text, a sequence of the end id alone; a null doc_id comes first and stays null; rows that repeat a doc_id are
each written, ordered by their text's hash; an empty table gives a manifest without files and no rows; other columns are not read,
whatever their names; a very long text is one long record, read back alone. A record whose checksum fails raises.
"""

from __future__ import annotations

import json
import struct
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyarrow import fs as afs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from lodestrata.llm.common import fresh, slices
from lodestrata.llm.pack_pow2 import END_ID, default_tokenizer, word_ids
from lodestrata.session import found_by_workers

FORMAT = "token_records"
#: What is added to a turned checksum; flags of a payload.
MASK, NULL_ID, WIDE = 0xA282EAD8, 1, 2
HEAD, CHECK, PAYLOAD = struct.Struct("<QI"), struct.Struct("<I"), struct.Struct("<Bq")
ENTRY = np.dtype([("offset", "<i8"), ("size", "<i8"), ("start", "<i8"), ("tokens", "<i8"), ("doc_id", "<i8"), ("flags", "<i8")])
MANIFEST = "manifest.json"
#: Bytes of frames read at once, and of a file that one task reads.
CHUNK, SPLIT = 4 << 20, 64 << 20
ROWS = "doc_id long, start long, n_tokens long, ids binary"
INDEX = "file string, base long, offset long, size long, start long, n_tokens long, doc_id long"


def masked(data: bytes | memoryview) -> int:
    c = crc32(data)
    return (((c >> 15) | (c << 17)) + MASK) & 0xFFFFFFFF


def framed(doc_id: int | None, ids: bytes) -> tuple[bytes, int]:
    """The frame of one sequence, whose ids come as little-endian unsigned 32-bit bytes, and its flags."""
    wide = np.frombuffer(ids, dtype="<u4")
    flags = (doc_id is None) * NULL_ID + bool(len(wide) and int(wide.max()) > 0xFFFF) * WIDE
    payload = PAYLOAD.pack(flags, doc_id or 0) + (ids if flags & WIDE else wide.astype("<u2").tobytes())
    size = struct.pack("<Q", len(payload))
    return size + CHECK.pack(masked(size)) + payload + CHECK.pack(masked(payload)), flags


def unframed(data: memoryview, where: str) -> tuple[int | None, bytes]:
    """doc_id and ids (32-bit bytes) of one frame; both checksums are verified."""
    size, own = HEAD.unpack_from(data)
    end = HEAD.size + size
    if masked(data[:8]) != own or end + CHECK.size != len(data):
        raise ValueError(f"{where}: the length of a record is damaged")
    payload = data[HEAD.size : end]
    if masked(payload) != CHECK.unpack_from(data, end)[0]:
        raise ValueError(f"{where}: a record is damaged")
    flags, doc_id = PAYLOAD.unpack_from(payload)
    tokens = payload[PAYLOAD.size :]
    return None if flags & NULL_ID else doc_id, bytes(tokens) if flags & WIDE else np.frombuffer(tokens, dtype="<u2").astype("<u4").tobytes()


def opened(path: str) -> tuple[afs.FileSystem, str]:
    found, at = afs.FileSystem.from_uri(path)
    return found, at.rstrip("/")


def manifest(path: str) -> list[dict]:
    """The files of a folder in order: name, records, tokens, bytes; none if nothing was written yet."""
    found, at = opened(path)
    if found.get_file_info(f"{at}/{MANIFEST}").type != afs.FileType.File:
        return []
    with found.open_input_stream(f"{at}/{MANIFEST}") as f:
        return json.loads(f.read())


def entries(found: afs.FileSystem, at: str, name: str) -> np.ndarray:
    """A data file's index, verified."""
    with found.open_input_stream(f"{at}/{name}.idx") as f:
        data = f.read()
    if len(data) < CHECK.size or masked(memoryview(data)[: -CHECK.size]) != CHECK.unpack_from(data, len(data) - CHECK.size)[0]:
        raise ValueError(f"{name}: the index is damaged")
    return np.frombuffer(data, dtype=ENTRY, count=(len(data) - CHECK.size) // ENTRY.itemsize)


@dataclass
class Written(WriterCommitMessage):
    partition: int
    name: str
    records: int
    tokens: int
    size: int


class RecordWriter(DataSourceArrowWriter):
    """One data file and one index a task; commit() shows all of them, abort() removes them."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex[:12]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{self.job}-{uuid.uuid4().hex[:8]}.tok"
        found, at = opened(self.path)
        found.create_dir(at, recursive=True)
        offset = tokens = records = check = 0
        try:
            with found.open_output_stream(f"{at}/{name}") as data, found.open_output_stream(f"{at}/{name}.idx") as index:
                for batch in iterator:
                    doc_ids, ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist(), batch.column(batch.schema.get_field_index("ids"))
                    made = np.zeros(len(doc_ids), dtype=ENTRY)
                    for k, doc_id in enumerate(doc_ids):
                        own = ids[k].as_py() or b""
                        frame, flags = framed(doc_id, own)
                        data.write(frame)
                        made[k] = (offset, len(frame), tokens, len(own) // 4, doc_id or 0, flags)
                        offset, tokens, records = offset + len(frame), tokens + len(own) // 4, records + 1
                    index.write(made.tobytes())
                    check = crc32(made.tobytes(), check)
                index.write(CHECK.pack((((check >> 15) | (check << 17)) + MASK) & 0xFFFFFFFF))
        except BaseException:
            self._remove([name])
            raise
        if not records:
            self._remove([name])
        return Written(part, name, records, tokens, offset)

    def _remove(self, names: list[str]) -> None:
        found, at = opened(self.path)
        for n in names:
            for file in (f"{at}/{n}", f"{at}/{n}.idx"):
                if found.get_file_info(file).type == afs.FileType.File:
                    found.delete_file(file)

    def commit(self, messages: list[Written | None]) -> None:
        new = [{"name": m.name, "records": m.records, "tokens": m.tokens, "bytes": m.size} for m in sorted((m for m in messages if m and m.records), key=lambda m: m.partition)]
        old = manifest(self.path)
        found, at = opened(self.path)
        found.create_dir(at, recursive=True)
        with found.open_output_stream(f"{at}/{MANIFEST}.{self.job}") as f:
            f.write(json.dumps(new if self.overwrite else old + new).encode())
        found.move(f"{at}/{MANIFEST}.{self.job}", f"{at}/{MANIFEST}")
        if self.overwrite:
            self._remove([f["name"] for f in old])

    def abort(self, messages: list[Written | None]) -> None:
        """Removes the job's files, those of tasks that were killed too; one that a task makes even later is left to swept()."""
        found, at = opened(self.path)
        self._remove([f.base_name for f in found.get_file_info(afs.FileSelector(at, allow_not_found=True)) if f"-{self.job}-" in f.base_name and f.base_name.endswith(".tok")])


def swept(path: str, grace: float = 24 * 3600.0) -> list[str]:
    """Removes files older than grace seconds that no manifest names, as killed tasks leave them; their names."""
    found, at = opened(path)
    named = {f["name"] for f in manifest(path)}
    own = [f for f in found.get_file_info(afs.FileSelector(at, allow_not_found=True)) if f.base_name.endswith((".tok", ".tok.idx"))]
    gone = [f for f in own if f.base_name.removesuffix(".idx") not in named and f.mtime_ns < (time.time() - grace) * 1e9]
    for f in gone:
        found.delete_file(f.path)
    return sorted(f.base_name for f in gone)


@dataclass
class Part(InputPartition):
    """The k-th of n parts of a file's records; base: the tokens of all files before it."""

    name: str
    base: int
    k: int
    n: int


class RecordReader(DataSourceReader):
    def __init__(self, path: str, split: int, index: bool):
        self.path, self.split, self.index = path, split, index

    def partitions(self) -> list[Part]:
        out, base = [], 0
        for f in manifest(self.path):
            n = 1 if self.index else min(max(1, -(-f["bytes"] // self.split)), f["records"])
            out += [Part(f["name"], base, k, n) for k in range(n)]
            base += f["tokens"]
        return out or [Part("", 0, 0, 1)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        found, at = opened(self.path)
        own = entries(found, at, partition.name)
        own = own[len(own) * partition.k // partition.n : len(own) * (partition.k + 1) // partition.n]
        if self.index:
            yield from self._listed(own, partition)
            return
        with found.open_input_file(f"{at}/{partition.name}") as f:
            first = 0
            ends = own["offset"] + own["size"]
            while first < len(own):
                last = max(first + 1, int(np.searchsorted(ends, own["offset"][first] + CHUNK, side="right")))
                data = memoryview(f.read_at(int(ends[last - 1] - own["offset"][first]), int(own["offset"][first])))
                part, at0 = own[first:last], int(own["offset"][first])
                made = [unframed(data[o - at0 : o - at0 + s], partition.name) for o, s in zip(part["offset"].tolist(), part["size"].tolist(), strict=True)]
                yield batch_of(made, (part["start"] + partition.base).tolist())
                first = last

    def _listed(self, own: np.ndarray, partition: Part) -> Iterator[pa.RecordBatch]:
        null = (own["flags"] & NULL_ID) > 0
        columns = [pa.array([partition.name] * len(own), pa.string()), pa.array(np.full(len(own), partition.base)), *[pa.array(own[c].astype(np.int64)) for c in ("offset", "size", "start", "tokens")], pa.array(own["doc_id"].astype(np.int64), mask=null)]
        yield pa.RecordBatch.from_arrays(columns, names=["file", "base", "offset", "size", "start", "n_tokens", "doc_id"])


def batch_of(made: list[tuple[int | None, bytes]], starts: list[int]) -> pa.RecordBatch:
    ids = [d for _, d in made]
    columns = [pa.array([i for i, _ in made], pa.int64()), pa.array(starts, pa.int64()), pa.array([len(d) // 4 for d in ids], pa.int64()), pa.array(ids, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids"])


class TokenRecords(DataSource):
    """``spark.read.format("token_records").load(folder)`` and ``df.write.format("token_records").mode("append" or "overwrite").save(folder)``.

    Rows to write are doc_id and ids (binary, little-endian unsigned 32-bit); rows read also have start (the ids of all records before it)
    and n_tokens. Options: ``split`` (bytes of a file that one task reads), ``index`` ("true": the offsets in place of the records).
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return INDEX if self._index() else ROWS

    def _index(self) -> bool:
        return self.options.get("index", "false").lower() == "true"

    def reader(self, schema) -> RecordReader:
        return RecordReader(self.options["path"], int(self.options.get("split", SPLIT)), self._index())

    def writer(self, schema, overwrite: bool) -> RecordWriter:
        return RecordWriter(self.options["path"], overwrite)


def encoded(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """doc_id and ids (the tokenizer's and the end id, as bytes) of every document, in ascending order of doc_id.

    Texts are dealt before they become ids, as the range bounds' sampling would make them twice. Rows that repeat an id and text are dealt by
    their place as well, so one key fills no task.
    """
    path, end = tokenizer or default_tokenizer(), np.asarray([end_id], dtype="<u4").tobytes()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    tie, place = fresh(rows, "tie", "place")
    order = [F.col("doc_id").asc_nulls_first(), F.col(tie), F.col(place)]
    dealt = rows.withColumn(tie, F.xxhash64("text")).withColumn(place, F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = word_ids(path)
        for b in batches:
            for part in slices(b, "text"):
                made = [data + end for data in ids([t or "" for t in part.column("text").to_pylist()])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(made, pa.binary())], names=["doc_id", "ids"])

    found_by_workers(docs.sparkSession)
    return dealt.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary")


def registered(spark: SparkSession) -> SparkSession:
    found_by_workers(spark).dataSource.register(TokenRecords)
    return spark


def write(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID, mode: str = "overwrite") -> None:
    """The documents' token ids as records in folder."""
    registered(docs.sparkSession)
    encoded(docs, tokenizer, end_id).write.format(FORMAT).mode(mode).save(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids of every record; within a task in the order of the file."""
    return registered(spark).read.format(FORMAT).load(folder)


def index(spark: SparkSession, folder: str) -> DataFrame:
    """Where each record lies: file, base (tokens of the files before), offset, size, start (in the file), n_tokens, doc_id."""
    return registered(spark).read.format(FORMAT).option("index", "true").load(folder)


def shuffled(spark: SparkSession, folder: str, seed: int) -> DataFrame:
    """The records in an order that depends on the seed: only index entries are sorted, and each record is then read at its offset."""
    where = index(spark, folder)
    (order,) = fresh(where, "order")
    keys = [F.col(order), F.col("file"), F.col("offset")]
    dealt = where.withColumn(order, F.xxhash64(F.lit(seed), "file", "offset")).repartitionByRange(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, at = opened(folder)
        for b in batches:
            made, starts, held = [], [], 0
            for r in b.to_pylist():
                with found.open_input_file(f"{at}/{r['file']}") as f:
                    made.append(unframed(memoryview(f.read_at(r["size"], r["offset"])), r["file"]))
                starts.append(r["base"] + r["start"])
                held += r["size"]
                if held > CHUNK:
                    yield batch_of(made, starts)
                    made, starts, held = [], [], 0
            yield batch_of(made, starts)

    return dealt.select("file", "base", "offset", "size", "start").mapInArrow(run, ROWS)


__all__ = ["FORMAT", "TokenRecords", "encoded", "framed", "index", "manifest", "masked", "read", "registered", "shuffled", "swept", "unframed", "write"]
