"""Token records: round trips, damage, repeated and aborted writes, shuffled reads."""

import os
import time
import uuid

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata.llm import pack_pow2, token_records

from .helpers import docs, words

ROWS = [(k, words(k, 3 + k % 50)) for k in range(120)] + [(500, words(9, 9000)), (501, "twice"), (501, "twice"), (501, "other"), (502, None), (503, ""), (None, "no id"), (-4, "negative first")]


def plain(rows):
    """doc_id -> its ids, in ascending order of ids with null first; equal doc_ids in any order."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(pack_pow2.default_tokenizer())
    return [(d, [*whole.encode(t or "", add_special_tokens=False).ids, 1]) for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))]


def ids(r):
    return np.frombuffer(r["ids"], dtype="<u4").tolist()


@settings(max_examples=100, deadline=None)
@given(st.one_of(st.none(), st.integers(-(2**63), 2**63 - 1)), st.lists(st.integers(0, 2**32 - 1), max_size=40))
def test_frame_round_trip(doc_id, tokens):
    data = np.asarray(tokens, dtype="<u4").tobytes()
    frame, _ = token_records.framed(doc_id, data)
    assert token_records.unframed(memoryview(frame), "x") == (doc_id, data)


def test_every_damaged_byte_is_seen():
    frame, _ = token_records.framed(7, np.asarray([1, 2, 70_000], dtype="<u4").tobytes())
    for k in range(len(frame)):
        with pytest.raises(ValueError, match="damaged"):
            token_records.unframed(memoryview(frame[:k] + bytes([frame[k] ^ 4]) + frame[k + 1 :]), "x")
    with pytest.raises(ValueError, match="damaged"):
        token_records.unframed(memoryview(frame[:-1]), "x")


def test_round_trip_in_order(spark, tmp_path):
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in ROWS], "doc_id long, text string, start int, ids string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        token_records.write(df, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = sorted(token_records.read(spark, str(tmp_path)).collect(), key=lambda r: r["start"])
    want = plain(ROWS)
    assert [r["doc_id"] for r in got] == [d for d, _ in want]
    assert sorted((str(r["doc_id"]), ids(r)) for r in got) == sorted((str(d), i) for d, i in want)
    at = 0
    for r in got:
        assert r["start"] == at and r["n_tokens"] == len(ids(r))
        at += r["n_tokens"]
    # the index says where each record lies, and files ascend
    where = token_records.index(spark, str(tmp_path)).collect()
    assert sum(r["n_tokens"] for r in where) == at and len(where) == len(ROWS)
    names = [f["name"] for f in token_records.manifest(str(tmp_path))]
    assert len(names) > 1 and names == sorted(names)
    for r in where:
        with open(tmp_path / r["file"], "rb") as f:
            f.seek(r["offset"])
            assert token_records.unframed(memoryview(f.read(r["size"])), "x")[0] == r["doc_id"]


def test_files_are_read_in_parts(spark, tmp_path):
    token_records.write(docs(spark, *ROWS), str(tmp_path))
    whole = sorted(map(str, token_records.read(spark, str(tmp_path)).collect()))
    parts = spark.read.format(token_records.FORMAT).option("split", "700").load(str(tmp_path))
    assert sorted(map(str, parts.collect())) == whole
    assert parts.select(F.spark_partition_id()).distinct().count() > 10


def test_shuffled(spark, tmp_path):
    token_records.write(docs(spark, *ROWS), str(tmp_path))
    straight = [r["start"] for r in token_records.read(spark, str(tmp_path)).collect()]
    one, again, other = (token_records.shuffled(spark, str(tmp_path), s).collect() for s in (1, 1, 2))
    assert one == again and one != other and sorted(map(str, one)) == sorted(map(str, other))
    assert sorted(r["start"] for r in one) == sorted(straight) and [r["start"] for r in one] != straight


def test_append_overwrite_and_empty(spark, tmp_path):
    at = str(tmp_path / "out")
    token_records.write(docs(spark), at)
    assert token_records.read(spark, at).count() == 0 and token_records.manifest(at) == []
    token_records.write(docs(spark, (1, "one two")), at)
    token_records.write(docs(spark, (2, "three")), at, mode="append")
    got = {r["doc_id"]: r for r in token_records.read(spark, at).collect()}
    assert got[2]["start"] == got[1]["n_tokens"]
    token_records.write(docs(spark, (3, "three")), at)
    assert [r["doc_id"] for r in token_records.read(spark, at).collect()] == [3]
    assert sorted(f.split(".", 1)[1] for f in os.listdir(at) if not f.startswith(".")) == ["json", "tok", "tok.idx"]


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    at = str(tmp_path / "out")
    token_records.write(docs(spark, (1, "one")), at)
    before = sorted(os.listdir(at))
    rows = spark.range(40).repartition(4).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 33, F.raise_error(F.lit("no"))).otherwise(F.lit(b"\1\0\0\0")).cast("binary").alias("ids"))
    with pytest.raises(Exception, match="no"):
        token_records.registered(spark)
        rows.write.format(token_records.FORMAT).mode("append").save(at)
    assert [r["doc_id"] for r in token_records.read(spark, at).collect()] == [1]
    # tasks that were killed may write a last file; it is in no manifest, and a sweep takes it
    assert token_records.swept(at) == []
    time.sleep(1)
    token_records.swept(at, grace=-5)
    assert sorted(os.listdir(at)) == before


def test_a_damaged_file_is_refused(spark, tmp_path):
    token_records.write(docs(spark, (1, "one two three")), str(tmp_path))
    (file,) = [f for f in os.listdir(tmp_path) if f.endswith(".tok")]
    data = (tmp_path / file).read_bytes()
    (tmp_path / file).write_bytes(data[:-6] + bytes([data[-6] ^ 1]) + data[-5:])
    with pytest.raises(Exception, match="damaged"):
        token_records.read(spark, str(tmp_path)).collect()


def test_repeated_tasks_are_not_shown(tmp_path):
    """A second attempt of a task writes its own file; only the committed one is in the manifest."""
    w = token_records.RecordWriter(str(tmp_path), overwrite=False)
    rows = pa.RecordBatch.from_pydict({"doc_id": [4], "ids": [b"\5\0\0\0"]})

    class Context:
        partitionId = staticmethod(lambda: 3)  # noqa: N815

    import pyspark

    held, pyspark.TaskContext = pyspark.TaskContext, type("T", (), {"get": staticmethod(lambda: Context)})
    try:
        lost, done = w.write(iter([rows])), w.write(iter([rows]))
    finally:
        pyspark.TaskContext = held
    w.commit([None, done])
    assert lost.name != done.name and [f["name"] for f in token_records.manifest(str(tmp_path))] == [done.name]


def test_a_tokenizer_with_other_merges_is_read_whole(tmp_path):
    import json

    from tokenizers import Tokenizer

    with open(pack_pow2.default_tokenizer(), encoding="utf-8") as f:
        rules = json.load(f)
    assert pack_pow2.merges_follow_ids(rules["model"], {"<|startoftext|>", "<|endoftext|>"})
    for merges in (rules["model"]["merges"][:1000], rules["model"]["merges"][1:] + rules["model"]["merges"][:1]):
        made = tmp_path / f"{uuid.uuid4().hex}.json"
        made.write_text(json.dumps(rules | {"model": rules["model"] | {"merges": merges}}), encoding="utf-8")
        own = pack_pow2.WordIds(str(made))
        assert not own.by_word
        text = "Several thousand documents, packed"
        assert [np.frombuffer(b, dtype="<u4").tolist() for b in own([text])] == [Tokenizer.from_file(str(made)).encode(text, add_special_tokens=False).ids]
