"""The transactional sink and the stream of pieces: once, whole, in order, after failures too."""

import glob
import os
import time

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import providers
from lodestrata.sources import pieces, schemas, sink
from lodestrata.sources.store import Store


def errors(spark, *keys):
    return spark.createDataFrame([(str(k), f"p{k}") for k in keys], "run_id string, source_path string")


def ids(store):
    return sorted(r["run_id"] for r in store.read("ingestion_errors").collect())


def files(tmp_path):
    return glob.glob(f"{tmp_path}/ingestion_errors/*/*.parquet")


def test_columns(spark):
    for t in schemas.DDL:
        assert schemas.columns(t) == schemas.schema(t).fieldNames()


def test_batches_and_the_store_see_each_other(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    s.append("ingestion_errors", errors(spark, 1))
    sink.write(errors(spark, 2, 3).repartition(3), str(tmp_path), "ingestion_errors")
    s.append("ingestion_errors", errors(spark, 4))
    assert ids(s) == ["1", "2", "3", "4"] and s.version() == 3 and [r["operation"].split()[0] for r in s.history().orderBy("version").collect()] == ["append", "sink", "append"]
    assert s.read("ingestion_errors", version=1).count() == 1
    s.commit({"ingestion_runs": spark.createDataFrame([(str(k), "succeeded") for k in range(5)], "id string, status string")})
    s.compact("ingestion_errors")
    assert ids(s) == ["1", "2", "3", "4"] and len(s.snapshot()["ingestion_errors"]) == 1
    s.vacuum(keep=1, grace=-5)
    assert ids(s) == ["1", "2", "3", "4"]


def test_a_repeated_batch_leaves_no_double_rows(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    for batch in (0, 0, 1, 0):
        sink.write(errors(spark, batch), str(tmp_path), "ingestion_errors", "app", batch)
    sink.write(errors(spark, 7), str(tmp_path), "ingestion_errors", "another", 0)
    s.append("ingestion_errors", errors(spark, 1), done=("app", 1))  # the store knows the sink's batches
    assert ids(s) == ["0", "1", "7"] and len(files(tmp_path)) == 3  # the files of repeated batches are gone


def test_a_failed_batch_leaves_nothing(spark, tmp_path):
    rows = spark.range(40).repartition(4).select(F.when(F.col("id") == 33, F.raise_error(F.lit("no"))).otherwise(F.col("id").cast("string")).alias("run_id"))
    with pytest.raises(Exception, match="no"):
        sink.write(rows, str(tmp_path), "ingestion_errors", "app", 0)
    # a task that was killed may write a last file: no manifest names it, and vacuum takes it
    assert Store(spark, str(tmp_path)).version() == 0 and Store(spark, str(tmp_path)).read("ingestion_errors").count() == 0
    time.sleep(1)
    Store(spark, str(tmp_path)).vacuum(grace=-5)
    assert files(tmp_path) == []
    sink.write(errors(spark, *range(40)), str(tmp_path), "ingestion_errors", "app", 0)
    assert Store(spark, str(tmp_path)).read("ingestion_errors").count() == 40
    with pytest.raises(Exception, match="append"):
        sink.shaped(errors(spark, 1), "ingestion_errors").write.format(sink.FORMAT).mode("overwrite").option("table", "ingestion_errors").save(str(tmp_path))
    with pytest.raises(Exception, match="takes the columns"):
        errors(spark, 1).write.format(sink.FORMAT).mode("append").option("table", "ingestion_errors").save(str(tmp_path))


def test_vacuum_takes_files_of_no_manifest(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    sink.write(errors(spark, 1).coalesce(1), str(tmp_path), "ingestion_errors")
    (folder,) = glob.glob(f"{tmp_path}/ingestion_errors/v=*")
    open(f"{folder}/part-lost.parquet", "wb").close()
    assert [os.path.basename(g) for g in s.vacuum(keep=1, grace=-5)] == ["part-lost.parquet"] and ids(s) == ["1"]


def test_a_stream_is_entered_once(spark, tmp_path):
    store, waiting, cp = str(tmp_path / "store"), str(tmp_path / "in"), tmp_path / "cp"

    def run():
        rows = spark.readStream.schema("run_id string, source_path string").parquet(waiting)
        sink.stream(rows, store, "ingestion_errors", "errors", str(cp)).trigger(availableNow=True).start().awaitTermination()

    errors(spark, 1, 2).write.parquet(waiting)
    run()
    errors(spark, 3).write.mode("append").parquet(waiting)
    run()
    assert ids(Store(spark, store)) == ["1", "2", "3"]
    # as if the driver had died between the sink's commit and the stream's own: the batch comes again
    last = max(int(f) for f in os.listdir(cp / "commits") if f.isdigit())
    for f in (f"{last}", f".{last}.crc"):
        (cp / "commits" / f).unlink(missing_ok=True)
    run()
    assert ids(Store(spark, store)) == ["1", "2", "3"]
    with pytest.raises(Exception, match="option app"):
        rows = sink.shaped(spark.readStream.schema("run_id string, source_path string").parquet(waiting), "ingestion_errors")
        rows.writeStream.format(sink.FORMAT).option("path", store).option("table", "ingestion_errors").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start().awaitTermination()


def prompt(*firsts):
    return "".join(f'<excerpt number="{k}" source="s">\n{t}\nmore\n</excerpt>\n\n' for k, t in enumerate(firsts, 1))


@pytest.mark.parametrize("step", [1, 2, 3, 5, 100])
def test_pieces_come_once_and_end(step):
    for text in (prompt("one two three", "four"), prompt("one"), ""):
        whole, got, ends = providers.offline_answer(text), [], []
        for start in range(0, 40, step):
            for place, piece, last in pieces.between(providers.offline_pieces, text, start, start + step):
                ends += [place] * last
                got += [] if last else [(place, piece)]
        assert "".join(p for _, p in got) == whole and [p for p, _ in got] == list(range(len(got))) and ends == [len(got)]


def test_stream_of_pieces_joins_to_the_answers(spark, tmp_path):
    rows = [("a", prompt("one two three four five", "six seven")), ("b", prompt("x")), ("c", "nothing asked"), ("d", None)]
    spark.createDataFrame(rows, "qid string, prompt string").repartition(2).write.parquet(f"{tmp_path}/prompts")
    got = pieces.told(spark, f"{tmp_path}/prompts", "lodestrata.functions.providers:offline_pieces", f"{tmp_path}/out", f"{tmp_path}/cp", step=3)
    by = {r["qid"]: r for r in pieces.joined(got).collect()}
    assert {q: r["answer"] for q, r in by.items()} == {q: providers.offline_answer(p) for q, p in rows if p is not None}
    # the first piece was there before the last one was asked for
    at = {(r["qid"], r["place"]): r["batch"] for r in got.collect()}
    assert at["a", 0] < at["a", by["a"]["n_pieces"] - 1]
