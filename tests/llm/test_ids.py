"""A long that no 64-bit float holds stays exact beside a null, in every operator that goes through Python."""

import pytest

from lodestrata.llm import bayes_jaccard, decontam, hilbert, html_crf, langid_cnn, line_dedup, pack_pow2, pu_quality, topk_mih, toxicity

from .helpers import docs

IDS = [2**60 + 12345, None, 7, 2**53 + 1]
TEXTS = [(i, f"some text of number {k} with a few words in it") for k, i in enumerate(IDS)]


def _learned(spark, op):
    d = docs(spark, *TEXTS).coalesce(1)
    if op == "op3":
        return langid_cnn.predict(d, langid_cnn.train(d))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    if op == "op6":
        return pu_quality.score(d, pu_quality.train(d, labels))
    return toxicity.score(d, toxicity.train(d, labels))


@pytest.mark.parametrize("op", ["op2", "op3", "op4", "op5", "op6", "op8", "op9", "op10", "clean", "keep_one"])
def test_ids_stay(spark, op):
    d = docs(spark, *TEXTS).coalesce(1)
    key = "doc_id"
    if op == "op2":
        got, key = html_crf.extract(d.selectExpr("doc_id as page_id", "source as url", "concat('<p>', text) as html")), "page_id"
    elif op == "op4":
        got = line_dedup.dedup(d)
    elif op == "op5":
        got = decontam.scan(d, spark.createDataFrame([("a", "some text of")], "item_id string, text string"))
    elif op == "op9":
        got = hilbert.shard(d)
    elif op == "op10":
        got = pack_pow2.pack(d).select("doc_id", "doc_tokens").distinct()
    elif op == "clean":
        got = toxicity.clean(d, toxicity.train(d, spark.createDataFrame([], "doc_id long, quality int, toxic int")))
    elif op == "keep_one":
        got = bayes_jaccard.keep_one(d)
    else:
        got = _learned(spark, op)
    assert sorted(str(r[key]) for r in got.collect()) == sorted(map(str, IDS))


def test_vector_ids_stay(spark):
    rows = spark.createDataFrame([(i, [float(k), -1.0, 1.0]) for k, i in enumerate(IDS)], "vec_id long, embedding array<float>").coalesce(1)
    got = topk_mih.nearest(rows, "vec_id", "embedding", every=1).collect()
    assert {r["query_id"] for r in got} == {r["neighbor_id"] for r in got} == {i for i in IDS if i is not None}


def test_operators_leave_the_session_as_it_is(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    _learned(spark, "op8").collect()
    line_dedup.dedup(docs(spark, *TEXTS)).collect()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
