import numpy as np
import pytest

from lodestrata.llm import topk_mih

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(vectors, every, k, bits):
    code = {i: np.pad(np.asarray(v, float) > 0, (0, bits - len(v))) for i, v in vectors}
    out = []
    for q in sorted(i for i in code if i % every == 0):
        near = sorted((int((code[q] != code[i]).sum()), i) for i in code if i != q)[:k]
        out += [(q, n + 1, i, d) for n, (d, i) in enumerate(near)]
    return sorted(out)


def found(df):
    return sorted((r["query_id"], r["rank"], r["neighbor_id"], r["distance"]) for r in df.collect())


@pytest.mark.parametrize(("n", "bits", "k"), [(300, 16, 10), (500, 64, 5), (40, 24, 60)])
def test_equals_brute_force(spark, n, bits, k):
    r = np.random.default_rng(n)
    base = r.normal(size=(7, bits))
    rows = [(i, (base[i % 7] + r.normal(size=bits)).tolist()) for i in range(n)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    assert found(topk_mih.nearest(df, "vec_id", "embedding", 10, k)) == brute(rows, 10, k, bits)


def test_blocks_and_bounds(spark, monkeypatch):
    monkeypatch.setattr(topk_mih, "ROWS_A_BLOCK", 50)
    monkeypatch.setattr(topk_mih, "SEEN", 400)
    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=32).tolist()) for i in range(400)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    assert found(topk_mih.nearest(df, "vec_id", "embedding", 9, 6)) == brute(rows, 9, 6, 32)


def test_one_vector_holds_most_rows(spark):
    rows = [(i, [1.0] * 16) for i in range(200)] + [(1000 + i, [-1.0] * i + [1.0] * (16 - i)) for i in range(10)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    assert found(topk_mih.nearest(df, "vec_id", "embedding", 50, 4)) == brute(rows, 50, 4, 16)


def test_nulls_repeats_and_lengths(spark):
    rows = [(0, [1.0, -1.0]), (0, [1.0, -1.0]), (1, None), (None, [1.0]), (2, [1.0, float("nan"), 1.0]), (3, [])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    got = found(topk_mih.nearest(df, "vec_id", "embedding", 50, 10))
    assert got == [(0, 1, 2, 1), (0, 2, 3, 1)]


def test_empty_and_other_columns(spark):
    assert topk_mih.nearest(spark.createDataFrame([], SCHEMA), "vec_id", "embedding").count() == 0
    df = spark.createDataFrame([(0, [1.0], "c", 1), (1, [1.0], "d", 2)], "vec_id long, embedding array<double>, code string, id int")
    assert found(topk_mih.nearest(df, "vec_id", "embedding")) == [(0, 1, 1, 0)]


def test_rows_travel_once_and_queries_to_every_block(spark):
    rows = spark.range(500).selectExpr("id", "cast(cast(id as string) as binary) as code", "id % 9 as block")
    asked = spark.range(60).selectExpr("id", "cast('q' as binary) as code", "16 as bound").crossJoin(spark.range(9).withColumnRenamed("id", "block"))
    got = topk_mih.dealt(rows, asked, 9)
    assert got.where("asked = 0").count() == 500 and got.where("asked = 1").count() == 60 * 9


@pytest.mark.parametrize("n", [50, 400, 3000])
def test_no_candidate_is_verified_twice(n):
    r = np.random.default_rng(n)
    code = np.packbits(r.integers(0, 2, (n, 64), dtype=np.uint8), axis=1)
    index = topk_mih.Index(code, np.arange(n))
    q, i, d = index.search(code[:20], np.arange(20), np.full(20, 64), 10)
    assert len(q) == 200 and index.verified <= 20 * n
    every = np.bitwise_count(code[:20, None] ^ code[None]).sum(axis=2)
    assert all(sorted(d[q == k]) == sorted(np.delete(every[k], k))[:10] for k in range(20))


def test_very_many_rows_of_one_block_stream_through(spark, monkeypatch):
    """Batches cut blocks and queries anywhere."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        monkeypatch.setattr(topk_mih, "ROWS_A_BLOCK", 90)
        r = np.random.default_rng(9)
        rows = [(i, r.normal(size=16).tolist()) for i in range(300)]
        df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
        assert found(topk_mih.nearest(df, "vec_id", "embedding", 3, 4)) == brute(rows, 3, 4, 16)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
