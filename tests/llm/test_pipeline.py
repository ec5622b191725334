"""The whole pipeline against a brute-force version on a small corpus, and the stages' contract."""

import zlib

import numpy as np
import pytest

import corpus_pipeline

from .helpers import words
from .test_texts import by_hand, edited, joined_by_hand, scanned

ABUSE = "you stupid worthless idiot, a pathetic loser and a moron, such scum"


def tables(spark, folder):
    """Documents with toxic ones, near copies, a passage that several share, and leaks; labels; a benchmark."""
    items = [(k, words(900 + k, 30)) for k in range(4)]
    passage = words(77, 90)
    rows = [(k, words(k, 80 + k)) for k in range(40)]
    rows += [(100 + k, f"{words(100 + k, 60)} {ABUSE} {words(200 + k, 20)}") for k in range(30)]
    rows += [(300 + k, edited(words(5, 85), k, 1)) for k in range(12)] + [(320, words(5, 85))]
    rows += [(400 + k, f"{words(400 + k, 50)} {passage} {words(500 + k, 45)}") for k in range(6)]
    rows += [(600 + k, f"{words(600 + k, 40)} {items[k][1]} {words(700 + k, 30)}") for k in range(4)]
    rows += [(800, ""), (801, None), (802, "one"), (803, words(3, 83))]
    labels = [(d, 1, int(100 <= d < 130)) for d, _ in rows if d < 130]
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, items


def by_brute_force(rows, items):
    from tokenizers import Tokenizer

    from lodestrata.llm.pack_pow2 import default_tokenizer

    rows = [(d, t) for d, t in rows if ABUSE not in (t or "")]
    one = {c: d for d, c, _ in joined_by_hand(rows) if d == c}
    rows = [(d, t) for d, t in rows if d in one]
    left = by_hand(rows) | {d: None for d, t in rows if t is None}
    rows = sorted((d, left[d]) for d, _ in rows)
    leaky = {d for d, *_, hit in scanned(rows, items) if hit}
    out = []
    whole = Tokenizer.from_file(default_tokenizer())
    for d, t in rows:
        if d in leaky:
            continue
        ids = np.asarray([*whole.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        at = 0
        while at < len(ids):
            n = 2048
            while n > len(ids) - at:
                n //= 2
            out.append((d, at, n, zlib.crc32(ids[at : at + n].tobytes()), len(ids)))
            at += n
    return sorted(out)


def test_run_equals_brute_force(spark, tmp_path):
    rows, items = tables(spark, tmp_path)
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got.collect()) == by_brute_force(rows, items)


def test_stages_keep_the_columns(spark, tmp_path):
    tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names, stages = zip(*corpus_pipeline.STAGES, strict=True)
    assert names == ("toxicity", "near_copies", "substring_dedup", "decontamination", "packing")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes), name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    cut = corpus_pipeline.repeats_out(spark, docs, str(tmp_path))
    assert cut.where("n_chars <> length(text)").count() == 0 and cut.count() == docs.count()
    assert stages[-1](spark, docs.limit(0), str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", ["op1_multi_index_topk", "op5_decontamination"])
def test_queries_against_sql(spark, name):
    import duckdb

    from lodestrata.llm import queries

    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = queries.queries()[name](spark, sf).toPandas()
    want = c.execute(queries.oracle_sql()[name]).df()[list(got.columns)]
    assert sorted(map(tuple, got.astype(str).to_numpy())) == sorted(map(tuple, want.astype(str).to_numpy()))


def test_every_query_returns_its_contract(spark):
    from lodestrata.llm import queries

    sf = "/root/testdata/sf0.001"
    n = {t: spark.read.parquet(f"{sf}/{t}.parquet").count() for t in ("documents", "pages")}
    want = {
        "op2": ({"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"}, "pages"), "op3": ({"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"}, "documents"), "op4": ({"doc_id": "bigint"}, "documents"),
        "op5": ({"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"}, "documents"),
        "op6": ({"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}, "documents"), "op7": ({"doc_id": "bigint", "class_id": "bigint", "n_links": "bigint"}, "documents"),
        "op8": ({"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}, "documents"),
        "op9": ({"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}, "documents"),
        "op10": ({"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"}, None),
    }
    found = queries.queries()
    assert sorted(int(k[2:].split("_")[0]) for k in found) == list(range(1, 11))
    for name, f in found.items():
        columns, table = want.get(name.split("_")[0], ({}, None))
        got = f(spark, sf)
        assert columns.items() <= dict(got.dtypes).items(), name
        if table:
            assert got.count() == n[table], name
