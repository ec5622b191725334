"""Sharding and packing: exact laws, exact round trips."""

import zlib

import numpy as np
import pytest

from lodestrata.llm import hilbert, pack_pow2

from .helpers import SF, docs, words

ROWS = [(k, words(k, 5 + k % 90), ["en", "de", None][k % 3], f"src{k % 7}", 1) for k in range(403)] + [(None, None, None, None, None), (5, "", "en", "s", 0), (7, "again", "en", "s", 5), (7, "again", "en", "s", 5), (8, "long " * 30_000, "en", "s", 1)]


@pytest.mark.parametrize("bits", [1, 2, 3])
@pytest.mark.parametrize("n", [2, 3, 4])
def test_curve_visits_every_cell_by_steps(bits, n):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n, indexing="ij"), axis=-1).reshape(-1, n)
    at = hilbert.curve_index(grid, bits)
    assert sorted(at.tolist()) == list(range(len(grid)))
    path = grid[np.argsort(at)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_shards(spark, law):
    got = hilbert.shard(docs(spark, *ROWS), 40, law).toPandas()
    assert len(got) == len(ROWS) and set(got["law"]) == {law} and got["grown_shard"].isna().all() and got["shard"].between(0, 39).all()
    want = sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t, *_ in ROWS)
    assert sorted(zip(got["size"], got["text_crc32"], strict=True)) == want
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    if law == "rows":
        n = got.groupby("shard").size()
        assert len(n) == 40 and n.max() - n.min() <= 1
    ordered = got.sort_values(["shard", "slot"])["curve"].to_numpy()
    assert (np.diff(ordered) >= 0).all()


def test_bytes_are_near_equal(spark):
    rows = [(k, "x" * 200, "en", "s", 1) for k in range(1000)]
    got = hilbert.shard(docs(spark, *rows), 10, "bytes").toPandas().groupby("shard")["size"].sum()
    assert got.max() - got.min() <= 2 * 216


def test_few_rows_and_none(spark):
    got = hilbert.shard(docs(spark, (1, "a"), (2, "b"), (3, None))).collect()
    assert sorted(r["shard"] for r in got) == [0, 1, 2] and all(r["slot"] == 0 for r in got)
    assert hilbert.shard(docs(spark)).count() == 0 and hilbert.shard(docs(spark), law="bytes").count() == 0
    with pytest.raises(ValueError, match="law"):
        hilbert.shard(docs(spark), law="key")


def test_shards_prune(spark):
    """A shard spans few of the languages' and sources' cells."""
    rows = [(k, words(k, 30), f"l{k % 8}", f"s{k % 16}", 1) for k in range(1200)]
    df = docs(spark, *rows)
    got = hilbert.shard(df).toPandas()
    assert got.groupby("shard")["lang"].nunique().mean() < 5


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_shards_equal_a_plain_sort(spark, law):
    """Cells from exact quantiles, one sort, and runs cut by the law's definition."""
    rows = [(1000 + 7 * k, words(k, 5 + k % 60), ["de", "en", "en", "fr", None][k % 5], f"src{k % 9}", 1) for k in range(300)] + [(2**60, "far", "en", "src1", 1), (None, None, None, None, 1)]
    got = {(r["doc_id"], r["text_crc32"]): r for r in hilbert.shard(docs(spark, *rows), 7, law, bits=3).collect()}
    facts = [(d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), lang, source) for d, t, lang, source, _ in rows]

    def cells(values):
        some = sorted(v for v in values if v is not None)
        edges = [some[max(0, -(-len(some) * k // 8) - 1)] for k in range(1, 8)]
        return [0 if v is None else sum(e < v for e in edges) for v in values]

    grid = np.stack([cells([f[k] for f in facts]) for k in (1, 3, 4, 0)], axis=1)
    at = hilbert.curve_index(grid, 3)
    order = sorted(range(len(facts)), key=lambda k: (at[k], facts[k][2], facts[k][0] is None, facts[k][0] or 0, facts[k][1]))
    total, before, n, place, want = sum(f[1] for f in facts), 0, len(facts), {}, {}
    for rank, k in enumerate(order):
        if law == "rows":
            base, more = divmod(n, 7)
            shard = rank // (base + 1) if rank < more * (base + 1) else more + (rank - more * (base + 1)) // base
        else:
            shard = min(6, int((before + facts[k][1] / 2) * 7 // total))
            before += facts[k][1]
        want[facts[k][0], facts[k][2]] = (shard, place.setdefault(shard, 0), int(at[k]))
        place[shard] += 1
    assert {k: (r["shard"], r["slot"], r["curve"]) for k, r in got.items()} == want


def test_bounds_prune_by_every_dimension(spark):
    rows = [(k, words(k, 3 + k % 200), f"l{k % 8}", f"s{k % 16}", 1) for k in range(2000)]
    df = docs(spark, *rows)
    got = hilbert.assign(df).collect()
    assert sum(r["n_docs"] for r in got) == len(rows)
    read = lambda c, v: sum(r[f"min_{c}"] <= v <= r[f"max_{c}"] for r in got) / len(got)
    shares = {"lang": np.mean([read("lang", f"l{k}") for k in range(8)]), "source": np.mean([read("source", f"s{k}") for k in range(16)]), "doc_id": np.mean([read("doc_id", k) for k in range(0, 2000, 50)])}
    assert all(v < 0.75 for v in shares.values()), shares
    held = hilbert.shard(df).toPandas()
    for r in got:
        own = held[held["shard"] == r["shard"]]
        assert (r["min_lang"], r["max_lang"], r["min_source"], r["max_doc_id"]) == (own["lang"].min(), own["lang"].max(), own["source"].min(), own["doc_id"].max())


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a", 2, 3, 4)], "doc_id long, text string, curve int, at int, shard int")
    assert hilbert.shard(df).count() == 1 and pack_pow2.pack(spark.createDataFrame([(1, "a", 2, 3)], "doc_id long, text string, start int, sequence_id int")).count() == 1


def test_cuts():
    for n in range(5000):
        got = pack_pow2.cuts(n)
        assert sum(got) == n and all(c & (c - 1) == 0 and c <= 2048 for c in got) and got == sorted(got, reverse=True)
    assert pack_pow2.cuts(2048 * 2 + 5) == [2048, 2048, 4, 1]


TEXTS = ["", None, "Plain words, and more.", "ÀÉÎ ß straße ＦＵＬＬ", "don't we'll I'm it's", "a" * 500, "x<|endoftext|>y <|startoftext|>", "1234 3.14 $$$ ### a,b ,c. ... .,", "tab\tnew\r\nline nbsp sep\x1cfs", "é café 가", "日本語 テスト 😀 🇩🇪", " lead and trail ", "İstanbul ΣΑΣ Ǆ ﬁ", "a_b-c/d\\e", "퟿", "word..,, x., y.,z"]


def test_ids_are_the_tokenizers(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(pack_pow2.default_tokenizer())
    texts = TEXTS + [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    got = [np.frombuffer(b, dtype="<u4").tolist() for b in pack_pow2.WordIds(pack_pow2.default_tokenizer())([t or "" for t in texts])]
    assert got == [e.ids for e in whole.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("change", [("normalizer", "normalizers", 1, "content", "_"), ("pre_tokenizer", "pretokenizers", 1, "add_prefix_space", True), ("model", "unk_token", "x")])
def test_a_changed_tokenizer_is_not_read_by_word(tmp_path, change):
    import json

    from tokenizers import Tokenizer

    with open(pack_pow2.default_tokenizer(), encoding="utf-8") as f:
        rules = json.load(f)
    *path, last, value = change
    at = rules
    for k in path:
        at = at[k]
    at[last] = value
    made = tmp_path / "t.json"
    made.write_text(json.dumps(rules), encoding="utf-8")
    own = pack_pow2.WordIds(str(made))
    assert not own.by_word
    assert [np.frombuffer(b, dtype="<u4").tolist() for b in own(["Two words, here"])] == [Tokenizer.from_file(str(made)).encode("Two words, here", add_special_tokens=False).ids]


def test_cache_starts_anew():
    ids = pack_pow2.WordIds(pack_pow2.default_tokenizer(), cached=5)
    twice = [list(ids([words(k, 50) for k in range(6)])) for _ in range(2)]
    assert twice[0] == twice[1]


def test_other_tokenizers_see_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own = pack_pow2.WordIds(path)
    assert not own.by_word
    got = [np.frombuffer(b, dtype="<u4").tolist() for b in own(["Two  blanks and\n\nlines"])]
    assert got == [Tokenizer.from_file(path).encode("Two  blanks and\n\nlines", add_special_tokens=False).ids]


def test_round_trip(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(pack_pow2.default_tokenizer())
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(100, words(1, 9000)), (101, "twice"), (101, "twice"), (None, "no id")]
    got = pack_pow2.pack(docs(spark, *rows)).toPandas()
    assert sorted(got["sequence_id"]) == list(range(len(got))) and (got["offset"] == 0).all()
    assert (np.diff(got.sort_values("sequence_id")["length"]) <= 0).all()
    for d, text in rows:
        ids = np.asarray([*whole.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        own = (got[got["doc_id"].isna()] if d is None else got[got["doc_id"] == d]).sort_values("start")
        if d == 101:
            own = own.drop_duplicates("start")
        assert own["length"].sum() == len(ids) and (own["doc_tokens"] == len(ids)).all()
        at = 0
        for r in own.itertuples():
            assert r.start == at and zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.length & (r.length - 1) == 0
            at += r.length
    assert pack_pow2.pack(docs(spark)).count() == 0
    with pytest.raises(ValueError, match="power"):
        pack_pow2.pieces(docs(spark), longest=3)


def test_buckets(spark):
    got = pack_pow2.sequences(pack_pow2.pack(docs(spark, (1, words(1, 700))))).toPandas()
    assert (got["last_id"] - got["first_id"] + 1 == got["n_sequences"]).all()
