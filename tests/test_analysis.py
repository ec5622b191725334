import math

import pytest

from lodestrata.functions import analysis

#: Words and stems of the published vocabulary.
PAIRS = "consign consign|consigned consign|consigning consign|consignment consign|consistency consist|consolation consol|knightly knight|knives knive|knocked knock|generous generous|generate generat|happy happi|happiness happi|skies sky|dying die|ties tie|gas gas|this this|running run|hopping hop|hoping hope|fill fill|rolling roll|relational relat|conditional condit|sensibilities sensibl|nationality nation|cry cri|by by|say say|inning inning|proceed proceed|agreed agre|feed feed|plastered plaster|motoring motor|controll control"


@pytest.mark.parametrize("pair", PAIRS.split("|"))
def test_stems(pair):
    word, stem = pair.split()
    assert analysis.stem(word) == stem


def test_stems_in_sql():
    """Bases with every suffix of the definition, and two of them: the SQL of the oracle, written apart from the stemmer, gives the same."""
    import duckdb

    from lodestrata.plans import english_sql

    ends = ["", "s", "es", "ies", "ied", "us", "ss", "sses", "eed", "eedly", "ed", "edly", "ing", "ingly", "y", "e", "ll", "l", "ogi", "logy", "ly", "'s", "'", *english_sql.STEP2, *english_sql.STEP3, *english_sql.STEP4, "ative", "ion"]
    bases = "a y by say hop hope fill feed gener commun arsen cat troubl siz yellow abey rhythm bead cry agr nation sens out inn skis bl ab controll".split()
    words = sorted({b + x for b in bases for x in ends} | {b + x + z for b in bases[5:] for x in ends[12:] for z in ("s", "ly", "ing", "ness", "ity")} | {w for w in [*english_sql.EXCEPTIONS, *english_sql.KEPT]})
    duck = duckdb.connect()
    duck.execute("CREATE TABLE asked AS SELECT unnest(?::VARCHAR[]) AS word", [words])
    got = dict(duck.execute(f"WITH {english_sql.stems('asked')} SELECT word, stem FROM stems").fetchall())
    assert len(got) == len(words) > 5000 and {w: s for w, s in got.items() if s != analysis.stem(w)} == {}


def test_positions_count_stop_words():
    assert analysis.english("The cats and the dog") == {"cat": [2], "dog": [5]}


def test_rank_of_one_lexeme():
    v = analysis.english("cat dog cat")
    assert analysis.rank(v, ["cat"]) == pytest.approx((0.1 + 0.1 / 4) / 1.64493406685)
    assert analysis.rank(v, ["bird"]) == 0 and analysis.rank(v, []) == 0


def test_rank_of_two_lexemes():
    near = 1 / (1.005 + 0.05 * math.exp(1 / 1.5 - 2))
    assert analysis.rank({"a": [1], "b": [2]}, ["a", "b"]) == pytest.approx(math.sqrt(0.01 * near))
    assert analysis.rank({"a": [1], "b": [2]}, ["a", "b"]) > analysis.rank({"a": [1], "b": [40]}, ["a", "b"])


def test_english_search_by_brute_force(spark):
    from lodestrata.operators import acl, search
    from lodestrata.plans import driver_tables as dt

    sf = "/root/testdata/sf0.001"
    asked = dt.asked(spark, sf)
    chunks = dt.chunks(spark, sf).toPandas()
    got = {(r["qid"], r["chunk_id"]): r["lexical_score"] for r in search.english_matches(asked, acl.allowed(asked), search.english_terms(dt.chunks(spark, sf))).collect()}
    want = {}
    for q in asked.collect():
        terms = sorted(analysis.english(q["question"]))
        for c in chunks.itertuples():
            v = analysis.english(c.content)
            if terms and c.department in q["departments"] and all(t in v for t in terms):
                want[(q["qid"], c.chunk_id)] = analysis.rank(v, terms)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_vectors_are_made_in_arrow_without_objects_a_row():
    import pyarrow as pa

    texts = ["The cats and the dog, cats", None, "the", "dog"]
    made = analysis.vectors(pa.array(texts, pa.string()))
    assert made.to_pylist() == [[{"term": k, "positions": v} for k, v in sorted(analysis.english(t).items())] for t in texts]
    assert analysis.vectors(pa.array([], pa.string())).to_pylist() == []


def test_lexemes_held_are_bounded(monkeypatch):
    monkeypatch.setattr(analysis._Lexemes, "MOST", 3)
    held = analysis._Lexemes()
    assert [held[w] for w in ("cats", "the", "dogs", "runs", "cats")] == ["cat", None, "dog", "run", "cat"] and len(held) <= 3


def test_nearness_of_many_places_is_that_of_each_pair():
    a, b = list(range(1, 400, 7)), list(range(3, 900, 5))
    want = 1.0
    for p in a:
        for q in b:
            d = abs(p - q)
            if d:
                want *= 1 - math.sqrt(0.01 * (1e-30 if d > 100 else 1 / (1.005 + 0.05 * math.exp(d / 1.5 - 2))))
    assert analysis.nearness(a, b) == pytest.approx(want, rel=1e-9, abs=1e-300)
    assert analysis.nearness([1, 2], [2, 300]) == pytest.approx((1 - math.sqrt(0.01 / (1.005 + 0.05 * math.exp(1 / 1.5 - 2)))) * 1.0)


def test_texts_ranked_in_place_are_those_of_an_index(spark):
    from lodestrata.operators import search
    from lodestrata.plans import catalogue as cat
    from lodestrata.plans import driver_tables as dt

    sf = "/root/testdata/sf0.001"
    turns = cat.read(spark, sf, "conversations").selectExpr("conv_id * 1000 + turn AS qid", "substring_index(text, ' ', 3) AS question")
    turns = turns.unionByName(turns.selectExpr("-qid - 1 AS qid", "question"))  # asked twice
    allow = turns.selectExpr("qid", "explode(CASE WHEN qid % 3 = 0 THEN array('finance', 'hr', 'finance') ELSE array('engineering', 'legal', 'sales') END) AS department").distinct()
    chunks = dt.chunks(spark, sf)
    rows = lambda df: sorted((r["qid"], r["lexical_rank"], r["chunk_id"], r["department"], r["lexical_score"]) for r in df.collect())
    want = rows(search.lexical_ranked(search.english_matches(turns, allow, search.english_terms(chunks)), 3))
    assert len(want) > 50 and rows(search.english_ranked(turns, allow, chunks, 3)) == want
    # in turns
    assert rows(search.english_ranked(turns, allow, chunks, 3, limit=20_000)) == want


def test_a_task_cuts_each_ask_to_its_best():
    from lodestrata.operators.search import _Best

    best = _Best(2)
    best.chunks = [("b", "x"), ("a", "x"), ("c", "x")]
    best.asks, best.scores, best.at = [1, 1, 1, 2], [0.5, 0.5, 0.7, 0.1], [0, 1, 2, 0]
    assert [x.tolist() for x in best.cut()] == [[1, 1, 2], [0.7, 0.5, 0.1], [2, 1, 0]]
    assert best.asks == [1, 1, 2]


def test_terms_carry_other_columns_without_a_join(spark):
    from lodestrata.operators import search

    chunks = spark.createDataFrame([("c1", "d", "cats and dogs", 5), ("c2", "e", None, 6)], "chunk_id string, department string, content string, bucket int")
    made = search.english_terms(chunks, "bucket")
    assert sorted((r["chunk_id"], r["term"], r["bucket"]) for r in made.collect()) == [("c1", "cat", 5), ("c1", "dog", 5)]
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_hashed_words_are_remembered():
    from lodestrata.functions import providers

    texts = ["a b a", None, "b"]
    assert providers.hashed_words(texts, 8) == providers.hashed_words(texts, 8)
    assert providers._hashed.cache_info().hits > 0


def _asks(*queries, least=None):
    import numpy as np
    import pyarrow as pa

    from lodestrata.operators.asks import Asks

    made = Asks.from_arrow(pa.array(range(10, 10 + len(queries))), pa.array([sorted(q) for q in queries], pa.list_(pa.string())), pa.array([0] * len(queries)), [["x"]])
    if least:
        made.least = np.array(least)
    return made


@pytest.mark.parametrize("held", [1, 40, 1_000_000])
def test_joined_arrays_rank_as_each_text_by_itself(held, monkeypatch):
    import random

    from lodestrata.operators import asks

    draw = random.Random(held)
    words = "cat dog bird fish horse mouse sheep goat the".split()
    texts = [" ".join(draw.choices(words, weights=[9, 7, 5, 3, 2, 1, 1, 1, 4], k=draw.choice([0, 1, 3, 12, 60, 400]))) for _ in range(150)] + [None, "?", "the"]
    queries = [["cat"], ["goat"], ["none"], ["cat", "dog"], ["bird", "mous"], ["goat", "sheep"], ["cat", "none"], ["cat", "dog", "fish"], ["bird", "goat", "hors", "mous"]]
    monkeypatch.setattr(asks, "JOINED", 7)
    monkeypatch.setattr(asks, "PLACES", 50)
    monkeypatch.setattr(asks, "TEXTS", 11)
    ranker = asks.Ranker(_asks(*queries), 4, held)
    ids = [f"c{draw.random()}" for _ in texts]
    for at in range(0, len(texts), 40):
        ranker.add(ids[at : at + 40], ["x" if k % 9 else "y" for k in range(at, min(at + 40, len(texts)))], iter(texts[at : at + 40]))
    found = list(zip(*(x.tolist() for x in ranker.ranked()), strict=True))
    for k, q in enumerate(queries):
        own = [(analysis.english(t), i) for n, (t, i) in enumerate(zip(texts, ids, strict=True)) if n % 9]
        want = sorted((-round(analysis.rank(v, sorted(q)), 9), i) for v, i in own if all(t in v for t in q))[:4]
        assert [(-s, ranker.best.chunks[at][0]) for ask, s, at in found if ask == 10 + k] == [(pytest.approx(s, abs=1e-12), i) for s, i in want]


def test_texts_that_cannot_be_among_the_best_are_not_ranked(monkeypatch):
    from lodestrata.operators import asks

    ranked = []
    plain = asks.Ranker._near
    monkeypatch.setattr(asks.Ranker, "_near", lambda self, found: ranked.append(len(found[0])) or plain(self, found))
    near = analysis.rank({"cat": [1], "dog": [2]}, ["cat", "dog"])
    for least, n in ((-1.0, 3), (round(near, 9), 3), (0.2, 1)):
        ranked.clear()
        ranker = asks.Ranker(_asks(["cat", "dog"], least=[least]), 2)
        ranker.add(["a", "b", "c", "d"], ["x"] * 4, iter(["cat dog", "dog and cat", "cat dog cat dog cat dog", "dog"]))
        assert sum(ranked) == n
    assert [ranker.best.chunks[at][0] for at in ranker.ranked()[2]] == ["c"]


def test_least_scores_of_long_texts_change_no_result(spark):
    from lodestrata.operators import search
    from lodestrata.plans import catalogue as cat
    from lodestrata.plans import driver_tables as dt

    sf = "/root/testdata/sf0.01"
    turns = cat.read(spark, sf, "conversations").selectExpr("conv_id * 1000 + turn AS qid", "substring_index(text, ' ', 2) AS question")
    allow = turns.selectExpr("qid", "explode(array('finance', 'engineering', 'legal', 'sales', 'hr')) AS department")
    chunks = dt.chunks(spark, sf)
    rows = lambda df: sorted((r["qid"], r["lexical_rank"], r["chunk_id"], r["department"], r["lexical_score"]) for r in df.collect())
    told, plain = [], search._asked_rows

    def counted(texts, asks, k, held, ranks=None):
        told.append((bool(ranks), int((asks.value.least >= 0).sum())))
        return plain(texts, asks, k, held, ranks)

    search._asked_rows = counted
    try:
        got = rows(search.english_ranked(turns, allow, chunks, 2, held=500, without_least=0))
    finally:
        search._asked_rows = plain
    assert told[0] == (True, 0) and not told[1][0] and told[1][1] > 50
    assert len(got) > 500 and got == rows(search.lexical_ranked(search.english_matches(turns, allow, search.english_terms(chunks)), 2))


def test_words_of_a_batch_are_those_of_each_text():
    import random

    import pyarrow as pa

    draw = random.Random(3)
    texts = [None, "", "'", "don't 'tis a'b'c d'", "İstanbul's café K", "the\x00x _y-z"] + ["".join(draw.choice("ab1Z' é\n_.") for _ in range(draw.randrange(30))) for _ in range(500)]
    numbers, sizes, names = analysis.words(texts)
    ends = sizes.cumsum()
    assert [[names[k] for k in numbers[e - n : e]] for e, n in zip(ends, sizes, strict=True)] == [analysis._WORD.findall((t or "").lower()) for t in texts]
    sliced = pa.array(["zz", *[(t or "").lower() if t is not None else None for t in texts]], pa.string()).slice(1)
    numbers, sizes, names = analysis.runs(sliced)
    ends = sizes.cumsum()
    assert [[names[k] for k in numbers[e - n : e]] for e, n in zip(ends, sizes, strict=True)] == [[w for w in "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in (t or "").lower()).split(" ") if w] for t in texts]
