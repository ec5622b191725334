"""Language, quality and toxicity: accuracy on rows that were not learned from, and the cases of each operator."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import langid_cnn, pu_quality, toxicity
from lodestrata.llm.common import table
from lodestrata.llm.learning import fit_logistic, logistic, remainder

from .helpers import docs, words

SF = "/root/testdata/sf0.01"
ODD = [(None, "text without an id"), (1, None), (2, ""), (3, "1234 !!! 56"), (4, "\n \t"), (5, "x" * 300_000), (6, "same text here"), (6, "same text here")]


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n


@pytest.fixture(scope="module")
def tables(spark):
    return table(spark, SF, "documents"), table(spark, SF, "labels")


def test_remainder_is_crc(spark):
    got = spark.createDataFrame([(7,), (123456,), (None,)], "doc_id long").select("doc_id", remainder("doc_id", 3).alias("r")).collect()
    assert [r["r"] for r in got] == [crc(7, 3), crc(123456, 3), zlib.crc32(b"") % 3]


def test_samples_are_full_and_what_is_sorted_is_bounded(spark):
    from lodestrata.llm.learning import cutoff, share, some_of

    for n, of in [(5, 40_000), (100, 40_000), (3, 10), (50, 40)]:
        df = spark.range(of).withColumnRenamed("id", "doc_id")
        got = [r[0] for r in some_of(df, "doc_id", n, of).collect()]
        every = [r[0] for r in df.orderBy(share("doc_id"), "doc_id").limit(n).collect()]
        assert sorted(got) == sorted(every) and df.where(share("doc_id") < cutoff(n, of)).count() <= max(4 * n + 64, 3 * n + 100)


def test_language(spark, tables):
    d, _ = tables
    network = langid_cnn.train(d)
    assert network.languages == ["de", "en", "es", "fr"]
    got = {r["doc_id"]: r for r in langid_cnn.predict(d, network).collect()}
    truth = {r["doc_id"]: r["lang"] for r in d.select("doc_id", "lang").collect()}
    own = [i for i in truth if crc(i, 3) == 1]
    assert np.mean([got[i]["lang_pred"] == truth[i] for i in own]) > 0.97
    odd = langid_cnn.predict(docs(spark, *ODD), network).collect()
    assert len(odd) == len(ODD) and {r["lang_pred"] for r in odd if r["doc_id"] in (1, 2, 3, 4)} == {"und"} and all(0 <= r["score"] <= 1 for r in odd)
    assert len({(r["lang_pred"], r["score"]) for r in odd if r["doc_id"] == 6}) == 1
    assert langid_cnn.predict(docs(spark), network).count() == 0


def test_tables_are_the_convolution():
    r = np.random.default_rng(1)
    network = langid_cnn.Network(["a", "b"], r.normal(size=(256, 8)), {w: r.normal(size=(w, 8, 16)) for w in (2, 3, 4)}, {w: r.normal(size=16) for w in (2, 3, 4)}, r.normal(size=(48, 2)), r.normal(size=2))
    x = r.integers(1, 256, (3, 40)).astype(np.uint8)
    want = []
    for w in (2, 3, 4):
        z = sum(network.embedding[x][:, j : j + 40 - w + 1] @ network.filters[w][j] for j in range(w)) + network.biases[w]
        want.append(np.maximum(z.max(axis=1), 0))
    assert network.pooled(x, network.tables()) == pytest.approx(np.hstack(want), abs=1e-4)


def test_windows_see_every_place():
    for n in (0, 1, 3, 10, 384, 385, 1000):
        data = bytes(np.random.default_rng(n).integers(1, 256, n).astype(np.uint8))
        got = langid_cnn.windows_of(data)
        grams = {bytes(w[k : k + 4]) for w in got for k in range(len(w) - 3)}
        assert {data[k : k + 4] for k in range(n - 3)} <= grams


def test_language_without_labels(spark):
    network = langid_cnn.train(docs(spark, (1, "some text"), (2, None)))
    assert [r["lang_pred"] for r in langid_cnn.predict(docs(spark, (1, "abc")), network).collect()] == ["und"]


def test_quality(spark, tables):
    d, labels = tables
    model = pu_quality.train(d, labels)
    got = {r["doc_id"]: r for r in pu_quality.score(d, model).collect()}
    own = [(r["doc_id"], r["quality"]) for r in labels.collect() if crc(r["doc_id"], 5) == 0]
    assert np.mean([got[i]["predicted"] == y for i, y in own]) > 0.95
    odd = pu_quality.score(docs(spark, *ODD), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r["score"] <= 1 for r in odd)
    assert len({r["score"] for r in odd if r["doc_id"] in (1, 2)}) == 1 and pu_quality.score(docs(spark), model).count() == 0


def test_risk_is_kept_from_going_negative():
    r = np.random.default_rng(2)
    positive = r.normal(2, 1, (200, 3))
    unlabelled = np.vstack([r.normal(2, 1, (140, 3)), r.normal(-2, 1, (60, 3))])
    model = pu_quality.fit(positive, unlabelled, 0.7)
    assert model(r.normal(2, 1, (100, 3))).mean() > 0.85 and model(r.normal(-2, 1, (100, 3))).mean() < 0.2


@pytest.mark.parametrize("prior", [0.2, 0.5, 0.85])
def test_the_prior_is_estimated_without_negatives(prior):
    r = np.random.default_rng(int(prior * 100))
    positive = r.normal(1.5, 1, (2000, 4))
    n = int(4000 * prior)
    unlabelled = np.vstack([r.normal(1.5, 1, (n, 4)), r.normal(-1.5, 1, (4000 - n, 4))])
    assert pu_quality.estimated_prior(positive, r.permutation(unlabelled)) == pytest.approx(prior, abs=0.05)


def test_labels_of_zero_change_nothing(spark):
    """Positive-unlabelled: negatives are not read."""
    rows = [(k, f"Some words, in order. And {k} more of them here." if k % 2 else f"### $$$ {k} ### @@@ x x x x") for k in range(80)]
    label = lambda zeros: spark.createDataFrame([(k, 1, 0) for k in range(1, 80, 4)] + [(k, 0, 0) for k in zeros], "doc_id long, quality int, toxic int")
    a, b = (pu_quality.train(docs(spark, *rows), label(z)) for z in ([], range(0, 80, 2)))
    assert a.prior == b.prior and a.weights == pytest.approx(b.weights)


def test_quality_without_positives(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = pu_quality.train(docs(spark, (1, "a b c")), none)
    assert [r["score"] for r in pu_quality.score(docs(spark, (1, "x"), (2, None)), model).collect()] == [0.5, 0.5]


def test_toxicity(spark, tables):
    d, labels = tables
    model = toxicity.train(d, labels)
    got = {r["doc_id"]: r for r in toxicity.score(d, model).collect()}
    own = [(r["doc_id"], r["toxic"]) for r in labels.collect() if crc(r["doc_id"], 3) == 1]
    assert np.mean([got[i]["predicted"] == y for i, y in own]) > 0.93
    odd = toxicity.score(docs(spark, *ODD), model).collect()
    assert len(odd) == len(ODD) and len({r["score"] for r in odd}) == 1 and not any(r["predicted"] for r in odd)
    kept = toxicity.clean(docs(spark, (1, "you stupid worthless idiot and loser, what a pathetic moron"), (2, "a quiet day"), (3, None)), model)
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3] and kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert toxicity.score(docs(spark), model).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


def by_distance(w, entries):
    """(edits, entry) of every entry that a word matches."""
    want = []
    for n, e in enumerate(entries):
        own = e.rstrip("!$~")
        most = int(len(own) >= 5 and not e.endswith("!$") and e[-1] in "$~")
        d = distance(w, own) if e.endswith("$") else min(distance(w[:k], own) for k in range(len(w) + 1))
        if d <= most:
            want.append((d, n))
    return want


def test_automaton_is_the_edit_distance():
    entries = ["idiot$", "moron$", "scum$", "vequ", "lostra~", "trash!$"]
    m = toxicity.Matcher(entries)
    r = np.random.default_rng(5)
    trial = ["idiot", "idot", "idiiot", "idxot", "idiots", "moron", "mron", "scum", "scam", "vequ", "vequaire", "veq", "lostrarum", "lustra", "diot", "iidiot", "lustrarum", "lotrarum", "xlostrarum", "lostr", "lost", "trash", "trasch"]
    trial += ["".join(r.choice(list("idotmrnscuvelqa"), r.integers(1, 9))) for _ in range(3000)]
    points, starts, ends, _ = toxicity.split_words(trial)
    word, entry, edits = m(points, starts, ends)
    got = {int(w): (int(e), int(d)) for w, e, d in zip(word, entry, edits, strict=True)}
    for k, w in enumerate(trial):
        want = by_distance(w, entries)
        assert (k in got) == bool(want), w
        if want:
            assert got[k][1] == min(want)[0]


def test_quotation_is_told_from_abuse():
    m = toxicity.Matcher(["idiot$"])
    _, spans = toxicity.features(['He said "you idiot" to me', "you idiot", 'she wrote: idiot', "“what an idiot” was the headline"], m)
    assert [s[0][4] for s in spans] == [True, False, True, True]
    assert spans[1][0][:2] == (4, 9)


def test_stems_are_learned(spark):
    rows = [(k, f"plain words here grobel{e} and more of it", 1) for k, e in enumerate(["an", "ent", "ix", "ung", "os", "er", "ia", "um"] * 3)]
    rows += [(100 + k, "plain words here and more of it gruben", 0) for k in range(40)]
    got = toxicity.learn_entries(spark.createDataFrame(rows, "id long, text string, y int"))
    assert "grobel" in got and "plain$" not in got


def test_whole_terms_keep_their_edit_beside_stems(spark):
    forms = ["idiot grobel"] * 30 + ["idiots grobels", "idioot groobel"] * 3
    rows = [(k, f"plain words here {f} and more of it", 1) for k, f in enumerate(forms)]
    rows += [(100 + k, "plain words here and more of it", 0) for k in range(60)]
    got = toxicity.learn_entries(spark.createDataFrame(rows, "id long, text string, y int"))
    assert "idio" in got and {"idiot$", "grobel$"} | {t + "$" for t in toxicity.TERMS} <= set(got) and len(got) == len(set(got))
    misspelled = "iddiot ydiot diot 1diot grobbel krobel robel"
    _, (spans,) = toxicity.features([misspelled], toxicity.Matcher(got))
    assert [misspelled[s:e] for s, e, *_ in spans] == misspelled.split() and {d for _, _, _, d, _ in spans} == {1}
    # the bound on entries is not used up by what a stem covers
    few = toxicity.learn_entries(spark.createDataFrame(rows, "id long, text string, y int"), entries=2)
    assert {"idio", "idiot$", "grobel$"} <= set(few) and len(few) <= len(got)


def test_what_edits_open(spark):
    """A stem whose misspelled forms clean texts have stays closed, and an ordinary word near a term is no match."""
    rows = [(k, f"gorbelan idiot nulperix words {k}", 1) for k in range(30)]
    rows += [(100 + k, f"plain words here {'gorblin' if k % 4 == 0 else ''} {'idiom' if k % 9 == 0 else ''} {k}", 0) for k in range(120)]
    sample = spark.createDataFrame(rows, "id long, text string, y int")
    got, ordinary = toxicity.opened(sample, ["gorbel", "nulper", "idiot$", "abc"])
    assert got == ["gorbel", "nulper~", "idiot$", "abc"] and ordinary == {"idiom"}
    m = toxicity.Matcher(got, ordinary)
    text = "gorblin idiom idot nulpperix nolperus gorbelix"
    _, (spans,) = toxicity.features([text], m)
    assert [text[s:e] for s, e, *_ in spans] == ["idot", "nulpperix", "nolperus", "gorbelix"]


def test_terms_with_busy_neighbours_are_closed(spark):
    rows = [(k, "ratingo here", 1) for k in range(30)] + [(100 + k, f"ratin{'abcdefghijklm'[k % 13]} {k}", 0) for k in range(13)] + [(200 + k, "clean", 0) for k in range(200)]
    assert toxicity.opened(spark.createDataFrame(rows, "id long, text string, y int"), ["ratingo$", "ratino$"])[0] == ["ratingo$", "ratino!$"]


def plain_features(text, entries, ordinary):
    """toxicity.FEATURES from their definition."""
    low = text.lower() if len(text.lower()) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    found = [(m.start(), m.end()) for m in re.finditer(r"[^\W_]+", low)]
    hits = []
    for k, (s, e) in enumerate(found):
        want = by_distance(low[s:e], entries)
        if want and (min(want)[0] == 0 or low[s:e] not in ordinary):
            hits.append((k, min(want)[0]))
    plain = fuzzy = quoted = nearest = 0
    for k, d in hits:
        s, e = found[k]
        before = text[found[k - 13][1] if k > 12 else 0 : s]
        after = text[e : found[k + 13][0] if k + 13 < len(found) else len(text)]
        marks = "\"“”„«»"
        told = sum(c in marks for c in before) % 2 == 1 and any(c in marks for c in after)
        told = told or any(w.strip(".,:;'" + marks) in toxicity.REPORTS for w in before.lower().split()[-3:])
        nearest = max(nearest, sum(abs(j - k) <= 12 for j, _ in hits))
        plain, fuzzy, quoted = plain + (not told and d == 0), fuzzy + (not told and d > 0), quoted + told
    total = plain + fuzzy
    dense = min(3.0, np.log1p(1000 * total / max(1, len(found))) / 2 + (nearest - 1) / 12) if total else 0.0
    return [float(total > 0), float(total >= 2), np.log1p(total), np.log1p(fuzzy), dense, np.log1p(quoted)]


def test_toxicity_equals_brute_force(spark):
    """The query's scores from matching every word with every entry by edit distance."""
    d, labels = table(spark, "/root/testdata/sf0.001", "documents"), table(spark, "/root/testdata/sf0.001", "labels")
    model = toxicity.train(d, labels)
    texts = {r["doc_id"]: r["text"] for r in d.collect() if len(r["text"] or "") < 3000}
    extra = {-1: 'He said "you idot, you moron" and left', -2: "stupit " * 30 + "clown", -3: "ÜBER idiot_moron x" + "y " * 40, -4: None}
    texts |= extra
    got = {r["doc_id"]: r for r in toxicity.score(docs(spark, *texts.items()), model).collect()}
    for i, t in texts.items():
        want = logistic(np.asarray([plain_features(t or "", model.entries, model.ordinary)]), model.weights)[0]
        assert got[i]["score"] == pytest.approx(want, abs=1e-9), i
        assert got[i]["predicted"] == int(want >= 0.7)


def test_misspelled_abuse_is_caught_by_the_automaton(spark):
    """Held-out toxic texts whose terms are all misspelled: caught with edits, missed without them."""
    d, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = toxicity.train(d, labels)
    assert (model.weights[: toxicity.EVIDENCE] >= 0).all()
    texts = {r["doc_id"]: r["text"] for r in d.collect()}
    own = [r["doc_id"] for r in labels.collect() if r["toxic"] and crc(r["doc_id"], 3) == 1]
    wrong, r = [], np.random.default_rng(1)
    for i in own:
        t = texts[i]
        _, (spans,) = toxicity.features([t], model.matcher())
        for s, e, *_ in reversed([x for x in spans if x[1] - x[0] >= 5]):
            t = t[:s] + toxicity.misspelled(t[s:e], r) + t[e:]
        if spans:
            wrong.append(t)
    score = lambda m: logistic(toxicity.features(wrong, m)[0], model.weights)
    with_edits, without = score(model.matcher()), score(toxicity.Matcher(model.entries, model.ordinary, edits=False))
    assert len(wrong) >= 10 and (with_edits >= 0.7).mean() > 0.9 and (without >= 0.7).mean() < 0.4


def test_quotation_moves_the_label(spark, tables):
    model = toxicity.train(*tables)
    rows = [(1, "you idiot and moron, stupid and worthless " + "plain words " * 10), (2, 'he said "you idiot and moron, stupid and worthless" ' + "plain words " * 10), (3, "you iddiot and moorn, stupiid and worthles " + "plain words " * 10)]
    assert {r["doc_id"]: r["predicted"] for r in toxicity.score(docs(spark, *rows), model).collect()} == {1: 1, 2: 0, 3: 1}


def test_labels_that_repeat_or_contradict(spark):
    rows = [(k, f"you idiot and moron, number {k}" if k % 2 else f"a quiet day, number {k}") for k in range(60)]
    labels = [(k, k % 2, k % 2) for k in range(60)] * 2 + [(k, 0, 0) for k in range(60)]
    made = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.score(docs(spark, *rows), toxicity.train(docs(spark, *rows), made)).collect()
    assert all(r["predicted"] == r["doc_id"] % 2 for r in got)
    assert all(0 <= r["score"] <= 1 for r in pu_quality.score(docs(spark, *rows), pu_quality.train(docs(spark, *rows), made)).collect())


def test_clashing_columns(spark):
    odd = spark.createDataFrame([(1, "some text", 5, "x", 2.0, [1.0])], "doc_id long, text string, y int, lang_pred string, score double, x array<double>").withColumn("lang", F.lit("en"))
    labels = spark.createDataFrame([(1, 1, 0, "text", 3)], "doc_id long, quality int, toxic int, text string, y int")
    assert langid_cnn.predict(odd, langid_cnn.train(odd)).count() == 1
    assert pu_quality.score(odd, pu_quality.train(odd, labels)).columns == ["doc_id", "score", "predicted"]
    model = toxicity.train(odd, labels)
    assert toxicity.score(odd, model).count() == 1 and toxicity.clean(odd, model).columns == odd.columns


def test_language_equals_brute_force(spark):
    """The query's answer from the convolution itself, window by window."""
    r = np.random.default_rng(4)
    network = langid_cnn.Network(["a", "b", "c"], r.normal(size=(256, 8)).astype(np.float32), {w: r.normal(size=(w, 8, 16)).astype(np.float32) for w in (2, 3, 4)}, {w: r.normal(size=16).astype(np.float32) for w in (2, 3, 4)}, (r.normal(size=(48, 3)) / 5).astype(np.float32), np.zeros(3, np.float32))
    length = langid_cnn.LENGTH
    texts = {k: words(k, 5 + 30 * k) for k in range(9)} | {20: "É", 21: "x" * 381, 22: "ab" * 500}
    got = {x["doc_id"]: x for x in langid_cnn.predict(docs(spark, *texts.items()), network).collect()}
    for i, t in texts.items():
        data = t.lower().encode()
        total, at = np.zeros(3), 0
        while True:
            part = np.zeros(length, dtype=np.int64)
            own = data[at : at + length]
            part[: len(own)] = list(own)
            h = []
            for w in (2, 3, 4):
                z = np.stack([sum(network.embedding[part[k + j]] @ network.filters[w][j] for j in range(w)) + network.biases[w] for k in range(length - w + 1)])
                h.append(np.maximum(z.max(axis=0), 0))
            z = np.concatenate(h) @ network.dense + network.offset
            total += np.exp(z - z.max()) / np.exp(z - z.max()).sum() * len(own)
            at += length - 3
            if at + 3 >= len(data):
                break
        total /= total.sum()
        assert got[i]["score"] == pytest.approx(total.max(), abs=1e-3) and (got[i]["lang_pred"] == "abc"[total.argmax()] or np.sort(total)[-1] - np.sort(total)[-2] < 1e-3), i


def plain_form(text):
    """pu_quality.FEATURES from their definition."""
    raw = (text or "").encode()
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in raw)
    found = re.findall(rb"[0-9a-z\x80-\xff]+", low)
    lines = [x for x in low.split(b"\n") if x]
    n, chars = len(found), len(raw)
    char = lambda f: sum(map(f, raw)) / (chars + 40)
    before = lambda xs: len(xs) - len(set(xs))
    pairs = list(zip(found[:-1], found[1:], strict=True))
    out = [
        min(np.log1p(n) / 8, 1.5), char(lambda b: 65 <= b <= 90) * 4, char(lambda b: 48 <= b <= 57) * 4, char(lambda b: b in b"#$%&*@^~_=+<>\\/") * 4, char(lambda b: b == 124) * 8, char(lambda b: b == 33) * 8,
        char(lambda b: b in b".,") * 8, char(lambda b: b == 32) * 2, (raw + b"\n").count(b"\n") / (chars + 40) * 8, sum(map(len, found)) / (n + 10) / 8, sum(len(w) > 16 for w in found) / (n + 10) * 2,
        sum(a == b for a, b in pairs) / (n + 10) * 4, before(pairs) / (n + 20) * 2, before(lines) / (len(lines) + 3) * 2, before(found) / (n + 30), sum(not (97 <= b <= 122 or b >= 128) and r > 32 for b, r in zip(low, raw, strict=True)) / (chars + 40) * 2,
    ]
    return np.minimum(out, 4.0)


def test_quality_equals_brute_force(spark):
    r = np.random.default_rng(6)
    model = pu_quality.Model(r.normal(size=16) / 9, 0.5 + r.random(16), r.normal(size=17), 0.5)
    texts = {k: words(k, 3 + 40 * k) for k in range(6)} | {10: None, 11: "", 12: "A B\n\nA b a b\n###%% | !!", 13: "ÄÖ ß 12 <p>\\"}
    got = {x["doc_id"]: x for x in pu_quality.score(docs(spark, *texts.items()), model).collect()}
    for i, t in texts.items():
        z = np.clip((plain_form(t) - model.mean) / model.scale, -8, 8)
        want = 1 / (1 + np.exp(-np.clip(z @ model.weights[:-1] + model.weights[-1], -30, 30)))
        assert got[i]["score"] == pytest.approx(want, abs=1e-9) and got[i]["predicted"] == int(want >= 0.3), i


def test_a_term_and_a_stem_may_be_the_same():
    for entries in (["idiot", "idiot$"], ["idiot$", "idiot"], ["idio", "idiot$"]):
        m = toxicity.Matcher(entries)
        trial = ["idiot", "idiots", "iddiot", "ydiot", "diot", "idiotic", "quiet"]
        _, starts, ends, _ = toxicity.split_words(trial)
        word, _, edits = m(toxicity.split_words(trial)[0], starts, ends)
        assert dict(zip(word.tolist(), edits.tolist(), strict=True)) == {0: 0, 1: 0, 2: 1, 3: 1, 4: 1, 5: 0}


def test_logistic_regression():
    r = np.random.default_rng(0)
    x = r.normal(size=(500, 2))
    y = (x[:, 0] + 0.1 * r.normal(size=500) > 0).astype(int)
    assert ((logistic(x, fit_logistic(x, y, np.ones(500))) > 0.5) == y).mean() > 0.95
