"""Dedup, decontamination and the Jaccard join against brute force, and their cases."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from lodestrata.llm import bayes_jaccard, decontam, line_dedup
from lodestrata.llm.components import components

from .helpers import DOCS, docs, words

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEM = "item_id long, text string"


def lowered(text):
    return WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def scanned(documents, items):
    windows = {}
    for i, text in items:
        w = lowered(text)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for d, text in documents:
        w, hit, own = lowered(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    own.update(str(i) for i in found if i is not None)
        out.append((d, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


ITEMS = [(1, words(1, 25)), (2, "three Little words"), (3, ""), (4, None), (10, words(1, 25)), (None, words(5, 12)), (5, "ÉCOLE 7")]
TEXTS = [(1, words(2, 30) + " " + words(1, 25) + " " + words(3, 9)), (2, "x three little WORDS three little words y"), (3, None), (4, ""), (5, words(5, 12)), (6, words(9, 200)), (6, words(1, 14)), (7, "ÉCOLE 7 école 7"), (None, words(1, 11)), (8, "three little"), (8, "three little")]


def test_scan_equals_brute_force(spark):
    got = decontam.scan(docs(spark, *TEXTS), spark.createDataFrame(ITEMS, ITEM))
    assert sorted([(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got.collect()], key=str) == scanned(TEXTS, ITEMS)


def test_scan_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontam, "bounded", lambda df: False)
    got = decontam.scan(docs(spark, *TEXTS), spark.createDataFrame(ITEMS, ITEM))
    assert sorted([(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got.collect()], key=str) == scanned(TEXTS, ITEMS)


def test_scan_runs_no_python(spark):
    plan = decontam.scan(docs(spark, *TEXTS), spark.createDataFrame(ITEMS, ITEM))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and "BroadcastHashJoin" in plan


def test_very_long_texts(spark):
    long = [(1, words(5, 60_000) + " " + words(1, 25) + " " + words(6, 60_000)), (2, words(5, 60_000))]
    items = [(1, words(1, 25))]
    got = decontam.scan(docs(spark, *long), spark.createDataFrame(items, ITEM))
    assert sorted([(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got.collect()], key=str) == scanned(long, items)
    joined = bayes_jaccard.join(docs(spark, *long, (3, long[0][1] + " end"))).collect()
    assert sorted((r["id"], r["class_id"], r["n_links"]) for r in joined) == joined_by_hand([*long, (3, long[0][1] + " end")])


def test_empty_tables(spark):
    none = spark.createDataFrame([], ITEM)
    assert [r["contaminated"] for r in decontam.scan(docs(spark, (1, "a b")), none).collect()] == [False]
    assert decontam.scan(docs(spark), spark.createDataFrame(ITEMS, ITEM)).count() == 0
    assert decontam.remove(docs(spark, (1, "a b")), none).count() == 1


def test_remove_documents_and_spans(spark):
    rows = [(1, "Keep, three little words! and this.", 1), (2, "clean text", 2), (3, None, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    items = spark.createDataFrame([(1, "three little words")], ITEM)
    whole = decontam.remove(df, items)
    assert sorted(r["doc_id"] for r in whole.collect()) == [2, 3] and whole.columns == df.columns
    assert not re.search("Python|Pandas|Arrow|SortMergeJoin", whole._jdf.queryExecution().executedPlan().toString())
    cut = decontam.remove(df, items, whole=False)
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == {1: "Keep, and this.", 2: "clean text", 3: None} and cut.columns == df.columns


# -- dedup ---------------------------------------------------------------------------------------------------------------------


def cut(spark, *rows, **more):
    got = line_dedup.dedup(docs(spark, *rows), spans="spans", **more)
    return {r["doc_id"]: r for r in got.collect()}


def word_hash(word):
    import numpy as np

    points = line_dedup.code_points(word)
    return int(line_dedup.hashed(points, np.array([0]), np.array([len(points)]))[0])


def plain_units(text):
    """start, end, words, counts, normalised, begins, finishes of each unit, word by word."""
    out, at = [], 0
    for line in text.split("\n"):
        found = []
        for m in re.finditer(r"\S+", line):
            w = m.group().strip(line_dedup.MARKS).lower()
            if w:
                raw = m.group().lower()
                found.append([m.start() + at, m.end() + at, w, any(c in ".!?" for c in raw[raw.rindex(w) + len(w) :])])
            elif found:
                found[-1][1] = m.end() + at
        at += len(line) + 1
        keys = [(not e, word_hash(w) >> 1) for _, _, w, e in found]
        groups, held, run = [], [], 0
        for k, x in enumerate(found):
            held.append(x)
            run = run + 1 if k and found[k - 1][2] == x[2] else 0
            first = all(keys[k] < y for y in keys[max(0, k - 5) : k]) and all(keys[k] <= y for y in keys[k + 1 : k + 6])
            if first or (run and run % 8 == 7) or k == len(found) - 1:
                groups.append(held)
                held = []
        if len(groups) > 1 and len(groups[0]) < 6:
            groups[:2] = [groups[0] + groups[1]]
        if len(groups) > 1 and len(groups[-1]) < 6:
            groups[-2:] = [groups[-2] + groups[-1]]
        out += [(g[0][0], g[-1][1], len(g), len(g) >= 6 or (len(groups) == 1 and len(g) >= 3), " ".join(x[2] for x in g), k == 0, k == len(groups) - 1) for k, g in enumerate(groups)]
    return out


def by_hand(rows, least_run=13):
    """Texts after dedup, from the definition: units in rank order, the first of each stays."""
    seen, out = {}, {}
    for d, text in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[0] is None, r[0])):
        left, runs, last = text, [], False
        for s, e, n, counts, u, begins, finishes in plain_units(text):
            goes = counts and u in seen
            if counts:
                seen.setdefault(u, d)
            if goes and last:
                runs[-1] = (runs[-1][0], e, runs[-1][2] + n, runs[-1][3], finishes)
            elif goes:
                runs.append((s, e, n, begins, finishes))
            last = goes
        for s, e in [r[:2] for r in reversed(runs) if r[2] >= least_run or (r[3] and r[4])]:
            end = e
            while end < len(text) and text[end].isspace():
                end += 1
            left = left[:s] + left[end:] if end < len(text) else left[:s].rstrip()
        out[d] = left
    return out


@pytest.mark.parametrize("least_run", [13, 1])
def test_dedup_equals_brute_force(spark, least_run):
    """With a run of 1 every repeated unit goes."""
    passage = words(11, 80)
    rows = [(k, words(20 + k, 60) + " " + passage + " " + words(50 + k, 40) + "\n" + words(7, 20) + ".\nshort line") for k in range(12)] + [(99, words(20, 60)), (100, "")]
    rows += [(200 + k, words(800 + k, 30) + " " + words(12, 9) + ". " + words(830 + k, 30)) for k in range(6)]
    got = cut(spark, *rows, least_run=least_run)
    assert {d: r["text"] for d, r in got.items()} == by_hand(rows, least_run)
    assert got[0]["spans"] == [] and all(len(got[k]["spans"]) >= 1 for k in range(1, 12))


def test_units_are_the_plain_ones():
    texts = [words(k, 120) + ".\n\n" + words(k + 1, 7) + "! End\n| a | b-c, |\nÀ É ß x y z. w " + words(k + 2, 30) + " *** " for k in range(12)] + ["", None, "...", "one", " a b\nc d e ", "ha " * 61 + "ho " * 30, "so so so"]
    u = line_dedup.units(texts)
    for t, text in enumerate(texts):
        own = u.text == t
        got = list(zip(u.start[own].tolist(), u.end[own].tolist(), u.words[own].tolist(), u.counts[own].tolist(), strict=True))
        assert got == [x[:4] for x in plain_units(text or "")], t
    same = {}
    for t, k, a, b in zip(u.text, u.number, u.d1, u.d2, strict=True):
        same.setdefault((int(a), int(b)), set()).add(plain_units(texts[t])[k][4])
    assert all(len(v) == 1 for v in same.values())


def test_passages_copied_anywhere_are_gone(spark):
    passage = words(3, 120)
    rows = [(k, words(100 + k, 35 + k) + " " + passage + " " + words(200 + k, 30)) for k in range(9)]
    seen = set()
    for d, r in sorted(cut(spark, *rows).items()):
        w = r["text"].split()
        own = {tuple(w[k : k + 50]) for k in range(len(w) - 49)}
        assert not own & seen, d
        seen |= own


def laid_out(seed, n, sizes):
    """n words in lines of the sizes, in turn."""
    import itertools

    w, out, turn = words(seed, n).split(), [], itertools.cycle(sizes)
    while w:
        k = next(turn)
        out.append(" ".join(w[:k]))
        w = w[k:]
    return "\n".join(out)


@pytest.mark.parametrize("sizes", [[1], [2], [2, 1, 1], [2, 3], [1, 1, 7], [1, 12, 2, 2]])
def test_passages_of_short_lines_are_gone(spark, sizes):
    passage = laid_out(31, 140, sizes)
    rows = [(k, words(600 + k, 40) + "\n" + passage + "\n" + words(700 + k, 40)) for k in range(4)]
    rows += [(50 + k, laid_out(800 + k, 30, [2, 1]) + "\n" + passage + "\n" + laid_out(900 + k, 30, [1])) for k in range(4)]
    copied = passage.split()
    own = {tuple(copied[k : k + 30]) for k in range(len(copied) - 29)}
    got = cut(spark, *rows)
    assert got[0]["text"] == rows[0][1]
    for d in (k for k in got if k):
        w = got[d]["text"].split()
        assert not own & {tuple(w[k : k + 30]) for k in range(len(w) - 29)}, d
        # all but the passage's ends is gone, and what stands around it stays
        before, after = dict(rows)[d].split(passage)
        assert got[d]["text"].startswith(before.strip()) and got[d]["text"].endswith(after.strip()) and len(w) < len((before + after).split()) + 45, d


def test_repeats_of_short_lines_inside_a_text_are_gone(spark):
    passage = laid_out(32, 60, [2, 1])
    got = cut(spark, (1, passage + "\n" + words(61, 40) + "\n" + passage + "\n" + words(62, 40)))
    assert len(got[1]["spans"]) == 1 and len(got[1]["text"].split()) < 60 + 80 + 12


@pytest.mark.parametrize("turn", ["Was eran.\n", "Onon\n", "One two\nthree\n", "a b ", "a a b ", "a b a c d "])
def test_lines_that_recur_in_turn_are_gone(spark, turn):
    got = cut(spark, (1, words(63, 40) + "\n" + turn * 60 + "\n" + words(64, 40)), (2, words(65, 40) + "\n" + turn * 60 + "\n" + words(66, 40)))
    assert all(r["spans"] and len(r["text"].split()) < 80 + 45 for r in got.values())


def test_lone_short_lines_stay(spark):
    lone = ["The end.", "Home\nAbout us\nContact", "| a | b |"]
    rows = [(k, words(640 + k, 30) + "\n" + lone[k % 3] + "\n" + words(660 + k, 30)) for k in range(12)]
    rows += [(100, "\n".join(words(640 + k, 30).split()[0] for k in range(12)))]
    assert {d: r["text"] for d, r in cut(spark, *rows).items()} == dict(rows)
    line = "one line that recurs in all"
    beside = [(k, f"{line}\nHome\nAbout us\nContact it\n{words(680 + k, 30)}") for k in range(3)]
    assert line not in cut(spark, *beside)[2]["text"]


def test_offsets_are_of_the_original(spark):
    line = "a line that comes more than once, with enough words"
    rows = [(1, f"first text\n{line}\nend one"), (2, f"other ünïcode text\n{line}\nend two")]
    got = cut(spark, *rows)
    (span,) = got[2]["spans"]
    assert rows[1][1][span["start"] : span["end"]] == line and got[2]["text"] == "other ünïcode text\nend two" and got[1]["text"] == rows[0][1]


def test_clean_texts_stay(spark):
    rows = [(k, words(1000 + k, 150)) for k in range(40)]
    assert {d: r["text"] for d, r in cut(spark, *rows).items()} == dict(rows)


def test_dedup_cases(spark):
    text = "one line that is long enough to count here"
    rows = [(None, text), (1, text), (1, text), (2, None), (3, ""), (4, " \n\t "), (5, text + "\n" + text), (6, "Of\n" + text + "\nIs. At."), (7, "x y " * 50_000)]
    got = line_dedup.dedup(docs(spark, *rows), spans="spans").collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r["text"])
    assert by[1] == [text, text] and by[None] == [""] and by[2] == [None] and by[3] == [""] and by[4] == [" \n\t "] and by[5] == [""] and by[6] == ["Of\nIs. At."]
    assert line_dedup.dedup(docs(spark)).count() == 0
    odd = docs(spark, (1, text, "a", "b", 1), (2, text, "a", "b", 1), columns="doc_id long, text string, unit string, digest string, gone int")
    assert line_dedup.dedup(odd).columns == odd.columns and sorted(r["text"] for r in line_dedup.dedup(odd).collect()) == ["", text]


# -- Jaccard join --------------------------------------------------------------------------------------------------------------


def shingles(text):
    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def joined_by_hand(rows, threshold=0.8):
    sets = [shingles(t) for _, t in rows]
    up, links = list(range(len(rows))), [0] * len(rows)

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and both >= threshold * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for k, (d, _) in enumerate(rows):
        least[top(k)] = min(d, least.get(top(k), d))
    return sorted((d, least[top(k)], links[k]) for k, (d, _) in enumerate(rows))


def edited(text, seed, n):
    import random

    r = random.Random(seed)
    w = text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"edit{r.randrange(1000)}"
    return " ".join(w)


def corpus():
    rows = [(k, words(300 + k, 60 + k)) for k in range(20)]
    for b in range(4):
        rows += [(100 + 40 * b + k, edited(words(b, 150), 7 * b + k, k % 6)) for k in range(30)]
    return rows + [(900, words(0, 150)), (901, words(0, 150)), (902, "one two three"), (903, "One, two three!"), (904, "one two four"), (905, ""), (906, " . "), (907, "a b c d e")]


@pytest.mark.parametrize(("chunk", "broadcast"), [((256, 2048), True), ((4, 8), True), ((4, 8), False)])
def test_join_equals_brute_force(spark, monkeypatch, chunk, broadcast):
    if not broadcast:
        monkeypatch.setattr(bayes_jaccard, "bounded", lambda df: False)
    rows = corpus()
    got = bayes_jaccard.join(docs(spark, *rows), chunk=chunk)
    assert sorted((r["id"], r["class_id"], r["n_links"]) for r in got.collect()) == joined_by_hand(rows)


def test_many_survivors_are_counted_exactly(spark):
    rows = [(k, edited(words(1, 200), k, 2)) for k in range(60)]
    got = bayes_jaccard.join(docs(spark, *rows))
    assert sorted((r["id"], r["class_id"], r["n_links"]) for r in got.collect()) == joined_by_hand(rows)


def test_only_pairs_of_a_bucket_are_compared():
    """A pair is judged once, in the first band that it shares, and pairs that share none are not judged."""
    import pyarrow as pa

    sets = bayes_jaccard.shingle_sets([edited(words(k % 3, 150), k, k % 5) for k in range(40)])
    sig = bayes_jaccard.signatures(sets)
    bands = sig.view("uint64")
    rows = sorted((int(bands[k, b]) % (1 << 62), b, k) for k in range(40) for b in range(32))
    n = len(rows)
    zeros = pa.array([0] * n, pa.int32())
    t = pa.table({
        "key": pa.array([r[0] for r in rows], pa.int64()), "i": zeros, "j": zeros, "side": zeros, "band": pa.array([r[1] for r in rows], pa.int32()),
        "node": pa.array([r[2] for r in rows], pa.int64()), "n": pa.array([len(sets[r[2]]) for r in rows], pa.int64()), "signature": pa.array([sig[r[2]].tobytes() for r in rows], pa.binary()),
    })
    cells = bayes_jaccard.Cells(t)
    judged = sorted(tuple(sorted((rows[x][2], rows[y][2]))) for a, b in cells.pairs(0.8, [(16, 0)]) for x, y in zip(a, b, strict=True))
    near = lambda x, y: min(len(sets[x]), len(sets[y])) >= 0.8 * max(len(sets[x]), len(sets[y])) - 1e-9
    assert judged == [(x, y) for x in range(40) for y in range(x + 1, 40) if near(x, y) and (bands[x] == bands[y]).any()]


def test_rows_that_share_an_id_but_no_text(spark):
    rows = [(1, words(1, 60)), (5, words(1, 60) + " end"), (5, words(9, 60)), (5, words(8, 70)), (6, words(8, 70)), (6, "other words stand here alone")]
    got = bayes_jaccard.join(docs(spark, *rows)).collect()
    assert sorted((r["id"], r["class_id"], r["n_links"]) for r in got) == sorted([(1, 1, 1), (5, 1, 1), (5, 5, 0), (5, 5, 1), (6, 5, 1), (6, 6, 0)])
    kept = bayes_jaccard.keep_one(docs(spark, *rows)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == sorted([rows[0], rows[2], rows[3], rows[5]])


def test_join_cases(spark):
    rows = [(1, "same text of some words"), (1, "same text of some words"), (2, None), (3, ""), (None, "same text of some words"), (None, None)]
    got = bayes_jaccard.join(docs(spark, *rows)).collect()
    links = sorted(r["n_links"] for r in got)
    assert len(got) == 6 and links == [0, 0, 0, 2, 2, 2] and bayes_jaccard.join(docs(spark)).count() == 0


def test_keep_one(spark):
    rows = [(5, words(1, 40), "x", 1), (3, words(1, 40), "y", 2), (3, words(1, 40), "y", 2), (9, words(2, 40), "z", 3), (10, None, "n", 4), (11, None, "m", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, rep string, class_id int")
    got = bayes_jaccard.keep_one(df)
    assert sorted(r["doc_id"] for r in got.collect()) == [3, 9, 10, 11] and got.columns == df.columns


def test_pruning_bound_is_the_posterior():
    from math import comb

    for n, m in bayes_jaccard.least_matches(0.8, 1e-7):
        tail = lambda k: sum(comb(n + 1, j) * 0.8**j * 0.2 ** (n + 1 - j) for j in range(k + 1))  # noqa: E731, B023
        assert tail(m) >= 1e-7 and (m == 0 or tail(m - 1) < 1e-7)


def test_minhash_estimates_similarity():
    import numpy as np

    a, b = np.arange(0, 900, dtype=np.uint64), np.arange(100, 1000, dtype=np.uint64)
    mixed = [bayes_jaccard.mix64(x) for x in (a, b)]
    sig = bayes_jaccard.signatures([np.sort(m) for m in mixed])
    assert abs((sig[0] == sig[1]).mean() - 0.8) < 0.12


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (103, 102), (102, 100)] + [(200, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(1, 41)} | {101: 100, 102: 100, 103: 100}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
    with pytest.raises(RuntimeError, match="rounds"):
        components(spark.createDataFrame(edges, "u long, v long"), most=1)


def test_documents_schema(spark):
    assert docs(spark, (1, "a")).where(F.col("text") == "a").count() == 1 and "doc_id" in DOCS
