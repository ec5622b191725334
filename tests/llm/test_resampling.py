"""Importance resampling: the ring against whole features, the query's numbers against a plain reading of their definition."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm import resampling

from .helpers import docs, words


def features(text, n=2):
    ws = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return ws, [" ".join(ws[k : k + m]) for m in range(1, n + 1) for k in range(len(ws) - m + 1)]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB9 é-İ\n日", max_size=60), st.integers(1, 4))
def test_ring_equals_whole_features(text, n):
    ws, fs = features(text, n)
    got = list(resampling.checksums(text.encode(), n))
    assert sum(w for w, _ in got) == len(ws)
    assert Counter(c for _, part in got for c in part) == Counter(zlib.crc32(f.encode()) for f in fs)


def test_long_texts_come_in_parts(monkeypatch):
    monkeypatch.setattr(resampling, "PART", 10)
    text = words(3, 500)
    got = list(resampling.checksums(text.encode()))
    assert len(got) > 50 and max(len(p) for _, p in got) < 13
    assert Counter(c for _, p in got for c in p) == Counter(zlib.crc32(f.encode()) for f in features(text)[1])


def brute(rows, target, percent=25, least=20, buckets=10_000, seed=7):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(bucket(f) for _, x in rows for f in features(x)[1]), Counter(bucket(f) for x in target for f in features(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    out = []
    for d, x in rows:
        ws, fs = features(x)
        weight = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        score = None
        if d is not None:
            h = int(hashlib.sha256(f"{seed}:{d}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([d, len(fs), weight, score, None, len(ws)])
    own = sorted((r for r in out if r[5] >= least and r[0] is not None), key=lambda r: (-r[3], r[0], r[1], r[2]))
    for k, r in enumerate(own[: len(own) * percent // 100]):
        r[4] = k + 1
    return sorted(map(str, (tuple(r[:5]) for r in out)))


def test_equals_brute_force(spark):
    rows = [(k, words(k, 3 + k % 80)) for k in range(160)] + [(7, "again"), (7, "again"), (200, None), (None, words(1, 40)), (201, ""), (202, "... --"), (203, "Ünï ÀB " * 40), (204, words(5, 20_000)), (-9, words(6, 30))]
    target = [words(900 + k, 30, size=60) for k in range(20)] + [None, ""]
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, rank int, bucket int")
    got = resampling.resample(df, spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string"))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(rows, target)


@pytest.mark.parametrize("percent", [0, 50, 100])
def test_share_drawn(spark, percent):
    rows = [(k, words(k, 25)) for k in range(41)]
    got = resampling.resample(docs(spark, *rows), docs(spark, (1, words(2, 30))), percent=percent).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 41 * percent // 100 + 1))


def test_target_like_texts_are_drawn_more(spark):
    near = {k for k in range(0, 400, 4)}
    rows = [(k, words(k, 60, size=25 if k in near else 400)) for k in range(400)]
    got = resampling.resample(docs(spark, *rows), docs(spark, *[(k, words(5000 + k, 60, size=25)) for k in range(30)])).collect()
    drawn = {r["doc_id"] for r in got if r["rank"]}
    assert len(drawn) == 100 and len(drawn & near) > 40  # a quarter of all are near the target; the noise is as wide as the mean gains


def test_empty(spark):
    assert resampling.resample(docs(spark), docs(spark, (1, "a"))).count() == 0
    got = resampling.resample(docs(spark, (1, words(1, 30)), (2, words(2, 30)), (3, words(3, 30)), (4, words(4, 30))), docs(spark)).collect()
    assert len(got) == 4 and sum(r["rank"] is not None for r in got) == 1
