"""Target-distribution importance resampling over hashed runs of words, by a streaming CRC ring.

One scan of a text keeps the running CRC-32 states of the last n starts: each new word extends every state in the ring by a space
and the word, opens a state of its own, and the oldest start falls out. Every state is the checksum of one run of 1 to n words, so no
run is ever built as a string; its bucket is the checksum modulo the number of buckets. Buckets are counted in every task before they
are shuffled (at most one row a bucket and task), over the whole corpus and over the whole target. What the second scan needs is one
gain a bucket (10,000 numbers, whatever the data's size), floor(1000 * ln of the smoothed ratio of both shares); a document's weight is
the floored mean of the gains of its runs. Documents are drawn without replacement by the Gumbel top-k rule: a weight plus noise that
comes from the document's id, the highest first. Only narrow rows are sorted, by range.

Words are runs of digits, letters a-z (A-Z is lowered, nothing else is) and characters beyond ASCII.

Cases: null and empty texts have no features and weight 0, and are never drawn while the least number of words is above 0; a null
doc_id has no noise, so its score and rank are null and it isn't among those drawn from; rows that repeat a doc_id are each a document,
of those with one score and id the one with fewer features ranks first, and equal rows are interchangeable; an empty target or corpus
leaves the smoothed shares; an empty table gives no rows; other columns are not read, whatever their names. A very long text is
scanned word by word; its buckets are worked off in parts, so they take no more memory than the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import cut, fresh, ranked, slices
from lodestrata.llm.decontam import BETWEEN, LOWER, UPPER
from lodestrata.session import found_by_workers

BUCKETS, RUN, LEAST_WORDS, PERCENT, SEED = 10_000, 2, 20, 25, 7
#: Buckets that a scan hands over at once.
PART = 1 << 18
#: The words of a text in UTF-8, once A-Z is lowered: no byte of a character beyond ASCII is below 0x80.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def checksums(text: bytes, n: int = RUN) -> Iterator[tuple[int, list[int]]]:
    """The ring's scan of one text: the number of words, and the checksums of all runs of 1 to n words, in parts."""
    ring: list[int] = []
    out: list[int] = []
    words = 0
    for m in WORD.finditer(text.lower()):
        word = m.group()
        words += 1
        joined = b" " + word
        ring = [crc32(joined, state) for state in ring]
        ring.append(crc32(word))
        out += ring
        if len(ring) == n:
            del ring[0]
        if len(out) >= PART:
            yield words, out
            words, out = 0, []
    yield words, out


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for b in batches:
        for part in slices(b, "text"):
            yield part, [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]


def histogram(rows: DataFrame, n: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: how many features of all texts fall into each bucket that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for _, texts in _texts(batches):
            for text in texts:
                for _, found in checksums(text, n):
                    total += np.bincount(np.asarray(found, dtype=np.int64) % buckets, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    found_by_workers(rows.sparkSession)
    return rows.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """One gain for each bucket, from the histograms of the corpus and of the target; buckets bounds what reaches the driver."""
    both = source.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    rows = both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect()
    s, t = np.zeros(buckets), np.zeros(buckets)
    for r in rows:
        s[r["bucket"]], t[r["bucket"]] = r["s"], r["t"]
    return np.floor(1000.0 * np.log((t + 1.0) * (s.sum() + buckets) / ((s + 1.0) * (t.sum() + buckets)))).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, n: int = RUN) -> DataFrame:
    """doc_id, n_words, n_features and weight of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _texts(batches):
            made = []
            for text in texts:
                words = features = total = 0
                for w, found in checksums(text, n):
                    words, features = words + w, features + len(found)
                    total += int(gain[np.asarray(found, dtype=np.int64) % len(gain)].sum())
                made.append((words, features, total // features if features else 0))
            columns = np.asarray(made, dtype=np.int64).reshape(-1, 3).T
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(c) for c in columns]], names=["doc_id", "n_words", "n_features", "weight"])

    found_by_workers(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise times 1000, floored, from the first 32 bits of a hash of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h.cast("double") + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, n: int = RUN, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score of every document, and rank (from 1) of the floor(percent * N / 100) that are drawn.

    N counts the documents of at least least_words words; ties in score go to the smaller doc_id.
    """
    gain = gains(histogram(docs, n, buckets), histogram(target, n, buckets), buckets)
    rows = weighed(docs, gain, n).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    late, down, place = fresh(rows, "late", "down", "place")
    rows = rows.withColumn(late, F.col("doc_id").isNull() | (F.col("n_words") < least_words)).withColumn(down, -F.col("score"))
    rows = cut(rows)  # narrow rows: else the range bounds' sampling would scan all texts once more
    drawn = rows.agg(F.count_if(~F.col(late)).alias("n")).first()["n"] * percent // 100
    order = ranked(rows, [late, down, "doc_id", "n_features", "weight"], place)
    return order.select("doc_id", "n_features", "weight", "score", F.when(~F.col(late) & (F.col(place) < drawn), F.col(place) + 1).alias("rank"))


#: CRC-32 is computed from its polynomial: a table of 256 values by eight shifts each, then one look-up a byte of each different feature.
ORACLE_SQL = rf"""
WITH RECURSIVE shifted(b, k, v) AS (
  SELECT range::BIGINT, 0, range::BIGINT FROM range(256)
  UNION ALL
  SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM shifted WHERE k < 8
), crc AS (
  SELECT list(v ORDER BY b) AS tab FROM shifted WHERE k = 8
), texts AS (
  SELECT 's' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 't', item_id, text FROM benchmark
), worded AS (
  SELECT side, id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{BETWEEN}'), lambda x: x <> '') AS ws FROM texts
), placed AS (
  SELECT side, id, ws, unnest(range(1, len(ws) + 1)) AS p FROM worded
), runs AS (
  SELECT side, id, ws[p] AS f FROM placed UNION ALL SELECT side, id, ws[p] || ' ' || ws[p + 1] FROM placed WHERE p < len(ws)
), counted AS (
  SELECT side, id, f, count(*) AS n FROM runs GROUP BY ALL
), hexed AS (
  SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM counted)
), summed AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::INT, 2))::BIGINT)),
                            lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket
  FROM hexed, crc
), bucketed AS (
  SELECT side, id, bucket, n FROM counted JOIN summed USING (f)
), shares AS (
  SELECT bucket, coalesce(sum(n) FILTER (side = 's'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 't'), 0)::DOUBLE AS t FROM bucketed GROUP BY bucket
), totals AS (
  SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM shares
), gain AS (
  SELECT bucket, floor(1000.0::DOUBLE * ln((t + 1) * (s_all + {BUCKETS}) / ((s + 1) * (t_all + {BUCKETS}))))::BIGINT AS g FROM shares, totals
), weights AS (
  SELECT id, sum(n)::BIGINT AS n_features, floor(sum(n * g)::DOUBLE / sum(n)::DOUBLE)::BIGINT AS weight FROM bucketed JOIN gain USING (bucket) WHERE side = 's' GROUP BY id
), scored AS (
  SELECT id AS doc_id, len(ws) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         coalesce(weight, 0)::BIGINT + floor(-1000.0::DOUBLE * ln(-ln((('0x' || sha256('{SEED}:' || id)[:8])::BIGINT::DOUBLE + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM worded LEFT JOIN weights USING (id) WHERE side = 's'
), ordered AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM scored WHERE n_words >= {LEAST_WORDS}
)
SELECT doc_id, n_features, weight, score,
       CASE WHEN place <= (SELECT count(*) FROM ordered) * {PERCENT} // 100 THEN place END::BIGINT AS rank
FROM scored LEFT JOIN ordered USING (doc_id)
"""

__all__ = ["ORACLE_SQL", "checksums", "gains", "histogram", "noise", "resample", "weighed"]
