"""Benchmark decontamination, in DataFrame functions only.

Normalised word windows of the benchmark's items form a hash set that is broadcast (behind a check of its size; beyond it the
windows are joined by a shuffle). The windows of every document are scanned against it; as the key is the window's own words,
a match is verified by being one. Document words inside any match are hit.

Words are runs of digits, letters a-z (A-Z is lowered, nothing else is) and characters beyond ASCII. A window is 10 consecutive
words of an item; an item of fewer words, but not none, is one window.

Cases: null or empty text has no words; an item without words, or with null text, has no windows; an item whose id is null marks
words but is not listed; items that repeat count once by id; documents that repeat with the same text are each reported, and
with the same doc_id but other text each for itself; an empty benchmark leaves every document clean; an empty table gives no
rows; other columns are passed on by remove() and ignored by scan(), whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import bounded, cut, fresh, quoted, text_hash

WINDOW = 10
#: The letters that are lowered, and what stands between words.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """A-Z lowered and nothing else; lower() does that, and faster, where all is ASCII."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def gram(of: str, start: str, length: str) -> Column:
    return F.array_join(F.slice(F.col(of), F.col(start), F.col(length)), " ")


def windows(benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """gram, length, items: every distinct window of the benchmark with the sorted ids of the items that have it."""
    items = benchmark.select(F.col("item_id"), words(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    items = items.withColumn("length", F.least(F.size("ws"), F.lit(n)))
    starts = items.select("item_id", "ws", "length", F.explode(F.expr("sequence(1, size(ws) - length + 1)")).alias("start"))
    return starts.select("item_id", "length", gram("ws", "start", "length").alias("gram")).groupBy("gram", "length").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))


def hits(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """doc_id, key (of the text), spans (start from 0, length; sorted, distinct), items: for each document with a match."""
    held = windows(benchmark, n)
    lengths = sorted(r[0] for r in held.select("length").distinct().collect())  # n values at most
    small = bounded(held)
    texts = docs.select("doc_id", text_hash().alias("key"), words(F.col("text")).alias("ws"))
    if not lengths:
        lengths = [n]
    if len(lengths) > 1:
        texts = texts.withColumn("length", F.explode(F.array(*[F.lit(k) for k in lengths])))
    else:
        texts = texts.withColumn("length", F.lit(lengths[0]))
    scan = texts.where(F.size("ws") >= F.col("length")).select("doc_id", "key", "ws", "length", F.explode(F.expr("sequence(1, size(ws) - length + 1)")).alias("start"))
    scan = scan.select("doc_id", "key", "length", "start", gram("ws", "start", "length").alias("gram"))
    found = scan.join(F.broadcast(held.drop("length")) if small else held.drop("length").hint("merge"), "gram")
    return found.groupBy("doc_id", "key").agg(
        F.array_sort(F.collect_set(F.struct((F.col("start") - 1).alias("start"), "length"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )


def n_covered(spans: str) -> Column:
    """Words in the union of sorted spans."""
    return F.expr(
        f"aggregate({spans}, named_struct('n', 0, 'end', 0), (acc, s) -> named_struct("
        "'n', acc.n + greatest(0, s.start + s.length - greatest(s.start, acc.end)), 'end', greatest(acc.end, s.start + s.length)), acc -> acc.n)"
    )


def scan(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the items and spans (in words) themselves."""
    found = hits(docs, benchmark, n).withColumnsRenamed({"doc_id": "hit_id", "key": "hit_key"})
    every = docs.select("doc_id", text_hash().alias("key"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    both = every.join(found, every.doc_id.eqNullSafe(found.hit_id) & (every.key == found.hit_key), "left")
    items = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    return both.select(
        "doc_id", "n_words", F.coalesce(n_covered("spans"), F.lit(0)).cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), F.col("spans").isNotNull().alias("contaminated"), items.alias("items"), "spans",
    )


def remove(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, whole: bool = True) -> DataFrame:
    """docs without contaminated documents or, if not whole, with the hit words (and what follows each up to the next) cut out."""
    hit_id, hit_key, spans, key, runs = fresh(docs, "id", "hit", "spans", "key", "runs")
    found = hits(docs, benchmark, n).select(F.col("doc_id").alias(hit_id), F.col("key").alias(hit_key), F.col("spans").alias(spans))
    # documents with a hit are narrow rows; where they are few, whole texts need not be shuffled to meet them
    found = cut(found.drop(spans) if whole else found)
    found = F.broadcast(found) if bounded(found) else found
    keyed = docs.withColumn(key, text_hash())
    on = F.col("doc_id").eqNullSafe(F.col(hit_id)) & (F.col(key) == F.col(hit_key))
    if whole:
        return keyed.join(found, on, "left_anti").drop(key)
    # spans that touch become one run, so that a word is looked up in few of them
    merged = F.expr(
        f"aggregate({spans}, cast(array() as array<struct<start:int,end:int>>), (acc, s) -> if(size(acc) > 0 and s.start <= element_at(acc, -1).end,"
        " concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start, 'end', greatest(element_at(acc, -1).end, s.start + s.length)))),"
        " concat(acc, array(named_struct('start', s.start, 'end', s.start + s.length)))))"
    )
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    own, between = fresh(keyed, "words", "between")
    hit = F.col(spans).isNotNull()
    joined = keyed.join(found, on, "left").withColumn(runs, merged)
    joined = joined.withColumn(own, F.when(hit, F.expr(f"regexp_extract_all(text, r'({word})', 1)"))).withColumn(between, F.when(hit, F.expr(f"split(text, r'{word}')")))
    left = F.expr(f"concat({between}[0], array_join(transform({own}, (w, i) -> if(exists({runs}, r -> i >= r.start and i < r.end), '', concat(w, {between}[i + 1]))), ''))")
    return joined.withColumn("text", F.when(F.col(spans).isNotNull(), left).otherwise(F.col("text"))).select(*[quoted(c) for c in docs.columns])


ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{BETWEEN}'), lambda x: x <> '') AS ws FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{BETWEEN}'), lambda x: x <> '') AS ws FROM benchmark
), bw AS (
  SELECT item_id, l, ws[p + 1 : p + l] AS g FROM (SELECT item_id, ws, least(len(ws), {WINDOW}) AS l, unnest(range(len(ws) - least(len(ws), {WINDOW}) + 1)) AS p FROM b WHERE len(ws) > 0)
), dw AS (
  SELECT doc_id, l, p, ws[p + 1 : p + l] AS g FROM (SELECT doc_id, ws, l, unnest(range(len(ws) - l + 1)) AS p FROM d, (SELECT DISTINCT l FROM bw) WHERE len(ws) >= l)
), h AS (
  SELECT doc_id, l, p, item_id FROM dw JOIN bw USING (l, g)
), covered AS (
  SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + l)) AS w FROM h) GROUP BY doc_id
), it AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(i, ',' ORDER BY i)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM h) GROUP BY doc_id
)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN it USING (doc_id)
"""
