"""Benchmark decontamination as a prefix-filtered set join, in built-in expressions only.

Items are cut into windows of ten consecutive words (shorter items are one window). To hold
a window, a document must hold all its words, so the necessary prefix of a window is a single
token, and the best one is its rarest: word counts over all documents order the words of each
window by rarity. The documents' words are joined with these prefix tokens alone, each of which
has the places (offset and length) that it has in windows, 55 at most, however many windows
share it. A match at position p of a prefix token that stands at offset o of a window bounds
the window's only possible place: it starts at p - o, which must not be negative, and ends
within the document. What stands there is joined with the windows as a whole, word for word.

The prefix tokens are broadcast in blocks of a fixed size, whatever the benchmark's; each block
is one pass over the documents, and there are far fewer of them than windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, text_of, written

WINDOW = 10
#: Between words; letters of either case are told apart from it before case is folded.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Prefix tokens that are broadcast at a time (each takes some 100 bytes).
BLOCK = 200_000
#: Words of windows up to this number are broadcast to be counted; more are joined by a shuffle.
BROADCAST_WORDS = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def raw_words(text: Column) -> Column:
    """The words in the case they have."""
    return F.array_remove(F.split(text, GAP), "")


def fold(word: Column) -> Column:
    """A-Z in lower case; nothing else changes."""
    return F.translate(word, UPPER, LOWER)


def windows_of(items: DataFrame, width: int = WINDOW) -> DataFrame:
    """``win`` (an array of words) with ``items``, the ids (as strings) it occurs in."""
    words = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.transform(raw_words(text_of()), fold).alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (width - 1), F.lit(1)))
    cut = words.filter(F.size("w") > 0).select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, width))).alias("win"))
    return cut.groupBy("win").agg(F.array_sort(F.collect_set("item")).alias("items"))


def word_counts(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """How often each word of the windows occurs in all documents: ``key, n``.

    Keys are in lower case by Unicode, which joins words that ``fold`` keeps apart; that
    only coarsens the order of rarity.
    """
    words = windows.select(F.explode("win").alias("w")).select(F.lower("w").alias("key")).distinct()
    seen = docs.select(F.explode(raw_words(text_of())).alias("w")).select(F.lower("w").alias("key"))
    small = words.count() <= BROADCAST_WORDS
    seen = seen.join(F.broadcast(words) if small else words, "key").groupBy("key").count()
    return words.join(seen, "key", "left").select("key", F.coalesce("count", F.lit(0)).alias("n"))


def prefixes(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """``key`` (the rarest word) with the windows that it is the prefix of: ``wins``."""
    word = windows.select("win", "items", F.posexplode("win").alias("off", "w")).withColumn("key", F.lower("w"))
    least = word.join(counts, "key").groupBy("win", "items").agg(F.min(F.struct("n", "key", "off")).alias("m"))
    return least.select("win", "items", F.col("m.key").alias("key"), F.col("m.off").alias("off"))


def matches(docs: DataFrame, items: DataFrame, key: str = "doc_id", width: int = WINDOW) -> DataFrame:
    """``key, _h, n_words, start, end, items``: where windows occur, and a row without place
    for each document, so that none is missing. ``_h`` is a hash of the text."""
    windows = written(windows_of(items, width), "windows")
    anchors = written(prefixes(windows, word_counts(docs, windows)), "prefixes")
    held = anchors.groupBy(F.col("key").alias("_key")).agg(F.collect_set(F.struct("off", F.size("win").alias("n"))).alias("places"))
    blocks = max(1, -(-anchors.select("key").distinct().count() // BLOCK))
    rows = docs.select(F.col(key), F.xxhash64(text_of()).alias("_h"), raw_words(text_of()).alias("_w"))
    found = None
    for b in range(blocks):
        part = held.filter(F.pmod(F.xxhash64("_key"), F.lit(blocks)) == b) if blocks > 1 else held
        if b == 0:
            # the empty word stands for the document itself
            own = F.array(F.struct(F.lit(0).alias("off"), F.lit(0).alias("n"))).cast(held.schema["places"].dataType)
            part = part.unionByName(docs.sparkSession.range(1).select(F.lit("").alias("_key"), own.alias("places")))
        each = rows.select(key, "_h", "_w", F.posexplode(F.array_append("_w", F.lit(""))).alias("_p", "_t"))
        each = each.join(F.broadcast(part), F.lower("_t") == F.col("_key")).select(F.col(key), "_h", "_w", "_p", F.explode("places").alias("_x"))
        start, n = F.col("_p") - F.col("_x.off"), F.col("_x.n")
        there = each.filter((n == 0) | ((start >= 0) & (start + n <= F.size("_w"))))
        said = F.array_join(F.transform(F.slice("_w", start + 1, n), fold), " ")
        there = there.select(F.col(key), "_h", F.size("_w").cast("long").alias("n_words"), F.when(n > 0, start).alias("start"), F.when(n > 0, start + n).alias("end"), F.when(n > 0, said).alias("_said"))
        found = there if found is None else found.unionByName(there)
    found = written(found, "places")
    wanted = windows.select(F.array_join("win", " ").alias("_said"), "items")
    hit = found.filter("_said IS NOT NULL").join(wanted, "_said").drop("_said")
    none = found.filter("_said IS NULL").withColumn("items", F.array().cast("array<string>")).drop("_said")
    return hit.unionByName(none)


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", width: int = WINDOW) -> DataFrame:
    """``key, n_words, n_hit, n_items, items_sha256, contaminated`` for every document.

    A word inside any occurrence of a window is hit. Null and empty texts have no words and
    no hits; items without words have no windows; equal windows of several items count for
    each of them. Repeated rows give repeated results; an empty benchmark hits nothing; other
    columns are left out.
    """
    by = Window.partitionBy(key, "_h").orderBy(F.col("start").asc_nulls_first(), "end").rowsBetween(Window.unboundedPreceding, -1)
    hits = matches(docs, items, key, width)
    upto = F.greatest(F.col("start"), F.coalesce(F.max("end").over(by), F.lit(0)))
    fresh = F.coalesce(F.greatest(F.col("end") - upto, F.lit(0)), F.lit(0))
    got = (
        hits.withColumn("_new", fresh)
        .groupBy(key, "_h")
        .agg(
            F.max("n_words").alias("n_words"),
            F.sum("_new").cast("long").alias("n_hit"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("_i"),
            F.count(F.when(F.col("start").isNull(), 1)).cast("int").alias("_times"),
        )
    )
    got = got.withColumn("_", F.explode(F.array_repeat(F.lit(1), F.col("_times"))))
    return got.select(
        key,
        "n_words",
        "n_hit",
        F.size("_i").cast("long").alias("n_items"),
        F.sha2(F.array_join("_i", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items, windows of ten words."""
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a window of a benchmark item go.

    Null and empty texts hold none and stay; rows that repeat a text go or stay together, also where
    doc_id is null or repeated; an empty table, of documents or of items, takes nothing away. All columns
    stay as they are, whatever their names.
    """
    found = matches(docs, table(spark, sf_dir, "benchmark")).filter(F.col("start").isNotNull())
    found = found.select(F.col("doc_id").alias("_id"), "_h").distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == found["_h"]), "left_anti")


SQL_OP9 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, len(w) AS n, list_slice(w, s, s + least(len(w), 10) - 1) AS win
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s FROM b WHERE len(w) > 0)
), pos AS (
  SELECT doc_id, w, unnest(generate_series(1, len(w))) AS p FROM d WHERE len(w) > 0
), sizes AS (SELECT DISTINCT len(win) AS k FROM win),
cand AS (
  SELECT doc_id, p, k, list_slice(w, p, p + k - 1) AS win FROM pos, sizes
  WHERE p + k - 1 <= len(w) AND w[p] IN (SELECT win[1] FROM win)
), hit AS (
  SELECT c.doc_id, c.p, c.k, x.item_id FROM cand c JOIN win x ON c.win = x.win
), covered AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + k - 1)) AS q FROM hit) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN its USING (doc_id)
"""
