"""Spelling variants by anagram hashing (Reynaert, 2004).

A word's key is the sum of a power of each of its letters, so all words of the same letters
share it, and one inserted, removed or exchanged letter changes it by a value of the alphabet:
v(b), -v(a) or v(b) - v(a). Two words therefore differ by one letter only if

    key = other key - v(b)             (inserted or removed), or
    key - v(a) = other key - v(b)      (exchanged),

so each word is entered under its key and under its key less each of its letters, and both
cases are one join on equal values, of as many entries a word as it has letters. The letters of
what meets are the same but for one; that their order is too is verified by the edit distance.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

LETTERS = "A-Za-zÀ-ÿ"
#: Keys are sums modulo 2^62, so that words of any length have one.
MASK = (1 << 62) - 1
#: Words of MIN_LENGTH code points and MIN_COUNT occurrences; a form is STRONGER times as frequent.
MIN_LENGTH, MIN_COUNT, STRONGER = 6, 5, 5
#: One in SLIP runs of a document loses a letter, if slips are asked for.
SLIP = 199
#: Different words that a task counts before it hands them on.
HELD = 200_000
#: Code points of a text that are read at a time.
PIECE = 1 << 20

_RUN, _GAP = re.compile(f"[{LETTERS}]+"), re.compile(f"[^{LETTERS}]")


def runs(text: str) -> Iterator[list[str]]:
    """The runs of letters, A-Z in lower case, in lists of bounded length; no run is cut."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            gap = _GAP.search(text, end)
            end = gap.start() if gap else len(text)
        # lower() of bytes changes ASCII only
        yield _RUN.findall(text[at:end].encode("utf-8", "replace").lower().decode())
        at = end


def slipped(run: str, h: int, slip: int) -> str:
    """The run without one code point if ``slip`` divides ``h``."""
    if h % slip:
        return run
    i = h % len(run)
    return run[:i] + run[i + 1 :]


def words_of(docs: DataFrame, key: str = "doc_id", text: str = "text", slip: int = 0) -> DataFrame:
    """``word, n``: all words of ``docs`` with their occurrences.

    A word is a maximal run of letters, A-Z in lower case. With ``slip``, a run whose CRC-32 of
    ``<key>:<run>`` is divisible by it loses a code point, which simulates misspellings; a null
    key counts as empty there. Null texts have no words. Tasks count before anything is shuffled.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            return got

        for batch in batches:
            for k, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                start = zlib.crc32(f"{k or ''}:".encode())
                for found in runs(body.as_py() or ""):
                    for run, n in Counter(found).items():
                        word = slipped(run, zlib.crc32(run.encode(), start), slip) if slip else run
                        if word:
                            seen[word] = seen.get(word, 0) + n
                if len(seen) >= HELD:
                    yield out()
        if seen:
            yield out()

    found = docs.filter(F.col(text).isNotNull()).select(F.col(key).cast("string"), text).mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def value(letter: Column) -> Column:
    """The letter's share of a key: the fifth power of its code point. The differences of any two
    letters' values are all distinct."""
    v = F.ascii(letter).cast("long")
    return v * v * v * v * v


def entries(words: DataFrame) -> DataFrame:
    """Each word under its key (``off`` 0) and under its key less each of its letters (``off`` 1)."""
    letters = words.withColumn("letters", F.filter(F.split("word", ""), lambda x: x != ""))
    keyed = letters.withColumn("key", F.aggregate("letters", F.lit(0).cast("long"), lambda k, x: (k + value(x)).bitwiseAND(F.lit(MASK))))
    less = F.transform(F.array_distinct("letters"), lambda x: F.struct(F.lit(1).alias("off"), (F.col("key") - value(x)).bitwiseAND(F.lit(MASK)).alias("key")))
    own = F.array(F.struct(F.lit(0).alias("off"), "key"))
    at = keyed.select("word", "n", F.size("letters").alias("len"), F.explode(F.concat(own, less)).alias("e"))
    return at.select("word", "n", "e.key", "e.off", (F.col("len") - F.col("e.off")).alias("rest"))


def near_pairs(words: DataFrame) -> DataFrame:
    """``word, n, other, other_n``: the pairs of words that differ by one code point, each once.

    ``words`` (word, n) has each word once; a written table, since it is read twice.
    """
    a, b = entries(words), entries(words).filter("off = 1")
    b = b.select(F.col("word").alias("other"), F.col("n").alias("other_n"), "key", "rest", F.col("off").alias("other_off"))
    once = (F.col("off") == 0) | (F.col("word") < F.col("other"))
    met = a.join(b, ["key", "rest"]).filter(once & (F.levenshtein("word", "other", 1) == 1))
    return met.select("word", "n", "other", "other_n")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root``: where the chain of ``forms`` (word, form) ends, by doubling the steps.

    A form is more frequent than its word, so no chain is a ring, and its length is at most the
    logarithm of the largest count; the rounds are the logarithm of that.
    """
    at = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        nxt = written(at.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if not nxt.filter("moved").head(1):
            return nxt.select("word", "root")
        at = nxt.select("word", "root")


def spelling_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", slip: int = 0) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of all words with MIN_LENGTH code points and
    MIN_COUNT occurrences in ``docs``.

    ``n_near`` counts the words that differ by one inserted, deleted or replaced code point.
    ``form`` is the most frequent of them (ties: the first in code-point order) if it is STRONGER
    times as frequent as the word, else null; ``root`` is where following the forms ends, the
    word itself if it has none. Rows that repeat count as often as they are there; null and empty
    texts have no words; an empty table gives no rows; other columns are left out.
    """
    counted = words_of(docs, key, text, slip).filter((F.length("word") >= MIN_LENGTH) & (F.col("n") >= MIN_COUNT))
    words = written(counted, "words")
    both = F.array(
        F.struct("word", F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word")).alias("near")),
        F.struct(F.col("other").alias("word"), F.struct((-F.col("n")).alias("n"), F.col("word").alias("word")).alias("near")),
    )
    near = near_pairs(words).select(F.explode(both).alias("p")).groupBy(F.col("p.word").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), F.min("p.near").alias("best"))
    strong = -F.col("best.n") >= STRONGER * F.col("n")
    got = words.join(near, "word", "left").select(
        "word",
        F.when(strong, F.col("best.word")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(strong, -F.col("best.n")).alias("form_n"),
    )
    got = written(got, "forms")
    ends = roots(got.filter("form IS NOT NULL"))
    return got.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents, one in 199 runs a document short of a letter, and their forms."""
    return spelling_groups(table(spark, sf_dir, "documents"), slip=SLIP)


#: CRC-32 from its table, near words by what is left and right of each place.
SQL_OP12 = """
WITH crc AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(0, 256) AS r(i))
), runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run
    FROM documents WHERE text IS NOT NULL)
  WHERE length(run) >= 6 GROUP BY doc_id, run
), hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(
    list_transform(range(0, len(b) // 2), lambda i: CAST('0x' || substr(b, 2 * i + 1, 2) AS BIGINT)),
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), CAST(4294967295 AS BIGINT))) AS h
  FROM (SELECT run, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS b FROM runs), crc
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN left(run, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), cut AS (
  SELECT word, n, i, left(word, i - 1) AS a, substr(word, i + 1) AS z FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT x.word, y.word AS other, y.n AS other_n FROM cut x JOIN cut y ON x.i = y.i AND x.a = y.a AND x.z = y.z AND x.word <> y.word
  UNION SELECT x.word, y.word, y.n FROM cut x JOIN words y ON y.word = x.a || x.z
  UNION SELECT y.word, x.word, x.n FROM cut x JOIN words y ON y.word = x.a || x.z
), best AS (
  SELECT word, count(*) AS n_near, max(other_n) AS top FROM near GROUP BY word
), formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 5 * w.n THEN top END AS form_n,
         (SELECT min(other) FROM near x WHERE x.word = w.word AND x.other_n = top AND top >= 5 * w.n) AS form
  FROM words w LEFT JOIN best b ON b.word = w.word
), chain AS (
  WITH RECURSIVE r AS (
    SELECT word, word AS ends, 0 AS d FROM formed
    UNION ALL SELECT r.word, f.form, d + 1 FROM r JOIN formed f ON f.word = r.ends WHERE f.form IS NOT NULL
  ) SELECT word, arg_max(ends, d) AS root FROM r GROUP BY word
)
SELECT f.word, f.form, c.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n FROM formed f JOIN chain c ON c.word = f.word
"""
