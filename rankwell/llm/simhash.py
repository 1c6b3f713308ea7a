"""Document fingerprints: SimHash (Charikar, 2002), found again through permuted block
tables (Manku, Jain & Das Sarma, 2007).

The terms of a text are its words and its pairs of neighbouring words, in lower case. Each
term's hash votes with the term's weight, 1 + ln(occurrences), for or against each of 64
bits; pairs weigh in full, words half, since single words are shared by all texts of a
language.

Two fingerprints within radius r of each other differ in at most r of r + 2 blocks of bits,
so they agree in at least two of them: for each choice of two blocks, a table holds the
fingerprints under those two. All that agree with a query in some table are compared with it;
a pair that agrees in several tables counts in the first of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, text_of, written
from .subwords import Subwords, pair_hashes

BITS = 64
WORD_WEIGHT = 0.5
#: Code points that are hashed at a time.
BATCH = 400_000
#: Terms that vote at a time.
SLICE = 1 << 15
#: Bytes of text that a task takes.
TASK_BYTES = 32 << 20
#: Of the documents whose id is divisible by QUERY_EVERY, those within RADIUS are counted.
QUERY_EVERY, RADIUS = 50, 3


def fingerprints(texts: list[str]) -> np.ndarray:
    """The fingerprint of each whole text, as uint64; of a text without words, 0."""
    out = np.zeros(len(texts), np.uint64)
    words = Subwords(lower=True)
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= BATCH):
            size += len(texts[hi])
            hi += 1
        h, owner = words.word_hashes(texts[lo:hi])
        cut = np.searchsorted(owner, np.arange(hi - lo + 1))
        for i in range(hi - lo):
            w = h[cut[i] : cut[i + 1]]
            if len(w):
                out[lo + i] = _vote(w)
        lo = hi
    return out


def _vote(words: np.ndarray) -> np.uint64:
    single, n1 = np.unique(words, return_counts=True)
    double, n2 = np.unique(pair_hashes(words), return_counts=True)
    terms = np.concatenate([single, double])
    weights = np.concatenate([WORD_WEIGHT * (1 + np.log(n1)), 1 + np.log(n2)]).astype(np.float32)
    votes = np.zeros(BITS, np.float64)
    for lo in range(0, len(terms), SLICE):  # 64 numbers a term are held for a slice only
        part = weights[lo : lo + SLICE]
        bits = np.unpackbits(terms[lo : lo + SLICE].view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
        votes += 2 * (part @ bits) - part.sum()
    return np.packbits(votes > 0).view(np.uint64)[0]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal bits."""
    return 1 - np.bitwise_count(a ^ b) / BITS


def edited(text: str, after: str) -> str:
    """The last third of the text replaced by the beginning of another."""
    n = len(text) // 3
    return text[: len(text) - n] + after[:n]


def as_hex(fp: np.ndarray) -> list[str]:
    return [f"{x:016x}" for x in fp.tolist()]


RESULT = "doc_id {id}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _rows(ids: list, texts: list[str], fps: np.ndarray, after: list[str], after_fps: np.ndarray) -> list:
    new = [edited(t, a) for t, a in zip(texts, after, strict=True)]
    own = fingerprints(new)
    return [
        ids,
        [len(t) for t in texts],
        [hashlib.sha256(t.encode()).hexdigest() for t in new],
        as_hex(fps),
        as_hex(own),
        likeness(fps, own),
        likeness(fps, after_fps),
    ]


def fingerprint_edits(docs: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likeness; see ``RESULT``.

    The next document is the one with the next smaller doc_id (null the smallest); of equal
    doc_ids the one with the smaller hash of the text; after the last comes the first. A null
    text is empty. Equal texts have equal fingerprints; texts without words the fingerprint
    0. A single document follows itself. An empty table gives no rows; other columns are left
    out.

    The rows are dealt to ranges of doc_id and sorted there, which is the one shuffle of the
    texts; rows that repeat doc_id and text are parted by a number of their own, so that no
    range has to hold them all. What follows the last row of a range is the first of the next
    range: those two rows of each range, of ``task_bytes`` of text, are written with their
    texts and joined afterwards.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType
    rows = docs.select("doc_id", text_of().alias("text"), F.xxhash64(text_of()).alias("_h"), F.monotonically_increasing_id().alias("_n"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, -(-size // task_bytes))
    order = [F.col("doc_id").desc_nulls_last(), F.col("_h").desc(), F.col("_n")]
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    schema = f"part int, place string, {RESULT.format(id=kind.simpleString())}, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: tuple | None = None  # the last row so far, whose next isn't known yet
        id_type = None

        def batch(place: str, cols: list, texts: list) -> pa.RecordBatch:
            n = len(texts)
            types = [pa.int32(), pa.string(), id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string()]
            values = [[part] * n, [place] * n, *cols, texts]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], names=["part", "place", "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "text"])

        blank = [[None]] * 5
        for got in batches:
            id_type = got.schema.field("doc_id").type
            for lo in range(0, got.num_rows, 1000):
                piece = got.slice(lo, 1000)
                ids, texts = piece.column("doc_id").to_pylist(), piece.column("text").to_pylist()
                fps = fingerprints(texts)
                if held is None:
                    yield batch("first", [[ids[0]], [len(texts[0])], *blank], [texts[0]])
                else:
                    ids, texts, fps = [held[0], *ids], [held[1], *texts], np.concatenate([[held[2]], fps])
                held = (ids[-1], texts[-1], fps[-1])
                if len(ids) > 1:
                    yield batch("inner", _rows(ids[:-1], texts[:-1], fps[:-1], texts[1:], fps[1:]), [None] * (len(ids) - 1))
        if held is not None:
            yield batch("last", [[held[0]], [len(held[1])], *blank], [held[1]])

    done = written(ranged.select("doc_id", "text").mapInArrow(run, schema), "simhash")
    cols = [c.split()[0] for c in RESULT.split(", ")]
    inner = done.filter(F.col("place") == "inner").select(*cols)
    first = done.filter(F.col("place") == "first").select("part", F.col("text").alias("after"))
    last = done.filter(F.col("place") == "last")
    # one slim row for each range; the last range is followed by the first
    turn = Window.orderBy("part")
    follow = first.select("part").withColumn("next", F.coalesce(F.lead("part").over(turn), F.min("part").over(Window.partitionBy())))
    ends = last.join(follow, "part").join(first.withColumnRenamed("part", "next"), "next").select("doc_id", "text", "after")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            if got.num_rows:
                texts, after = got.column("text").to_pylist(), got.column("after").to_pylist()
                values = _rows(got.column("doc_id").to_pylist(), texts, fingerprints(texts), after, fingerprints(after))
                types = [got.schema.field("doc_id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], names=cols)

    return inner.unionByName(ends.mapInArrow(close, RESULT.format(id=kind.simpleString())))


def _edges(radius: int) -> list[tuple[int, int]]:
    """First bit and width of each of the radius + 2 blocks."""
    cut = [BITS * i // (radius + 2) for i in range(radius + 3)]
    return [(a, b - a) for a, b in zip(cut, cut[1:], strict=False)]


def tables(fp: Column, radius: int) -> Column:
    """An array with the entry of each permuted table: which two blocks, as a mask, and their bits."""
    block = [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << n) - 1)) for a, n in _edges(radius)]
    return F.array(*[F.struct(F.lit(1 << i | 1 << j).alias("table"), block[i].alias("a"), block[j].alias("b")) for i, j in combinations(range(radius + 2), 2)])


def first_table(a: Column, b: Column, radius: int) -> Column:
    """The first table in which two fingerprints agree, as its mask."""
    x = a.bitwiseXOR(b)
    same = F.lit(0)
    for k, (at, n) in enumerate(_edges(radius)):
        same = same.bitwiseOR(F.when(F.shiftrightunsigned(x, at).bitwiseAND(F.lit((1 << n) - 1)) == 0, 1 << k).otherwise(0))
    low = same.bitwiseAND(-same)
    rest = same.bitwiseXOR(low)
    return low.bitwiseOR(rest.bitwiseAND(-rest))


def _keyed(df: DataFrame, radius: int, name: str) -> DataFrame:
    return df.withColumn("_x", F.explode(tables(F.col(name), radius))).select(*df.columns, F.col("_x.table").alias("_table"), F.col("_x.a").alias("_a"), F.col("_x.b").alias("_b"))


def search(queries: DataFrame, all_rows: DataFrame, radius: int = RADIUS, fp: str = "fingerprint") -> DataFrame:
    """``query, fingerprint, distance, n``: all distinct fingerprints within ``radius`` of each
    distinct query fingerprint, itself included if it is among ``all_rows``, and of how many rows.

    Exact: no bucket is cut. Null fingerprints match nothing. The distance is tested in the join
    itself, so what leaves it are the pairs that are found, each once.
    """
    if not 0 <= radius <= 14:
        raise ValueError("radius must be from 0 to 14")
    q = queries.select(F.col(fp).alias("query")).filter("query IS NOT NULL").distinct()
    f = all_rows.select(F.col(fp).alias("fingerprint")).filter("fingerprint IS NOT NULL").groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"))
    a, b = _keyed(q, radius, "query").alias("q"), _keyed(f, radius, "fingerprint").alias("f")
    distance = F.bit_count(F.col("query").bitwiseXOR(F.col("fingerprint")))
    same = (F.col("q._table") == F.col("f._table")) & (F.col("q._a") == F.col("f._a")) & (F.col("q._b") == F.col("f._b"))
    once = first_table(F.col("query"), F.col("fingerprint"), radius) == F.col("q._table")
    return a.join(b, same & (distance <= radius) & once).select("query", "fingerprint", distance.alias("distance"), "n")


def with_neighbours(rows: DataFrame, radius: int = RADIUS, every: int = QUERY_EVERY, out: str = "n_near") -> DataFrame:
    """``rows`` (doc_id, fingerprint as hex digits, ...; a written table) with the number of rows whose
    fingerprint is within ``radius`` of theirs, themselves included, where doc_id is divisible by
    ``every``; null elsewhere."""
    # 16 digits are more than a signed number of 64 bits holds: two halves
    half = lambda k: F.conv(F.substring("fingerprint", k, 8), 16, 10).cast("long")
    slim = rows.select("doc_id", F.shiftleft(half(1), 32).bitwiseOR(half(9)).alias("fingerprint"))
    asked = slim.filter(F.col("doc_id") % every == 0)
    found = search(asked, slim, radius).groupBy("query").agg(F.sum("n").alias(out))
    text = F.lpad(F.lower(F.hex("query")), 16, "0")
    got = rows.filter(F.col("doc_id") % every == 0).join(found.select(text.alias("fingerprint"), out), "fingerprint", "left")
    rest = rows.filter(F.coalesce(F.col("doc_id") % every != 0, F.lit(True))).withColumn(out, F.lit(None).cast("long"))
    return got.select(*rows.columns, out).unionByName(rest)


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and their edited texts, fingerprinted; for ids divisible by 50, how many
    documents have a fingerprint within 3 bits of theirs (n_near), found in the block tables."""
    return with_neighbours(written(fingerprint_edits(table(spark, sf_dir, "documents")), "fingerprints"))
