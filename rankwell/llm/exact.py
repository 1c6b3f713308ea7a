"""Exact deduplication by content sort, in built-in expressions only.

Every row has a place in one global order: the first code points of its normalised text, the
text's SHA-256, and a hash of its id. Splitters sampled from the table, weighted by bytes, cut
that order into ranges of nearly equal size; a binary search over them finds a row's range.
Spark's external sort puts equal texts of a range beside each other, and each row is compared
in full with its neighbour: where the text changes, a new run of copies begins. As the order
goes on below the text, a text with a third of all rows is cut into as many ranges as it fills.

A group that a splitter has cut is stitched: the last text of each range is compared in full
with the first of the next, and runs that continue each other share one representative. These
are two runs a range at most, so the table that carries them back is bounded by the number of
ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, text_of, written
from .decontaminate import LOWER, UPPER

#: Bytes of text in a range, as long as there are no more than MAX_RANGES.
RANGE_BYTES = 4 << 20
#: Ranges at least and at most; sampled rows a range. Splitters are some 200 bytes each.
MIN_RANGES, MAX_RANGES, SAMPLES = 64, 50_000, 8
#: Code points of the text that a splitter holds.
HEAD = 24


def normalised(text: Column) -> Column:
    """The text with A-Z in lower case; nothing else changes."""
    return F.translate(text, UPPER, LOWER)


def _placed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``id, norm, sha, head, place``: the order of the rows as a string that compares as they do."""
    rows = docs.select(F.col(key).alias("id"), normalised(text_of(text)).alias("norm"))
    rows = rows.select("id", "norm", F.sha2("norm", 256).alias("sha"))
    rows = rows.withColumn("head", F.concat(F.hex(F.encode(F.substring("norm", 1, HEAD), "UTF-8")), "sha"))
    return rows.withColumn("place", F.concat("head", F.lpad(F.lower(F.hex(F.xxhash64("id"))), 16, "0")))


def splitters(docs: DataFrame, key: str, text: str) -> list[str]:
    """Places that cut the rows into ranges of nearly equal bytes, from a sample of bounded size."""
    n, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text_of(text))), F.lit(0))).first()
    ranges = max(MIN_RANGES, min(MAX_RANGES, -(-size // RANGE_BYTES)))
    want = ranges * SAMPLES
    some = docs if n <= want else docs.sample(want / n, 7)
    found = sorted((r.place, r.size) for r in _placed(some, key, text).select("place", (F.octet_length("norm") + 64).alias("size")).collect())
    step = sum(s for _, s in found) / ranges
    cuts, at, seen = [], step, 0
    for place, s in found:
        if seen >= at:
            cuts.append(place)
            at = (seen // step + 1) * step
        seen += s
    return cuts


def range_of(place: Column, cuts: list[str]) -> Column:
    """How many of the sorted ``cuts`` are not above ``place``, by binary search."""
    if not cuts:
        return F.lit(0)
    known = F.split(F.lit(",".join(cuts)), ",")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get(known, at + s - 1) <= place, at + s).otherwise(at))


def content_sort(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "smallest") -> DataFrame:
    """``key, keep_id, group_size, kept, text_sha256`` for every row of ``docs``.

    Rows are equal whose texts are identical once A-Z are lower-cased; null counts as empty, so
    null and empty texts are one group. ``keep_id`` is the smallest (or, with ``keep="largest"``,
    the largest) key of the group, null keys losing to all others, and ``kept`` marks its row; of
    rows that repeat that key with an equal text, just one. An empty table gives no rows; other
    columns, also of the names made here, are not carried. Texts of any length are compared whole.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep must be smallest or largest")
    largest = keep == "largest"
    best = (lambda c: F.max(F.struct(c.isNotNull(), c))) if largest else (lambda c: F.min(F.struct(c.isNull(), c)))
    rows = _placed(docs, key, text)
    rows = rows.select("id", "norm", "sha", "head", range_of(F.col("place"), splitters(docs, key, text)).alias("range"))

    # neighbours: the texts are sorted once, and only those at the ends of a range are kept
    turn = Window.partitionBy("range").orderBy("head", "norm", "id")
    before, after = F.lag("norm").over(turn), F.lead("norm").over(turn)
    rows = rows.withColumns({"before": before, "after": after})
    slim = rows.select(
        "id", "sha", "range", "head",
        (~F.col("before").eqNullSafe(F.col("norm"))).cast("int").alias("new"),
        F.col("before").isNull().alias("first"),
        F.col("after").isNull().alias("last"),
        F.when(F.col("before").isNull() | F.col("after").isNull(), F.col("norm")).alias("edge"),
    )
    # within a run the row that is new comes first also where ids repeat
    runs = slim.withColumn("run", F.sum("new").over(Window.partitionBy("range").orderBy("head", "id", F.desc("new")).rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("range", "run")
    by_id = F.col("id").desc_nulls_last() if largest else F.col("id").asc_nulls_last()
    runs = runs.withColumns({"best": best(F.col("id")).over(run)["id"], "n": F.count(F.lit(1)).over(run), "turn": F.row_number().over(run.orderBy(by_id))})
    done = written(runs.drop("new", "head"), "contentsort")

    # stitching: one row a range, at most MAX_RANGES
    ends = done.filter(F.col("first")).select("range", F.lag("range").over(Window.orderBy("range")).alias("former"))
    first = done.filter(F.col("first")).select("range", "run", F.col("edge").alias("text"))
    last = done.filter(F.col("last")).select(F.col("range").alias("former"), F.col("run").alias("former_run"), F.col("edge").alias("former_text"))
    links = first.join(ends, "range").join(last, "former").filter(F.col("text") == F.col("former_text"))
    cut = links.select(F.explode(F.array(F.struct("range", "run"), F.struct(F.col("former").alias("range"), F.col("former_run").alias("run")))).alias("at")).select("at.*").distinct()
    one = done.filter(F.col("turn") == 1).select("range", "run", "sha", "best", "n")
    parts = one.join(F.broadcast(cut), ["range", "run"])
    choice = F.max(F.struct(F.col("best").isNotNull(), "best", "range")) if largest else F.min(F.struct(F.col("best").isNull(), "best", "range"))
    whole = parts.groupBy("sha").agg(choice.alias("to"), F.sum("n").alias("whole_n"))
    stitched = parts.join(whole, "sha").select("range", "run", F.col("to.best").alias("to"), F.col("to.range").alias("to_range"), "whole_n")
    got = done.join(F.broadcast(stitched), ["range", "run"], "left")
    alone = F.col("to_range").isNull()
    return got.select(
        F.col("id").alias(key),
        F.when(alone, F.col("best")).otherwise(F.col("to")).alias("keep_id"),
        F.coalesce("whole_n", "n").alias("group_size"),
        ((F.col("turn") == 1) & (alone | (F.col("to_range") == F.col("range")))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the representative of their equal texts, which is the largest doc_id."""
    return content_sort(table(spark, sf_dir, "documents"), keep="largest")


SQL_OP13 = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM d
"""
