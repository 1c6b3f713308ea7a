"""Sharding by jump consistent hashing (Lamping & Veach, 2014), in built-in expressions only.

A stable key and the number of shards decide the shard; there is no ring table. Going from
n to n + 1 shards moves a row only into shard n, and only 1 in n + 1 of the rows moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import n_chunks, table

#: Jumps tried before the loop over all shards; a key makes ln(shards) jumps on average.
FAST_JUMPS = 40


def jump_hash(key: Column, shards: int) -> Column:
    """The shard, 0 to ``shards`` - 1, of a key of any type; a null key is a key like another.

    Jump b + 1 draws the b-th number of a stream that the key seeds (xxhash64 of key and b),
    so that the draws up to shard b don't depend on the number of shards.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")

    def step(acc: Column, _i: Column) -> Column:
        draw = F.shiftrightunsigned(F.xxhash64(key, acc["j"]), 33) + 1
        jump = F.floor((acc["j"] + 1) * (F.lit(float(1 << 31)) / draw)).cast("long")
        return F.when(acc["j"] < shards, F.struct(acc["j"].alias("b"), jump.alias("j"))).otherwise(acc)

    start = F.struct(F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))
    quick = F.aggregate(F.sequence(F.lit(1), F.lit(min(shards, FAST_JUMPS))), start, step)
    if shards <= FAST_JUMPS:
        return quick["b"].cast("int")
    # a key that has not ended after FAST_JUMPS jumps goes on for as many as can be needed
    rest = F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step)
    return F.when(quick["j"] >= shards, quick["b"]).otherwise(rest["b"]).cast("int")


def assign(df: DataFrame, key: str = "doc_id", shards: int = 8, text: str = "text", out: str = "shard") -> DataFrame:
    """``df`` with its shard; all columns stay. Null keys share one shard."""
    return df.withColumn(out, jump_hash(F.col(key), shards))


def place(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shard and slot of every row: ``key, size, text_crc32, law, shard, slot, grown_shard``.

    ``size`` is the UTF-8 length of the text (null: 0) plus 1; ``text_crc32`` that of its bytes
    (null: none). ``slot`` numbers a shard's rows from 0 without gaps, in the order of a hash
    of key and text. Rows that repeat a key share its shard and get slots of their own. An
    empty table gives no rows; other columns of ``docs``, also of the names made here, are
    not carried.

    A shard isn't sorted as a whole: its rows are dealt to chunks by hash, the chunk counts
    make the first slot of each chunk, and only the rows of a chunk are ranked together.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    chunks = n_chunks(spark, docs.count())
    rows = docs.select(
        F.col(key),
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.lit("key").alias("law"),
        jump_hash(F.col(key), shards).alias("shard"),
        jump_hash(F.col(key), shards + 1).alias("grown_shard"),
        F.xxhash64(F.col(key), body).alias("_h"),
    ).withColumn("_c", F.pmod(F.col("_h"), F.lit(chunks)).cast("int"))
    counts = rows.groupBy("shard", "_c").count()
    before = Window.partitionBy("shard").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    # shards * chunks rows: one for every 50,000 / shards of the input
    first = counts.select("shard", "_c", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))
    rank = Window.partitionBy("shard", "_c").orderBy("_h", key, "text_crc32")
    return (
        rows.withColumn("_rank", F.row_number().over(rank))
        .join(first, ["shard", "_c"])
        .select(key, "size", "text_crc32", "law", "shard", (F.col("_first") + F.col("_rank") - 1).cast("long").alias("slot"), "grown_shard")
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 by the jump hash of doc_id."""
    return place(table(spark, sf_dir, "documents"), shards=8)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents with their shard, of 8; no row comes or goes.

    A column that is named shard already is replaced, in any case of its letters; all others stay. Null keys
    share one shard, rows that repeat a key are in one; the text, null or not, has no say; an empty table
    stays empty.
    """
    return assign(docs.drop("shard"), "doc_id", 8)
