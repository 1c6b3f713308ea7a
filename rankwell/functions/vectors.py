"""Vectors as arrays: means, cosine similarity, percentiles, encoders."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType

from ..session import cut
from .text import _col


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; 0 where a vector has no length."""
    a, b = _col(a), _col(b)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(F.lit(0.0))


def subtract(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") - y.cast("double"))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for all rows of a task: the sum of each component and of how many it is."""
    total, count = np.zeros(0), np.zeros(0, np.int64)
    for batch in batches:
        v = batch.column(0).drop_null()
        flat = v.flatten()
        if not len(flat):
            continue
        sizes = np.diff(v.offsets.to_numpy(zero_copy_only=False))
        place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        known = flat.is_valid().to_numpy(zero_copy_only=False)
        x, place = flat.drop_null().to_numpy(zero_copy_only=False).astype(np.float64), place[known]
        wide = max(len(total), int(sizes.max()))
        total = np.pad(total, (0, wide - len(total))) + np.bincount(place, x, wide)
        count = np.pad(count, (0, wide - len(count))) + np.bincount(place, minlength=wide)
    if len(total):
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()]), pa.array([count.tolist()])], names=["total", "n"])


def mean_vector(df: DataFrame, vector: str = "embedding", out: str = "centre") -> DataFrame:
    """The mean of each component over all rows that have it, as one row of one array (null where
    there is no vector).

    Each task sums whole arrays and sends one row; only these few are taken apart by component.
    """
    parts = df.select(F.col(vector)).filter(F.col(vector).isNotNull()).mapInArrow(_sums, "total array<double>, n array<long>")
    each = parts.select(F.posexplode(F.arrays_zip("total", "n")).alias("i", "x")).groupBy("i").agg((F.sum("x.total") / F.nullif(F.sum("x.n"), F.lit(0))).alias("m"))
    held = each.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias(out))
    return held.select(F.when(F.size(out) > 0, F.col(out)).alias(out))


def centred_cosine(df: DataFrame, profile: DataFrame, vector: str = "embedding", out: str = "score", corpus: DataFrame | None = None) -> DataFrame:
    """``df`` with the cosine to the profile's vector (column ``profile`` of one row), both less
    the mean of all vectors (those of ``corpus``, a plainer way to the same ones, if given). Mean and
    profile are one row each and broadcast."""
    centre = mean_vector(df if corpus is None else corpus, vector, "_centre")
    got = df.crossJoin(F.broadcast(centre)).crossJoin(F.broadcast(profile.select(F.col("profile").alias("_profile"))))
    return got.withColumn(out, cosine(subtract(vector, "_centre"), subtract("_profile", "_centre"))).drop("_centre", "_profile")


def scores_of(rows: DataFrame, queries: DataFrame, vector: str, query: str, out: str = "score", block: int = 1000) -> DataFrame:
    """Every row with every query (a stated set) and the cosine of their vectors, the queries broadcast
    in blocks of ``block``."""
    blocks = max(1, -(-queries.count() // block))
    found = None
    for k in range(blocks):
        part = queries.filter(F.pmod(F.xxhash64(query), F.lit(blocks)) == k) if blocks > 1 else queries
        got = rows.crossJoin(F.broadcast(part)).withColumn(out, cosine(query, vector))
        found = got if found is None else found.unionByName(got)
    return found


#: Distinct scores that one range of ``percentile`` sorts, and up to which they are broadcast (24 bytes each).
RANGE_SCORES, BROADCAST_SCORES = 100_000, 1_000_000


def percentile(df: DataFrame, score: str = "score", out: str = "percentile") -> DataFrame:
    """100 * (rows strictly below) / rows, exactly; a null score gets null.

    What is sorted are the distinct scores with their counts: they are written once, cut into ranges
    by approximate quantiles if they are many, and a range starts from the counts of the ranges
    before it. Up to BROADCAST_SCORES of them (a score of six decimals between 0 and 1 has no more)
    are broadcast, so that no row of ``df`` moves; more are joined by a shuffle, in which null scores
    are dealt to salts, since there may be many.
    """
    counts = cut(df.filter(F.col(score).isNotNull()).groupBy(F.col(score).alias("_at")).count())
    distinct = counts.count()
    ranges = -(-distinct // RANGE_SCORES)
    cuts = sorted(set(counts.approxQuantile("_at", [i / ranges for i in range(1, ranges)], 0.01))) if ranges > 1 else []
    place = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("_at"))) if cuts else F.lit(0)
    ranged = counts.withColumn("_p", place)
    within = Window.partitionBy("_p").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("_below", F.coalesce(F.sum("count").over(within), F.lit(0)))
    # one row a range
    starts = ranged.groupBy("_p").agg(F.sum("count").alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    placed = placed.join(F.broadcast(starts), "_p").select("_at", (F.lit(100.0) * (F.col("_start") + F.col("_below")) / F.col("_all")).alias(out))
    if distinct <= BROADCAST_SCORES:
        return df.join(F.broadcast(placed), F.col(score) == F.col("_at"), "left").drop("_at")
    salted = df.withColumn("_salt", F.when(F.col(score).isNull(), (F.rand(0) * 64).cast("int")).otherwise(0))
    return salted.join(placed.withColumn("_salt0", F.lit(0)), (F.col(score) == F.col("_at")) & (F.col("_salt") == F.col("_salt0")), "left").drop("_at", "_salt", "_salt0")


def remote_bonus(score: Column | str, is_remote: Column | str, bonus: float = 0.02) -> Column:
    return _col(score) + F.when(_col(is_remote), F.lit(bonus)).otherwise(F.lit(0.0))


def to_bytes(v: np.ndarray | list[float]) -> bytes:
    return np.asarray(v, np.float32).tobytes()


def from_bytes(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, np.float32)


@F.pandas_udf(ArrayType(FloatType()))
def unpack(blob: pd.Series) -> pd.Series:
    return blob.map(lambda b: None if b is None else from_bytes(b))


@F.pandas_udf(BinaryType())
def pack(v: pd.Series) -> pd.Series:
    return v.map(lambda x: None if x is None else to_bytes(x))


Encoder = Callable[[list[str]], np.ndarray]


def hashing_encoder(dim: int = 64) -> Encoder:
    """Words hashed to signed dimensions, of length 1: an encoder that needs no weights. Where words
    cancel out, or there are none, the whole text is one word; only blank texts (spaces of any
    width, or nothing) have no length."""

    def add(v: np.ndarray, word: str) -> None:
        h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        v[h % dim] += 1 if h >> 63 else -1

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for v, text in zip(out, texts):
            for w in text.lower().split():
                add(v, w)
            if not v.any() and any(unicodedata.category(c) != "Zs" for c in text):
                add(v, text.lower())
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms == 0, 1, norms)

    return encode


def embed(df: DataFrame, text: str, encoder: Callable[[], Encoder] = hashing_encoder, out: str = "embedding", prefix: str = "", batch: int = 16) -> DataFrame:
    """``df`` with vectors of its texts. ``encoder`` is called once for each task and returns the
    function that encodes a list, ``batch`` texts at a time; if that has a ``close``, it is called
    when the task ends, so that a model's memory is given back."""

    @F.pandas_udf("array<float>")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder()
        try:
            for s in series:
                texts = [prefix + (t or "") for t in s]
                rows = [v for lo in range(0, len(texts), batch) for v in encode(texts[lo : lo + batch])]
                yield pd.Series(rows, index=s.index)
        finally:
            getattr(encode, "close", lambda: None)()

    return df.withColumn(out, run(F.col(text)))
