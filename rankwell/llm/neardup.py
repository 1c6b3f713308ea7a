"""Near-duplicates by improved consistent weighted sampling (Ioffe, 2010), banded, verified.

A text is the weighted set of its shingles of five words: the weight of a shingle is its
occurrences in the text times an inverse document frequency, which is counted over all
documents in a table of hashed counters, less what other shingles add to a counter on
average, so that a fixed table does for any corpus. It is damped (see ``IDF``), so that
documents of a group of thousands of copies, whose shingles are frequent, still count as alike.

Sampling: for each of SAMPLES draws, a hash of the shingle picks its random variables (two
gamma, one uniform) from a table of 2**16; the shingle with the least a = c / (y e^r) is the
sample. Two texts have the same sample with a probability equal to their weighted Jaccard
similarity. Samples are joined to BANDS of ROWS; texts that agree in a band are candidates.

Verification: within a bucket, texts are compared with its leader. Those that are then not
connected to the leader are compared with all texts of the bucket, in blocks, the ones that
the leader has taken included. So every two texts that share a bucket end up connected or
compared, in buckets of any size; the copies of a large group take a comparison each.

Texts, not documents, are compared: equal texts are one. Classes are the connected parts of
the links between texts, found by contraction in tables; nothing about single documents
reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, text_of, unused, written
from .subwords import Subwords

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 20, 6
SAMPLES = BANDS * ROWS
#: A shingle weighs from 1 (in all documents) to 1 + IDF (in one).
IDF = 0.25
#: Counters for document frequencies.
COUNTERS_BITS = 18
#: Draws take weights as powers of STEP, verification takes them as they are. The draws of the first LEVELS powers are
#: held in a table, those of higher ones are computed.
STEP, LEVELS = 1.05, 128
#: Texts, and bytes of their packed sets, in a block of a bucket; buckets have as many blocks as they need.
BLOCK_TEXTS, BLOCK_BYTES = 256, 1 << 20
#: Ids up to this number may be broadcast (8 bytes each).
BROADCAST_IDS = 200_000
BATCH = 300_000


def shingle_hashes(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text, the hashes of its shingles in ascending order, and their occurrences.

    Words are runs of letters and digits in lower case. A text of fewer than five words, but
    not none, is one shingle.
    """
    h, owner = Subwords(lower=True, letters=True).word_hashes(texts)
    cut = np.searchsorted(owner, np.arange(len(texts) + 1))
    out = []
    for i in range(len(texts)):
        w = h[cut[i] : cut[i + 1]]
        k = min(WORDS, len(w))
        if not k:
            out.append((np.zeros(0, np.uint64), np.zeros(0, np.int64)))
            continue
        n = len(w) - k + 1
        s = np.full(n, np.uint64(k), np.uint64)
        for j in range(k):
            s = (s ^ w[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
            s ^= s >> np.uint64(32)
        out.append(np.unique(s, return_counts=True))
    return out


def groups_of(texts: list[str], most: int = BATCH) -> Iterator[tuple[int, int]]:
    """Slices of the texts with about ``most`` code points each."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """The hashed counters of shingles over all documents, and the number of documents.

    Each task adds up its documents in one array of a fixed size.
    """
    width = 1 << COUNTERS_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, n = np.zeros(width, np.int64), 0
        for batch in batches:
            texts = batch.column("text").to_pylist()
            n += len(texts)
            for lo, hi in groups_of(texts):
                got = [s for s, _ in shingle_hashes(texts[lo:hi])]
                bins += np.bincount((np.concatenate(got) >> np.uint64(64 - COUNTERS_BITS)).astype(np.int64), minlength=width)
        at = np.flatnonzero(bins)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(bins[at], n), pa.int64())], names=["bin", "n"])

    got = docs.select(text_of().alias("text")).mapInArrow(count, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()
    at, n = np.asarray(got.column("bin")), np.asarray(got.column("n"))
    out = np.zeros(width, np.int64)
    out[at[at >= 0]] = n[at >= 0]
    return less_load(out), int(n[at < 0].sum())


def less_load(counters: np.ndarray) -> np.ndarray:
    """The counters less their mean, which is about what the other shingles of a counter add to it."""
    return np.maximum(counters - int(counters.sum()) // len(counters), 0)


def weights(hashes: np.ndarray, times: np.ndarray, counters: np.ndarray, documents: int) -> np.ndarray:
    """The weight of each shingle."""
    df = counters[(hashes >> np.uint64(64 - COUNTERS_BITS)).astype(np.int64)]
    idf = np.log((documents + 1) / np.minimum(df + 1, documents + 1)) / np.log(documents + 2)
    return times * (1 + IDF * idf)


def levels(hashes: np.ndarray, times: np.ndarray, counters: np.ndarray, documents: int) -> np.ndarray:
    """The weight of each shingle as the nearest power of STEP, for the draws."""
    return np.rint(np.log(weights(hashes, times, counters, documents)) / np.log(STEP)).astype(np.int64)


@lru_cache(maxsize=1)
def variables() -> tuple[np.ndarray, ...]:
    """The random variables r, c and b of each table entry, and the multipliers that pick the entries of the draws."""
    rng = np.random.default_rng(2010)
    r, c, b = rng.gamma(2, 1, 1 << 16), rng.gamma(2, 1, 1 << 16), rng.random(1 << 16)
    return r, c, b, rng.integers(1 << 62, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def coded(level: int | np.ndarray, at: np.ndarray | slice = slice(None)) -> np.ndarray:
    """ln a of the entries ``at`` at their levels, in an order-preserving code of 32 bits."""
    r, c, b = (x[at] for x in variables()[:3])
    t = np.floor(level * np.log(STEP) / r + b)
    a = (np.log(c) - r * (t - b) - r).astype(np.float32).view(np.uint32)
    return np.where(a >> 31, ~a, a | np.uint32(1 << 31))


@lru_cache(maxsize=1)
def draws() -> tuple[np.ndarray, np.ndarray]:
    """The codes of all entries at the first LEVELS levels, and the multipliers."""
    code = np.empty((LEVELS, 1 << 16), np.uint32)
    for level in range(LEVELS):
        code[level] = coded(level)
    return code, variables()[3]


def band_keys(sets: list[tuple[np.ndarray, np.ndarray]], counters: np.ndarray, documents: int) -> np.ndarray:
    """BANDS keys for each set (texts without words: none of them, all keys 0)."""
    out = np.zeros((len(sets), BANDS), np.uint64)
    some = [i for i, (s, _) in enumerate(sets) if len(s)]
    if not some:
        return out
    code, multipliers = draws()
    h = np.concatenate([sets[i][0] for i in some])
    level = levels(h, np.concatenate([sets[i][1] for i in some]), counters, documents)
    starts = np.concatenate([[0], np.cumsum([len(sets[i][0]) for i in some])[:-1]])
    flat, base, above = code.ravel(), np.minimum(level, LEVELS - 1) << 16, np.flatnonzero(level >= LEVELS)
    low = (h ^ (h >> np.uint64(29))) & np.uint64(0xFFFFFFFF)
    for k in range(SAMPLES):
        at = ((h * multipliers[k]) >> np.uint64(48)).astype(np.int64)
        drawn = flat[base + at]
        if len(above):
            drawn[above] = coded(level[above], at[above])
        key = np.minimum.reduceat((drawn.astype(np.uint64) << np.uint64(32)) | low, starts)
        band = k // ROWS
        mixed = (out[some, band] ^ key) * np.uint64(0x9E3779B97F4A7C15)
        out[some, band] = mixed ^ (mixed >> np.uint64(32))
    out[some] = (out[some] & ~np.uint64(31)) | np.arange(BANDS, dtype=np.uint64)
    return out


def similarity(a: bytes, b: bytes) -> float:
    """The weighted Jaccard similarity of two packed sets."""
    (ha, wa), (hb, wb) = unpack(a), unpack(b)
    _, i, j = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    both = np.minimum(wa[i], wb[j]).sum()
    whole = wa.sum() + wb.sum() - both
    return float(both / whole) if whole else 0.0


def pack(hashes: np.ndarray, weight: np.ndarray) -> bytes:
    """Six bytes of each hash, then four of each weight."""
    return (hashes >> np.uint64(16)).astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :6].tobytes() + weight.astype(np.float32).tobytes()


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(blob) // 10
    six = np.zeros((n, 8), np.uint8)
    six[:, :6] = np.frombuffer(blob, np.uint8, 6 * n).reshape(n, 6)
    return six.view(np.uint64).ravel(), np.frombuffer(blob[6 * n :], np.float32).astype(np.float64)


def verify(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The ``pairs`` (a, b; a written table) that are as alike as ``threshold``."""
    if pairs.count() * 2 <= BROADCAST_IDS:
        needed = pairs.select(F.explode(F.array("a", "b")).alias("t")).distinct()
        sets = sets.join(F.broadcast(needed), "t", "left_semi")
    both = pairs.join(sets.select(F.col("t").alias("b"), F.col("packed").alias("pb")), "b").join(sets.select(F.col("t").alias("a"), F.col("packed").alias("pa")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            ok = [similarity(p, q) >= threshold - 1e-9 for p, q in zip(x.column("pa").to_pylist(), x.column("pb").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([x.column("a"), x.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return written(both.select("a", "b", "pa", "pb").mapInArrow(run, "a long, b long"), "verified")


def components(edges: DataFrame) -> DataFrame:
    """``t, c``: for each end of an edge (a, b; a written table), the least id of its connected part.

    In each round an id takes the least label among itself and its neighbours, and then that
    label's own label, which doubles the reach; it ends when no label changes.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    now = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("t"), F.least("a", "m").alias("c")), "labels")
    while True:
        seen = both.join(now.select(F.col("t").alias("b"), F.col("c").alias("l")), "b").groupBy("a").agg(F.min("l").alias("l"))
        least = now.join(seen, now["t"] == seen["a"]).select("t", F.col("c").alias("_old"), F.least("c", "l").alias("m"))
        next_ = least.join(now.select(F.col("t").alias("m"), F.col("c").alias("_c")), "m").select("t", F.least("m", "_c").alias("c"), "_old")
        now_ = written(next_, "labels")
        now = now_.select("t", "c")
        if now_.filter("c <> _old").isEmpty():
            return now


class _Parts:
    """The connected parts found so far."""

    def __init__(self) -> None:
        self.of: DataFrame | None = None

    def root(self, df: DataFrame, col: str, out: str) -> DataFrame:
        if self.of is None:
            return df.withColumn(out, F.col(col))
        got = df.join(self.of.select(F.col("t").alias(col), F.col("c").alias(out)), col, "left")
        return got.withColumn(out, F.coalesce(out, col))

    def apart(self, pairs: DataFrame) -> DataFrame:
        return self.root(self.root(pairs, "a", "_ra"), "b", "_rb").filter("_ra <> _rb").drop("_ra", "_rb")

    def add(self, edges: DataFrame) -> None:
        """Links of a written table."""
        if self.of is None:
            if not edges.isEmpty():
                self.of = components(edges)
            return
        roots = self.root(self.root(edges.select("a", "b"), "a", "_ra"), "b", "_rb").select(F.col("_ra").alias("a"), F.col("_rb").alias("b")).filter("a <> b").distinct()
        roots = written(roots, "roots")
        if roots.isEmpty():
            return
        more = components(roots)
        old = self.of.join(more.select(F.col("t").alias("c"), F.col("c").alias("d")), "c", "left").select("t", F.coalesce("d", "c").alias("c"))
        new = more.join(self.of.select("t"), "t", "left_anti")
        self.of = written(old.unionByName(new), "parts")


def linked(ids: list[int], packed: list[bytes], part: list[int], block: list[int], i: int, j: int, threshold: float) -> list[tuple[int, int]]:
    """Links between the texts of block ``i`` and those of block ``j`` (or among those of one
    block) that connect all of these parts which any such link connects."""
    got = [unpack(p) for p in packed]
    sizes = np.array([len(h) for h, _ in got])
    number = np.unique(np.concatenate([h for h, _ in got]), return_inverse=True)[1]
    cut = np.concatenate([[0], np.cumsum(sizes)])
    label = np.unique(part, return_inverse=True)[1]
    sums = np.array([w.sum() for _, w in got])
    at, own = np.array(block), np.zeros(len(number))
    right = np.flatnonzero(at == j)
    out: list[tuple[int, int]] = []
    if not len(right):
        return out
    shingles = np.concatenate([number[cut[y] : cut[y + 1]] for y in right])
    theirs = np.concatenate([got[y][1] for y in right])
    starts = np.concatenate([[0], np.cumsum(sizes[right])[:-1]])
    for x in np.flatnonzero(at == i):
        if (label[right] == label[x]).all():
            continue
        mine = number[cut[x] : cut[x + 1]]
        own[mine] = got[x][1]
        both = np.add.reduceat(np.minimum(theirs, own[shingles]), starts)
        own[mine] = 0
        alike = both >= (threshold - 1e-9) * (sums[x] + sums[right] - both)
        for y in right[alike]:
            if label[y] != label[x]:
                out.append((ids[x], ids[y]))
                label[label == label[y]] = label[x]
    return out


def among(rows: DataFrame, far: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links of the ``far`` texts (bucket, t) with all texts of their buckets (``rows`` with
    their part c): enough of them to connect what any of these links connects.

    Far and other texts of a bucket are dealt to blocks by hash; each block of far ones meets
    all blocks. Two texts that aren't far are connected to the leader both, and don't meet.
    """
    mark = far.select("bucket", "t", F.lit(True).alias("far"))
    members = rows.join(far.select("bucket").distinct(), "bucket", "left_semi").join(mark, ["bucket", "t"], "left").withColumn("far", F.coalesce("far", F.lit(False)))
    held = written(members.join(sets, "t"), "members")
    blocks = lambda own: F.ceil(F.greatest(F.sum(own.cast("long")) / BLOCK_TEXTS, F.sum(F.when(own, F.octet_length("packed")).otherwise(0)) / BLOCK_BYTES)).cast("int")
    size = held.groupBy("bucket").agg(blocks(F.col("far")).alias("kf"), blocks(~F.col("far")).alias("kn"))
    draw = F.xxhash64("t", F.lit("block"))
    place = F.when(F.col("far"), F.pmod(draw, "kf")).otherwise(F.col("kf") + F.pmod(draw, F.greatest("kn", F.lit(1)))).cast("int")
    placed = held.join(size, "bucket").withColumn("block", place)
    others = F.sequence(F.lit(0), F.when(F.col("far"), F.col("kf") + F.col("kn")).otherwise(F.col("kf")) - 1)
    meets = placed.withColumn("other", F.explode(others)).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))

    def run(key: tuple, x: pa.Table) -> pa.Table:
        got = linked(*(x.column(c).to_pylist() for c in ("t", "packed", "c", "block")), key[1].as_py(), key[2].as_py(), threshold)
        return pa.table({"a": pa.array([a for a, _ in got], pa.int64()), "b": pa.array([b for _, b in got], pa.int64())})

    meets = meets.select("bucket", "i", "j", "block", "t", "c", "packed")
    return written(meets.groupBy("bucket", "i", "j").applyInArrow(run, "a long, b long"), "linked")


def links(rows: DataFrame, sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame | None:
    """``t, c`` for the texts that are like another. ``rows`` are (bucket, t) of the buckets
    with more than one text, ``sets`` the packed sets.

    The leader of a bucket is the text of the least hash of text and bucket, so that a large
    group of like texts has another leader in each band. First each text is compared with the
    leader it shares most buckets with; that settles most. Texts that then are apart from
    leaders are compared with the one they share most buckets with of these, and with the
    other text of buckets of two. Those that are still apart from the leader of a larger
    bucket are compared with all its texts. That settles every pair that shares a bucket: it
    is compared, or both are connected to the leader.
    """
    parts = _Parts()
    lead = rows.groupBy("bucket").agg(F.min_by("t", F.xxhash64("t", "bucket")).alias("b"), F.count(F.lit(1)).alias("n"))
    led = written(rows.join(lead, "bucket").filter("t <> b").select("bucket", F.col("t").alias("a"), "b", "n"), "led")
    best = lambda df: df.groupBy("a", "b").count().groupBy("a").agg(F.max(F.struct("count", F.col("b")))["b"].alias("b"))
    parts.add(verify(written(best(led), "pairs"), sets, threshold))
    apart = written(parts.apart(led), "apart")
    if apart.isEmpty():
        return parts.of
    pairs = best(apart.filter("n > 2")).unionByName(apart.filter("n = 2").select("a", "b")).distinct()
    parts.add(verify(written(pairs, "pairs"), sets, threshold))
    far = written(parts.apart(apart.filter("n > 2")).select("bucket", F.col("a").alias("t")), "far")
    if not far.isEmpty():
        parts.add(among(parts.root(rows, "t", "c"), far, sets, threshold))
    return parts.of


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, text_id, class_id, class_size, kept`` for every document.

    ``class_id`` is the least doc_id of the class, ``class_size`` the number of its rows,
    ``kept`` true for one row's doc_id and text (that of the least doc_id, null last).
    Null and empty texts are equal texts; texts without words are alike only if equal. Rows
    that repeat doc_id and text are all kept or none is. An empty table gives no rows; other
    columns are left out. ``text_id`` is a hash of 64 bits of the text.
    """
    spark = docs.sparkSession
    counters, documents = document_frequencies(docs)
    held = spark.sparkContext.broadcast((counters, documents))
    ident = F.xxhash64(F.md5(text_of().cast("binary")), F.octet_length(text_of()))
    source = docs.select("doc_id", text_of().alias("text"), ident.alias("t"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, documents = held.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for lo, hi in groups_of(texts):
                keys = band_keys(shingle_hashes(texts[lo:hi]), counters, documents).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), pa.array(keys.ravel(), pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), batch.column("t").slice(lo, hi - lo), lists], names=["doc_id", "t", "keys"])

    schema = docs.select("doc_id", F.lit(0).cast("long").alias("t"), F.array(F.lit(0).cast("long")).alias("keys")).schema
    signed = written(source.mapInArrow(sign, schema), "signed")
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"))
    texts = written(signed.groupBy("t").agg(F.min(first)["doc_id"].alias("doc_id"), F.count("*").alias("n"), F.first("keys").alias("keys")), "texts")
    bands = texts.select("t", F.explode("keys").alias("bucket")).filter("bucket <> 0")
    many = bands.groupBy("bucket").count().filter("count > 1").select("bucket")
    rows = written(bands.join(many, "bucket"), "rows")
    alike = None
    if not rows.isEmpty():
        wanted = rows.select("t").distinct().join(texts.select("t", F.col("doc_id").alias("_id")), "t")
        one = source.join(wanted, "t").filter(F.col("doc_id").eqNullSafe(F.col("_id"))).select("t", "text")

        def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counters, documents = held.value
            for batch in batches:
                texts = batch.column("text").to_pylist()
                for lo, hi in groups_of(texts):
                    sets = [pack(h, weights(h, n, counters, documents)) for h, n in shingle_hashes(texts[lo:hi])]
                    yield pa.RecordBatch.from_arrays([batch.column("t").slice(lo, hi - lo), pa.array(sets, pa.binary())], names=["t", "packed"])

        sets = written(one.mapInArrow(make, "t long, packed binary"), "sets")
        alike = links(rows, sets, threshold)
    known = texts.select("t", "doc_id", "n")
    known = known.join(alike, "t", "left").withColumn("c", F.coalesce("c", "t")) if alike is not None else known.withColumn("c", F.col("t"))
    known = written(known, "known")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")
    classes = known.groupBy("c").agg(F.min(order).alias("m"), F.sum("n").alias("class_size"))
    by_text = known.select("t", "c").join(classes, "c").select("t", F.col("m.doc_id").alias("class_id"), F.col("m.t").alias("_kept"), "class_size")
    got = signed.select("doc_id", "t").join(by_text, "t")
    kept = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("t") == F.col("_kept"))
    return got.select("doc_id", F.col("t").alias("text_id"), "class_id", "class_size", kept.alias("kept"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the class of near-duplicates that they are in."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each class one document stays, that of the least doc_id.

    Null and empty texts are equal texts, so one of them stays; a null doc_id comes after all others; of rows
    that repeat doc_id and text one stays; an empty table stays empty. All columns stay as they are,
    whatever their names, nulls in them too.
    """
    found = written(near_duplicates(docs).filter("kept").select(F.col("doc_id").alias("_id"), F.col("text_id").alias("_t")), "kept")
    ident = F.xxhash64(F.md5(F.coalesce(docs["text"], F.lit("")).cast("binary")), F.octet_length(F.coalesce(docs["text"], F.lit(""))))
    left = docs.join(found.distinct(), ident.eqNullSafe(found["_t"]) & docs["doc_id"].eqNullSafe(found["_id"]), "left_semi")
    # rows that repeat doc_id and text: one of them
    if found.groupBy("_id", "_t").count().filter("count > 1").isEmpty():
        return left
    text = unused(docs, "_text_id")
    return left.withColumn(text, F.xxhash64(F.md5(text_of().cast("binary")), F.octet_length(text_of()))).dropDuplicates(["doc_id", text]).drop(text)
