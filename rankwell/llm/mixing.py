"""Mixing sources to target weights by entropy balancing (Hainmueller, 2012), in built-in
expressions only.

Each source s has a target of T_s words. Among all rates r that fulfil

    sum over the documents i of s of r_i * size_i = T_s   and   0 <= r_i <= CAP,

the mix takes those with the least weighted relative entropy against the rate 1. Their
convex dual has one multiplier a source, and its solution is an exponential tilt,
r_i = min(CAP, exp(lambda_s * z_i)), with z_i = (1 + size_i / (size_i + mean_s)) / 2, so that
long documents answer to the multiplier up to twice as much as short ones. Newton's method
finds lambda_s: the gradient and the curvature of the dual are sums over the documents, taken
in each iteration by partial aggregates over the (source, size) histogram, into which the rows
are aggregated before any shuffle, so that no source is summed in one task. Each step stays in
a bracket that is known to hold the solution (else it halves it), and the iterations end when
every source meets its target.

The rates become whole copies: along the sizes of a source the running sum of rates is
rounded, which makes the count of copies of each size; what then is missing or too much in
words is settled by whole copies from the largest size that fits downward. Which documents of
a size get the odd copies is decided by a hash of the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import n_chunks, table, text_of, written

CAP = 3
#: Iterations at most; a few suffice, and halving the bracket alone would take 60.
NEWTON_STEPS = 100
#: How near the words of the rates have to be to the target, as a share of it.
MET = 1e-9
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP) -> DataFrame:
    """``source, source_size`` with ``target``: all words shared by weight, CAP times at most.

    Sources in the order of code points, null last, weigh ``weights``, repeating. A target
    stops at cap * source_size and the excess is shared anew by weight until none is above:
    target = min(cap * source_size, level * weight). The level follows from the running sums
    in the order of cap * source_size / weight. One row a source, so one task is enough.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    whole = Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    fill = Window.orderBy("_at", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    return (
        sizes.withColumn("_w", weight)
        .withColumn("_at", F.lit(float(cap)) * F.col("source_size") / F.col("_w"))
        .withColumn("_total", F.sum("source_size").over(whole).cast("double"))
        .withColumn("_full", F.coalesce(F.sum(F.lit(float(cap)) * F.col("source_size")).over(fill), F.lit(0.0)))
        .withColumn("_left", F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(fill), F.lit(0.0)))
        # the level if this source and those after it stay below their caps; the first holds
        .withColumn("_level", (F.col("_total") - F.col("_full")) / F.col("_left"))
        .withColumn("_level", F.min(F.when(F.col("_level") <= F.col("_at"), F.struct("_at", F.col("source").isNull().alias("_none"), "source", "_level"))).over(whole)["_level"])
        .withColumn("target", F.when(F.col("_level").isNull() | (F.col("_at") <= F.col("_level")), F.lit(float(cap)) * F.col("source_size")).otherwise(F.col("_level") * F.col("_w")))
        .select("source", "source_size", "target")
    )


def multipliers(hist: DataFrame, cap: int = CAP, steps: int = NEWTON_STEPS, met: float = MET) -> DataFrame:
    """``source, lam``: the multiplier of each source that has words and whose target is below its cap.

    ``hist``: source, size, n, source_size, target, z; a written table. With r = target /
    source_size and z from 1/2 to 1, lam is between ln r and 2 ln r. One row a source is
    written in each iteration. Sums are decimal, so that their order doesn't matter.
    """
    ratio = F.col("target") / F.col("source_size")
    ends = F.log(ratio), 2 * F.log(ratio)
    able = (F.col("source_size") > 0) & (F.col("target") > 0) & (F.col("target") < float(cap) * F.col("source_size"))
    cells = hist.filter(able & (F.col("size") > 0))
    first = cells.select("source", "source_size", "target").distinct().select("source", "target", F.least(*ends).alias("lo"), F.greatest(*ends).alias("hi"), (F.log(ratio) / 0.75).alias("lam"), F.lit(False).alias("done"))
    state = written(first, "newton")
    exact = lambda x: F.sum(x.cast("decimal(38,9)")).cast("double")
    for _ in range(steps):
        open_ = state.filter("NOT done").withColumnRenamed("target", "_target")
        at = cells.alias("c").join(open_.alias("s"), F.col("c.source").eqNullSafe(F.col("s.source")))
        tilt = F.exp(F.col("lam") * F.col("z"))
        words = F.col("size") * F.col("n") * F.least(tilt, F.lit(float(cap)))
        slope = F.when(tilt < cap, F.col("size") * F.col("n") * F.col("z") * tilt).otherwise(F.lit(0.0))
        sums = at.groupBy("c.source", "_target", "lo", "hi", "lam").agg((exact(words) - F.col("_target")).alias("g"), exact(slope).alias("s"))
        sums = sums.withColumn("lo", F.when(F.col("g") <= 0, F.col("lam")).otherwise(F.col("lo"))).withColumn("hi", F.when(F.col("g") > 0, F.col("lam")).otherwise(F.col("hi")))
        newton, middle = F.col("lam") - F.col("g") / F.col("s"), (F.col("lo") + F.col("hi")) / 2
        step = F.when((F.col("s") > 0) & (newton > F.col("lo")) & (newton < F.col("hi")), newton).otherwise(middle)
        done = (F.abs("g") <= met * F.col("_target")) | (F.col("hi") - F.col("lo") <= 1e-15 * F.abs("lam"))
        moved = sums.select("source", F.col("_target").alias("target"), "lo", "hi", F.when(done, F.col("lam")).otherwise(step).alias("lam"), done.alias("done"))
        state = written(state.filter("done").unionByName(moved), "newton")
        if state.filter("NOT done").isEmpty():
            break
    return state.select("source", "lam")


def balance(hist: DataFrame, cap: int = CAP) -> DataFrame:
    """``hist`` (source, size, n, source_size, target) with the ``rate`` of each size.

    A source whose target is its cap has the rate ``cap``, one without words 1, one with the
    target 0 has 0.
    """
    mean = hist.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("_mean")).withColumnRenamed("source", "_s")
    z = F.when(F.col("size") > 0, (1 + F.col("size") / (F.col("size") + F.col("_mean"))) / 2).otherwise(F.lit(0.5))
    hist = written(hist.join(mean, F.col("source").eqNullSafe(F.col("_s"))).withColumn("z", z).drop("_mean", "_s"), "histogram")
    found = multipliers(hist, cap).withColumnRenamed("source", "_s")
    full, none = F.col("target") >= float(cap) * F.col("source_size"), F.col("source_size") == 0
    tilt = F.least(F.exp(F.col("lam") * F.col("z")), F.lit(float(cap)))
    rate = F.when(none, F.lit(1.0)).when(full, F.lit(float(cap))).otherwise(F.coalesce(tilt, F.lit(0.0)))
    return hist.join(found, F.col("source").eqNullSafe(F.col("_s")), "left").withColumn("rate", rate).drop("_s", "lam", "z")


def whole_copies(rated: DataFrame, cap: int = CAP) -> DataFrame:
    """``source, size, n, source_size, target, copies``: whole copies for each size of a source.

    The array that settles a source has an entry for each size that occurs, so its length is
    bounded by the longest document, not by the number of documents.
    """
    down = Window.partitionBy("source").orderBy(F.desc("size"))
    upto = F.sum(F.col("rate") * F.col("n")).over(down.rowsBetween(Window.unboundedPreceding, 0))
    first = rated.withColumn("_w", F.floor(upto + 0.5).cast("long")).withColumn("_before", F.coalesce(F.lag("_w").over(down), F.lit(0)))
    first = first.withColumn("_c", F.least(F.col("_w") - F.col("_before"), F.col("n") * cap)).drop("_w", "_before", "rate")
    zero = F.lit(0).cast("long")
    by = first.groupBy("source").agg(
        F.sort_array(F.collect_list(F.struct("size", "n", "_c")), asc=False).alias("_e"),
        (F.round(F.first("target")).cast("long") - F.sum(F.col("size") * F.col("_c"))).alias("_r"),
    )

    def settle(acc: Column, e: Column) -> Column:
        fits = F.when(e["size"] > 0, F.floor(F.abs(acc["r"]) / F.greatest(e["size"], F.lit(1))).cast("long")).otherwise(zero)
        d = F.when(acc["r"] >= 0, F.least(fits, e["n"] * cap - e["_c"])).otherwise(-F.least(fits, e["_c"]))
        out = F.array_append(acc["out"], F.struct(e["size"].alias("size"), d.alias("d")))
        return F.when(d == 0, acc).otherwise(F.struct((acc["r"] - d * e["size"]).alias("r"), out.alias("out")))

    start = F.struct(F.col("_r").alias("r"), F.array().cast("array<struct<size:bigint,d:bigint>>").alias("out"))
    more = by.select("source", F.explode(F.aggregate("_e", start, settle, lambda a: a["out"])).alias("_x")).select(F.col("source").alias("_s"), F.col("_x.size").alias("_z"), F.col("_x.d").alias("_d"))
    both = first.join(more, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")), "left")
    return both.select("source", "size", "n", "source_size", "target", (F.col("_c") + F.coalesce(F.col("_d"), zero)).alias("copies"))


def _mixed(docs: DataFrame, key: str, weights: tuple[int, ...], cap: int, carry: list[str]) -> DataFrame:
    """``_key, _size, _source_size, _target, _copies`` for every row, and ``carry`` as _carry_0, _carry_1, ..."""
    spark = docs.sparkSession
    body = text_of()
    rows = docs.select(
        F.col(key).alias("_key"),
        F.col("source"),
        F.regexp_count(body, F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(F.col(key), body).alias("_h"),
        *[F.col(f"`{c}`").alias(f"_carry_{k}") for k, c in enumerate(carry)],
    )
    rows = written(rows, "mix")  # the words of a text are counted once
    chunks = n_chunks(spark, rows.count())
    rows = rows.withColumn("_c", F.pmod(F.col("_h"), F.lit(chunks)).cast("int"))
    cells = rows.groupBy("source", "size", "_c").agg(F.count("*").alias("_n"))
    hist = cells.groupBy("source", "size").agg(F.sum("_n").alias("n"))
    sizes = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    aims = targets(sizes, weights, cap)
    same = hist["source"].eqNullSafe(aims["source"])
    copies = whole_copies(balance(hist.join(aims, same).drop(aims["source"]), cap), cap)
    before = Window.partitionBy("source", "size").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    plan = (
        cells.alias("a")
        .join(copies.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.size") == F.col("b.size")))
        .select("a.source", "a.size", "a._c", "_first", "source_size", "target", F.floor(F.col("copies") / F.col("n")).cast("long").alias("_base"), (F.col("copies") % F.col("n")).alias("_odd"))
    )
    rank = Window.partitionBy("source", "size", "_c").orderBy("_h", "_key")
    placed = rows.withColumn("_k", F.row_number().over(rank))
    both = placed.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.size") == F.col("p.size")) & (F.col("d._c") == F.col("p._c")))
    n = F.col("_base") + F.when(F.col("_first") + F.col("_k") <= F.col("_odd"), 1).otherwise(0)
    return both.select("_key", F.col("d.size").alias("_size"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), n.alias("_copies"), *[f"_carry_{k}" for k in range(len(carry))])


def mix(docs: DataFrame, key: str = "doc_id", weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP) -> DataFrame:
    """``key, size, source_size, target, copies, taken`` for every row of ``docs``.

    ``size`` counts the words of the text (null: none), ``taken`` = size * copies are the words
    the mix takes. A null source is a source of its own; texts without words take 0 words
    (their copies follow the tilt). Repeated rows are documents of their own; equal rows may
    swap copies, which changes no row of the result. A source without words has the target 0.
    An empty table gives no rows. Other columns, also of the names made here, are left out.
    """
    got = _mixed(docs, key, weights, cap, [])
    return got.select(F.col("_key").alias(key), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_copies").alias("copies"), (F.col("_size") * F.col("_copies")).alias("taken"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the weights 1, 2, 3, repeating over the sources."""
    return mix(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document, with all its columns, as often as the mix takes it; those it
    doesn't take go.

    Sizes, targets and copies are those of ``mix``: a null source is a source of its own, null and empty
    texts have no words and follow the tilt of their source, repeated rows are documents of their own, an
    empty table stays empty. All columns stay as they are, whatever their names.
    """
    rest = [c for c in docs.columns if c != "doc_id"]
    taken = _mixed(docs, "doc_id", (1, 2, 3), CAP, rest)
    names = {"doc_id": "_key"} | {c: f"_carry_{k}" for k, c in enumerate(rest)}
    copy = F.explode(F.array_repeat(F.lit(1), F.col("_copies").cast("int")))
    return taken.withColumn("_copy", copy).select(*[F.col(names[c]).alias(c) for c in docs.columns])
