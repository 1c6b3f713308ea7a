"""Joins beyond equality: containment, extracted keys, intervals, as-of."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, NumericType

from ..schema import unused
from ..session import cut, estimated_bytes

#: Words of a text or needle: what stands between blanks.
BLANK = r"\s+"


#: Letters of the pieces that words are searched by; shorter needles are their own piece.
GRAM = 3


def _pieces(word: Column, n: int) -> Column:
    """The distinct pieces of ``n`` code points of a word."""
    starts = F.when(F.length(word) >= n, F.sequence(F.lit(1), F.length(word) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(word, i, F.lit(n))))


def words_within(words: DataFrame, parts: DataFrame) -> DataFrame:
    """``no, _w``: the words (``_w``) that contain a part (``no``, ``part``; not empty), found by equality of pieces.

    A part's key is the rarest of its pieces of GRAM code points, counted over the words (a shorter
    part is one piece), so a piece that all words share is nobody's key.
    """
    sizes = range(1, GRAM + 1)
    of_part = F.when(F.length("part") >= GRAM, _pieces(F.col("part"), GRAM)).otherwise(F.array("part"))
    wanted = parts.select("no", "part", F.explode(of_part).alias("piece"))
    at = words.select("_w", F.explode(F.flatten(F.array(*[_pieces(F.col("_w"), n) for n in sizes]))).alias("piece"))
    at = at.join(wanted.select("piece").distinct(), "piece", "left_semi")
    often = at.groupBy("piece").agg(F.count(F.lit(1)).alias("_n"))
    # a piece that no word has decides as well: its part is in no word
    key = wanted.join(often, "piece", "left").groupBy("no", "part").agg(F.min_by("piece", F.struct(F.coalesce("_n", F.lit(0)), "piece")).alias("piece"))
    return at.join(key, "piece").filter(F.contains("_w", "part")).select("no", "_w")


def contains_join(texts: DataFrame, needles: DataFrame, text: str, needle: str) -> DataFrame:
    """Pairs of a text and a needle in it.

    A needle's inner words (all but the first and the last) are words of any text that holds
    it, so its rarest inner word, by the texts that hold it, is an equality key; only what
    shares that word is compared. Needles of up to two words have no inner word: their longest
    word lies within some word of the text, and the distinct words of the texts are searched
    for it by their pieces. A needle that is null or holds no word is in no text.

    The texts are read once for the keys: the distinct words of each that some needle needs are
    written, all of its words only if there are needles without an inner one.
    """
    t, n = unused(texts, "_text_no"), unused(needles, "_needle_no")
    left = texts.withColumn(t, F.xxhash64(text)).filter(F.col(text).isNotNull())
    right = needles.withColumn(n, F.xxhash64(needle)).filter(F.col(needle).isNotNull())
    said = right.select(n, F.col(needle).alias("_needle")).distinct().withColumn("_all", F.split("_needle", BLANK))
    inner = F.filter(F.slice("_all", 2, F.greatest(F.size("_all") - 2, F.lit(0))), lambda w: w != "")
    longest = F.element_at(F.array_sort("_all", lambda a, b: F.length(a) - F.length(b)), -1)
    said = cut(said.select(n, F.array_distinct(inner).alias("_inner"), longest.alias("_long")))
    wanted = said.select(n, F.explode("_inner").alias("_w"))
    short = said.filter((F.size("_inner") == 0) & (F.col("_long") != "")).select(F.col(n).alias("no"), F.col("_long").alias("part"))
    words = left.select(t, F.explode(F.array_distinct(F.split(F.col(text), BLANK))).alias("_w"))
    some_short = bool(short.head(1))
    words = cut(words if some_short else words.join(wanted.select("_w").distinct(), "_w", "left_semi"))
    often = words.join(wanted.select("_w").distinct(), "_w", "left_semi").groupBy("_w").agg(F.count(F.lit(1)).alias("_n"))
    # a word that no text has decides as well: its needle is in no text
    rarest = wanted.join(often, "_w", "left").groupBy(n).agg(F.min_by("_w", F.struct(F.coalesce("_n", F.lit(0)), "_w")).alias("_w"))
    found = words.join(rarest, "_w").select(t, n)
    if some_short:
        held = words_within(words.select("_w").distinct(), short)
        found = found.unionByName(words.join(held, "_w").select(t, F.col("no").alias(n)))
    both = left.join(found.distinct(), t).join(right, n)
    return both.filter(F.contains(F.col(text), F.col(needle))).drop(t, n)


def extracted_key_join(left: DataFrame, text: str, pattern: str, right: DataFrame, key: str, winner: str) -> DataFrame:
    """Equality on a number out of a text; of several rows of a key the one of the largest ``winner``."""
    w = Window.partitionBy(key).orderBy(F.desc(winner))
    best = right.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    return left.join(best, F.regexp_extract(text, pattern, 1).try_cast("long") == F.col(key))


#: Rows of a stretch of time; tables that Spark estimates below SMALL bytes are one stretch.
STRETCH, SMALL = 200_000, 64 << 20


def _number(time: str, kind: DataType) -> Column:
    c = F.col(time)
    return (c if isinstance(kind, NumericType) else F.unix_micros(c.cast("timestamp"))).cast("double")


def _stretch(times: list[tuple[DataFrame, str]], per: int | None) -> Callable[[DataFrame, str], Column]:
    """Cuts time into stretches of about ``per`` rows: a function that gives a row's stretch.

    All keys share the cuts, which follow the times of all rows, so a key with most of the rows is
    in as many stretches as it fills.
    """
    per, cuts = per or STRETCH, []
    small = sum(estimated_bytes(df) for df, _ in times) < SMALL
    if per != STRETCH or not small:
        at = reduce(DataFrame.unionByName, [df.select(_number(c, df.schema[c].dataType).alias("at")) for df, c in times]).filter("at IS NOT NULL")
        n = -(-at.count() // per)
        cuts = sorted(set(at.approxQuantile("at", [i / n for i in range(1, n)], 0.1 / n))) if n > 1 else []
    known = F.array(*[F.lit(c) for c in cuts]) if cuts else None

    def of(df: DataFrame, time: str) -> Column:
        if known is None:
            return F.lit(0)
        at = _number(time, df.schema[time].dataType)
        steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))])
        return F.aggregate(steps, F.lit(0), lambda i, s: F.when(F.get(known, i + s - 1) < at, i + s).otherwise(i))

    of.one = known is None
    return of


def _same(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[f"_{k}_"]) for k in names])


def _before(ends: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """``ends`` (a row for each key and stretch, ``_c``) with ``_carry``: ``value`` over the stretches before; keys renamed."""
    w = Window.partitionBy(*keys).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    got = ends.withColumn("_carry", value.over(w))
    return got.select(*[F.col(k).alias(f"_{k}_") for k in [*keys, "_c"]], "_carry")


def numbered(df: DataFrame, keys: list[str], order: list[str], number: str, per: int | None = None) -> DataFrame:
    """``df`` with each row's number, from 1, within its keys in the order of the columns ``order``, the
    first of them a time. Rows are numbered within stretches, and a stretch goes on from the counts of
    those before it, so a hot key is many tasks."""
    of = _stretch([(df, order[0])], per)
    rows = df.withColumn("_c", of(df, order[0]))
    rows = rows.withColumn(number, F.row_number().over(Window.partitionBy(*keys, "_c").orderBy(*order)).cast("long"))
    if of.one:
        return rows.drop("_c")
    base = _before(rows.groupBy(*keys, "_c").agg(F.count(F.lit(1)).alias("_n")), keys, F.sum("_n"))
    got = rows.join(base, _same(rows, base, [*keys, "_c"]), "left")
    return got.withColumn(number, F.col(number) + F.coalesce("_carry", F.lit(0))).select(*df.columns, number)


def interval_unique(a: DataFrame, b: DataFrame, keys: list[str], time: str, width: int, ident: str, other: str, itself: bool = False, per: int | None = None) -> DataFrame:
    """``ident, other`` where exactly one row of ``b`` has the same keys and a time (a number) within
    ``width``. ``itself``: each row of ``a`` is one of ``b`` too, by its ident, and doesn't count.

    The rows of ``b`` are numbered by time. How many are near is the difference of the numbers that
    are reached at the two ends of the interval, two lookups on the time line; the near row is the
    one of that number. No row meets more than two others, and no key is one task (see ``numbered``).
    """
    right = b.select(*keys, F.col(time).cast("long").alias("_t"), F.col(other).alias("_id")).filter("_t IS NOT NULL")
    right = numbered(right, keys, ["_t", "_id"], "_no", per)
    left = a.select(*keys, F.col(ident).alias(ident), F.explode(F.array(F.lit(width), F.lit(-width - 1))).alias("_d"), F.col(time).cast("long").alias("_t")).filter("_t IS NOT NULL")
    left = left.withColumn("_t", F.col("_t") + F.col("_d"))
    reached = asof_latest(left, right, keys, "_t", "_t", "_no", per)
    ends = reached.groupBy(*keys, ident).agg(F.max(F.when(F.col("_d") >= 0, F.col("_no"))).alias("_upto"), F.coalesce(F.max(F.when(F.col("_d") < 0, F.col("_no"))), F.lit(0)).alias("_before"))
    near = ends.filter(F.col("_upto") - F.col("_before") == (2 if itself else 1))
    near = near.select(*keys, ident, F.explode(F.sequence(F.col("_before") + 1, F.col("_upto"))).alias("_no"))
    got = near.join(right.select(*keys, "_no", F.col("_id").alias(other)), [*keys, "_no"])
    return (got.filter(F.col(ident) != F.col(other)) if itself else got).select(ident, other)


def asof_latest(a: DataFrame, b: DataFrame, keys: list[str], ta: str, tb: str, value: str, per: int | None = None) -> DataFrame:
    """``a`` with the ``value`` of the latest row of ``b`` of the same keys, not after its time.

    Both sides are laid on one time line for each key; one sort takes the place of a range
    join. Ties in ``b`` go to the larger value; null values, and rows of ``b`` without a time, don't
    count. Where the tables are large, the time line is cut into stretches that are sorted apart,
    and the last value of each is carried into those after it, so that a key with most of the
    rows is many tasks.
    """
    of = _stretch([(a, ta), (b, tb)], per)
    cols = [c for c in a.columns if c not in keys]
    left = a.withColumn("_c", of(a, ta)).select(*keys, "_c", F.col(ta).alias("_t"), F.lit(1).alias("_side"), F.struct(*cols).alias("_row"), F.lit(None).cast(b.schema[value].dataType).alias("_v"))
    right = b.filter(F.col(tb).isNotNull()).withColumn("_c", of(b, tb)).select(*keys, "_c", F.col(tb).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), F.col(value).alias("_v"))
    w = Window.partitionBy(*keys, "_c").orderBy("_t", "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right).withColumn("_last", F.last("_v", ignorenulls=True).over(w)).filter("_side = 1")
    if not of.one:
        ends = right.filter("_v IS NOT NULL").groupBy(*keys, "_c").agg(F.max(F.struct("_t", "_v"))["_v"].alias("_end"))
        marks = left.select(*keys, "_c").distinct().withColumn("_end", F.lit(None).cast(b.schema[value].dataType))
        each = ends.unionByName(marks).groupBy(*keys, "_c").agg(F.max("_end").alias("_end"))
        carry = _before(each, keys, F.last("_end", ignorenulls=True))
        both = both.join(carry, _same(both, carry, [*keys, "_c"]), "left").withColumn("_last", F.coalesce("_last", "_carry"))
    return both.select(*keys, "_row.*", F.col("_last").alias(value))


def best_by_time(candidates: DataFrame, keys: list[str], sent: str, received: str, ident: str) -> DataFrame:
    """Of each key's candidates the one whose send time explains the message best: sent before
    it, the latest; then sent after it, the earliest; never sent last. Ties: the least id."""
    s, r = F.col(sent), F.col(received)
    cls = F.when(s.isNull(), 0).when(r.isNotNull() & (s > r), 1).otherwise(2)
    seconds = F.unix_micros(s.cast("timestamp"))
    order = F.when(cls == 1, -seconds).otherwise(F.coalesce(seconds, F.lit(0)))
    w = Window.partitionBy(*keys).orderBy(cls.desc(), order.desc(), F.asc(ident))
    return candidates.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
