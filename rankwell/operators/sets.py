"""Sinks and set operations as frames: a new snapshot or the rows to write, nothing in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def new_only(batch: DataFrame, known: DataFrame, key: str, position: list[Column] | None = None) -> DataFrame:
    """Rows of a batch whose key isn't known, the first of each key."""
    w = Window.partitionBy(key).orderBy(*(position or [F.col(key)]))
    first = batch.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    return first.join(known.select(key).distinct(), key, "left_anti")


def insert_or_ignore(table: DataFrame, batch: DataFrame, key: str, position: list[Column] | None = None) -> DataFrame:
    """The table with the new rows of the batch; rows of known keys are ignored."""
    return table.unionByName(new_only(batch, table, key, position))


def fill_missing(table: DataFrame, updates: DataFrame, key: str, column: str) -> DataFrame:
    """Update where null: a value that is there already wins; of several updates the least."""
    u = updates.groupBy(key).agg(F.min(column).alias("_new"))
    return table.join(u, key, "left").withColumn(column, F.coalesce(F.col(column), F.col("_new"))).drop("_new")


def changed(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of ``new`` of which a column differs from ``old``, null and null being equal."""
    o = old.select(key, *[F.col(c).alias(f"_old_{c}") for c in columns])
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_old_{c}"))
    return new.join(o, key).filter(~same).drop(*[f"_old_{c}" for c in columns])


def seed(table: DataFrame, defaults: DataFrame, key: str, refresh: list[str], update: bool) -> DataFrame:
    """Defaults that are missing are added; ``refresh`` columns of others follow only if asked."""
    known = F.col("t._is").isNotNull()
    both = table.withColumn("_is", F.lit(1)).alias("t").join(defaults.withColumn("_is", F.lit(1)).alias("d"), key, "full_outer")
    out = [F.col(key)]
    for c in table.columns:
        if c == key:
            continue
        t, d = F.col(f"t.{c}"), F.col(f"d.{c}")
        take = F.when(known & F.col("d._is").isNotNull() & F.lit(update), d).when(known, t).otherwise(d) if c in refresh else F.when(known, t).otherwise(d)
        out.append(take.alias(c))
    return both.select(*out)


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that a uniqueness constraint would refuse, and how often they occur."""
    return df.groupBy(*keys).count().filter("count > 1")


def status_delta(before: DataFrame, now: DataFrame, answered: DataFrame, key: str) -> DataFrame:
    """(now - before) with (answered and now)."""
    b, n, a = (x.select(key).distinct() for x in (before, now, answered))
    return n.subtract(b).union(a.intersect(n)).distinct()


def rejection_threads(a: DataFrame, b: DataFrame, rejected: tuple[str, ...] = ("rejected",)) -> DataFrame:
    """Threads of rejected records that no other record shares. ``a`` and ``b``: thread, status."""
    both = a.select("thread", "status").unionByName(b.select("thread", "status")).filter("thread IS NOT NULL AND thread <> ''")
    gone = both.filter(F.col("status").isin(*rejected)).select("thread").distinct()
    live = both.filter(~F.coalesce(F.col("status").isin(*rejected), F.lit(False))).select("thread").distinct()
    return gone.join(live, "thread", "left_anti")


def keeper(df: DataFrame, key: str, rank: Column, ident: str) -> DataFrame:
    """Of each key, the row of the highest rank, then of the least id."""
    w = Window.partitionBy(key).orderBy(rank.desc(), F.asc(ident))
    return df.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def contained(rows: DataFrame, group: str, item: str, known: DataFrame) -> DataFrame:
    """For each group whether all its items are known, and how many of how many."""
    k = known.select(F.col(item)).distinct().withColumn("_known", F.lit(True))
    both = rows.join(k, item, "left").withColumn("_known", F.coalesce("_known", F.lit(False)))
    return both.groupBy(group).agg(F.every("_known").alias("done"), F.count_if("_known").alias("n_known"), F.count(F.lit(1)).alias("n_items"))
