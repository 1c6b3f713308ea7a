"""Ranked selection: anti-join, window ranks, caps, top-k, and sorts with explicit nulls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

SCORE_DECIMALS = 6


def handled_roles(postings: DataFrame, handled: DataFrame) -> DataFrame:
    """Postings without those whose folded company and title are among ``handled``."""
    keys = handled.select(T.role_key("company").alias("_c"), T.role_key("title").alias("_t")).distinct()
    return postings.join(keys, (T.role_key(postings["company"]) == F.col("_c")) & (T.role_key(postings["title"]) == F.col("_t")), "left_anti")


def collapse_twins(df: DataFrame, order: list[Column], company: str = "company", title: str = "title") -> DataFrame:
    """One row for each folded company and title: the first in ``order``."""
    w = Window.partitionBy(T.role_key(company), T.role_key(title)).orderBy(*order)
    return df.withColumn("_twin", F.row_number().over(w)).filter("_twin = 1").drop("_twin")


def cap_groups(df: DataFrame, order: list[Column], most: int, group: Column | str = "company") -> DataFrame:
    """At most ``most`` rows of a group, the first in ``order``; nothing is capped at 0 or less."""
    if most <= 0:
        return df
    by = F.col(group) if isinstance(group, str) else group
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= most).drop("_rank")


def shortlist(
    postings: DataFrame,
    handled: DataFrame,
    top_n: int = 25,
    floor: float = 90.0,
    bonus: float = 0.02,
    per_company: int = 3,
    least_body: int = 300,
    fold_company: bool = True,
) -> DataFrame:
    """The best ``top_n`` postings nobody has handled yet.

    ``postings``: id, company, title, description (or body_chars, its length without blanks around it),
    is_remote, score, percentile, passed, blocked. Exclusion, twins and cap come before the limit. Ties go to the smaller id.
    ``fold_company`` False caps by the company as it is spelled.
    """
    rank = F.round(F.col("score") + F.when(F.col("is_remote"), F.lit(bonus)).otherwise(F.lit(0.0)), SCORE_DECIMALS)
    body = F.col("body_chars") if "body_chars" in postings.columns else F.length(F.trim("description"))
    able = postings.filter(F.col("score").isNotNull() & F.col("passed") & ~F.col("blocked") & (F.col("percentile") >= floor) & (body >= least_body))
    order = [F.desc("rank_score"), F.asc("id")]
    left = handled_roles(able, handled).withColumn("rank_score", rank)
    left = cap_groups(collapse_twins(left, order), order, per_company, T.role_key("company") if fold_company else "company")
    return left.orderBy(*order).limit(top_n)


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def first_seen(df: DataFrame, keys: list[str], position: list[Column]) -> DataFrame:
    """The first row of each key in the order of ``position``."""
    return top_k(df, keys, position, 1, "_first").drop("_first")


def window_then_reorder(df: DataFrame, order: list[Column], n: int, then: list[Column]) -> DataFrame:
    """The first ``n`` rows in one order, shown in another."""
    return df.orderBy(*order).limit(n).orderBy(*then)


def first_k_groups(df: DataFrame, group: str, position: str, k: int) -> DataFrame:
    """Rows of the first ``k`` groups by first position, up to where group k + 1 begins."""
    first = df.groupBy(group).agg(F.min(position).alias("_first"))
    edge = first.orderBy("_first", group).limit(k + 1)
    ranked = edge.withColumn("_no", F.row_number().over(Window.orderBy("_first", group)))
    stop = ranked.agg(F.max(F.when(F.col("_no") == k + 1, F.col("_first"))).alias("_stop"))
    kept = df.join(F.broadcast(ranked.filter(F.col("_no") <= k).select(group)), group)
    return kept.crossJoin(F.broadcast(stop)).filter(F.col("_stop").isNull() | (F.col(position) < F.col("_stop"))).drop("_stop")


def page(df: DataFrame, order: list[Column], number: int, size: int = 50) -> DataFrame:
    """Page ``number`` (from 1) of ``size`` rows."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)
