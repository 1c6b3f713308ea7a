"""Counts and lists for a reviewer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from . import select as S


def totals(jobs: DataFrame, applications: DataFrame) -> DataFrame:
    """One row: jobs, passed, scored, applications sent."""
    j = jobs.agg(F.count(F.lit(1)).alias("jobs"), F.count_if("passed").alias("passed"), F.count("score").alias("scored"), F.max("score").alias("top_score"))
    return j.crossJoin(applications.agg(F.count_if(F.col("status") == "sent").alias("sent")))


def hosts(jobs: DataFrame, flag: Column, name: str) -> DataFrame:
    """Hosts of postings, most first, and whether the flag holds for any posting of the host."""
    return jobs.groupBy(U.host("url").alias("host")).agg(F.count(F.lit(1)).alias("n"), F.max(flag).alias(name)).orderBy(F.desc("n"), "host")


def unreachable_hosts(jobs: DataFrame, applications: DataFrame) -> DataFrame:
    """Hosts of postings that could not be applied to, most first, and whether they are blocked already."""
    gone = applications.filter("status = 'unreachable'").select(F.col("job_id").alias("id"))
    return hosts(jobs.join(gone, "id"), U.is_blocked("url"), "blocked")


def recent_notes(applications: DataFrame, status: str = "ineligible", limit: int = 8, width: int = 70) -> DataFrame:
    got = applications.filter((F.col("status") == status) & F.col("notes").isNotNull()).orderBy(F.desc("updated_at"), "id").limit(limit)
    return got.select("id", F.substring(T.collapse("notes"), 1, width).alias("note"))


def tally(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def note(counts: DataFrame, column: str) -> DataFrame:
    """One text out of a tally, the most frequent first."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), F.col(column).alias("c"), "n")))
    return counts.agg(F.array_join(F.transform(ordered, lambda s: F.concat(s["n"].cast("string"), F.lit(" "), s["c"])), ", ").alias("note"))


def listing(df: DataFrame, columns: list[str], equal: dict | None = None, search: str = "", within: tuple[str, ...] = (), sort: list[Column] | None = None, page: int = 1, size: int = 50) -> DataFrame:
    """A list view: filters by equality (None: is null), search without case, sort, page."""
    for c, v in (equal or {}).items():
        df = df.filter(F.col(c).isNull() if v is None else F.col(c) == F.lit(v))
    if search:
        hit = F.lit(False)
        for c in within:
            hit = hit | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(search.lower())), F.lit(False))
        df = df.filter(hit)
    return S.page(df, sort or [F.col(columns[0]).asc_nulls_last()], page, size).select(*columns)
