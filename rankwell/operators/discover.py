"""Boards found out of texts and names: slugs, probes, counters, misses."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions import text as T
from ..functions import vocabulary as V
from ..session import cut
from ..streaming.fold import next_counter
from . import select as S

SCAN, WINDOW, PROBES, MOST_EMPTY = 400, 300, 20, 4


def record_slugs(jobs: DataFrame, boards: DataFrame, provider: str, scan: int = SCAN) -> DataFrame:
    """(provider, slug, discovered_from) of boards that the newest jobs mention and none knows."""
    recent = jobs.orderBy(F.desc("id")).limit(scan)
    text = F.concat_ws("\n", "url", "description")
    found = recent.select("id", F.explode(T.discover_slugs(text, provider)).alias("slug"))
    first = found.groupBy("slug").agg(F.max("id").alias("discovered_from"))
    known = boards.filter(F.col("provider") == provider).select("slug")
    return first.join(known, "slug", "left_anti").select(F.lit(provider).alias("provider"), "slug", "discovered_from")


def probe_candidates(jobs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The best jobs by percentile, the blocked ones first."""
    able = jobs.filter("passed AND percentile IS NOT NULL")
    return S.window_then_reorder(able, [F.desc("percentile"), F.asc("id")], window, [F.desc("blocked"), F.desc("percentile"), F.asc("id")])


def companies_to_probe(jobs: DataFrame, tried: DataFrame, limit: int = PROBES, window: int = WINDOW) -> DataFrame:
    """``key, company, titles``: the first ``limit`` companies nobody probed, with their titles."""
    from pyspark.sql import Window

    ranked = probe_candidates(jobs, window).withColumn("key", T.probe_key("company"))
    order = Window.orderBy(F.desc("blocked"), F.desc("percentile"), F.asc("id"))
    placed = ranked.withColumn("pos", F.row_number().over(order)).join(tried.select("key").distinct(), "key", "left_anti")
    first = S.first_k_groups(placed, "key", "pos", limit)
    return first.groupBy("key").agg(F.min_by("company", "pos").alias("company"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "title"))), lambda s: s["title"]).alias("titles"))


def confirms(company: Column | str, slug: Column | str, titles: Column | str, board_company: Column | str, board_titles: Column | str) -> Column:
    """Whether a board is the company's: it says so (and not just the slug), or has one of its titles."""
    col = lambda x: F.col(x) if isinstance(x, str) else x
    same = (T.identity_key(board_company) == T.identity_key(company)) & (T.identity_key(board_company) != T.identity_key(slug))
    fold = lambda a: F.filter(F.transform(col(a), T.identity_key), lambda x: x != "")
    return F.coalesce(same, F.lit(False)) | F.arrays_overlap(fold(titles), fold(board_titles))


def probe(companies: DataFrame, board: Callable[[str, str], dict | None], providers: tuple[str, ...] = tuple(V.SLUG_PATTERNS)) -> tuple[DataFrame, DataFrame]:
    """(boards, misses) of ``companies`` (key, company, titles): the guesses at each company's slug are tried
    with each provider, and the first board that is the company's counts.

    ``board(provider, slug)`` gives its company and titles, or nothing; what it raises counts as
    nothing. The answers are written once, since they come from outside.
    """
    tries = companies.select("key", "company", "titles", F.posexplode(T.slug_candidates("company")).alias("_guess", "slug"))
    tries = tries.select("*", F.posexplode(F.array(*[F.lit(p) for p in providers])).alias("_p", "provider"))

    def ask(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in parts:
            rows = []
            for p, s in zip(x["provider"], x["slug"], strict=True):
                try:
                    got = board(p, s) or {}
                except Exception:  # noqa: BLE001  (a board that can't be read isn't found)
                    got = {}
                rows.append((got.get("company"), list(got.get("titles", []))))
            yield x.assign(board_company=[c for c, _ in rows], board_titles=[t for _, t in rows])

    told = cut(tries.mapInPandas(ask, StructType([*tries.schema, StructField("board_company", StringType()), StructField("board_titles", ArrayType(StringType()))])))
    own = told.filter(confirms("company", "slug", "titles", "board_company", "board_titles"))
    first = own.groupBy("key").agg(F.min_by(F.struct("provider", "slug"), F.struct("_guess", "_p")).alias("b"))
    boards = first.select("b.provider", "b.slug", F.col("key").alias("discovered_from"))
    probed = companies.select("key", "company").join(first.select("key", F.lit(True).alias("found")), "key", "left").withColumn("found", F.coalesce("found", F.lit(False)))
    return boards, misses(probed)


def misses(probed: DataFrame) -> DataFrame:
    """What is remembered of companies without a board, so that they are probed once."""
    return probed.filter(~F.col("found")).select(F.lit("miss").alias("provider"), T.miss_slug("company").alias("slug"), T.probe_key("company").alias("discovered_from"))


def after_run(boards: DataFrame, results: DataFrame, most: int = MOST_EMPTY) -> DataFrame:
    """Boards with their counters after a run; ``results``: provider, slug, found. Boards that
    weren't read keep theirs."""
    got = boards.join(results.select("provider", "slug", F.col("found").alias("_found")), ["provider", "slug"], "left")
    count, on = next_counter(F.col("empty_runs"), F.col("_found"), F.col("enabled"), most)
    read = F.col("_found").isNotNull()
    return got.withColumn("enabled", F.when(read, on).otherwise(F.col("enabled"))).withColumn("empty_runs", F.when(read, count).otherwise(F.col("empty_runs")).cast("int")).drop("_found")


def known_boards(boards: DataFrame, providers: tuple[str, ...] = tuple(V.SLUG_PATTERNS)) -> DataFrame:
    return boards.filter(F.col("provider").isin(*providers) & F.col("enabled")).orderBy("provider", "slug")
