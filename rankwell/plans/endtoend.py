"""The whole way: ingest, judge, embed, score, select, draft."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..functions import vectors as X
from ..operators import agent, rules
from ..operators import select as S
from ..operators.profile import profile_vector
from ..session import cut
from ..settings import Settings
from ..sources import feeds, mail, registry  # noqa: F401  (the sources register themselves)


class Run(NamedTuple):
    """The jobs with their scores, the rows to write to the applications, their tally, and what was refused."""

    jobs: DataFrame
    rows: DataFrame
    tally: DataFrame
    rejected: DataFrame
    errors: DataFrame


def match(jobs: DataFrame, profile: str, encoder: Callable[[], X.Encoder] = X.hashing_encoder, settings: Settings = Settings(), model: str = "", vectors: str | None = None) -> DataFrame:
    """Jobs with passed, blocked, embedding, score and percentile. The profile's vector is remembered by
    ``model``, in the folder ``vectors`` also for later runs.

    Rules first, since they are cheap; vectors only for jobs that pass and have none; scores
    over all that pass, and null for the rest.
    """
    judged = jobs.withColumn("passed", rules.passes()).withColumn("blocked", U.is_blocked("url"))
    have = judged.filter(F.col("embedding").isNotNull() | ~F.col("passed"))
    need = judged.filter(F.col("embedding").isNull() & F.col("passed")).withColumn("_text", T.embedding_text("title", "company", "description")).drop("embedding")
    made = X.embed(need, "_text", encoder, batch=settings.embed_batch).drop("_text")
    both = have.unionByName(made)
    vector = profile_vector(jobs.sparkSession, profile, encoder, model, vectors)
    target = jobs.sparkSession.createDataFrame([(vector,)], "profile array<double>")
    # ids and scores are ranked, and meet the jobs once
    scored = X.percentile(cut(X.centred_cosine(both.filter("passed"), target).select("id", "score")))
    return both.drop("score", "percentile").join(scored, "id", "left")


def shortlist(matched: DataFrame, handled: DataFrame, settings: Settings = Settings()) -> DataFrame:
    s = settings
    return S.shortlist(matched, handled, s.top_n, s.floor, s.remote_bonus, s.per_company, s.least_body, s.fold_company)


def run(spark: SparkSession, paths: dict[str, str], profile: str, factory: agent.Factory, stored: DataFrame | None = None, handled: DataFrame | None = None, encoder: Callable[[], X.Encoder] = X.hashing_encoder, settings: Settings = Settings(), config: dict | None = None) -> Run:
    """One run over the sources in ``paths``: what is new is stored beside ``stored`` (jobs), all is scored
    by the profile, and the shortlist is screened and drafted. Nothing is written or sent."""
    new, rejected, errors = registry.ingest(spark, paths, stored, config)
    fresh = new.withColumn("id", F.xxhash64("content_key")).withColumn("embedding", F.lit(None).cast("array<float>")).withColumn("score", F.lit(None).cast("double")).withColumn("percentile", F.lit(None).cast("double"))
    jobs = fresh.unionByName(stored, allowMissingColumns=True) if stored is not None else fresh
    scored = cut(match(jobs, profile, encoder, settings))
    none = scored.select("company", "title").limit(0)
    s = settings
    rows, tally = agent.draft(scored, handled if handled is not None else none, profile, factory, encoder=encoder, top_n=s.top_n, floor=s.floor, bonus=s.remote_bonus, per_company=s.per_company, least_body=s.least_body, fold_company=s.fold_company)
    return Run(scored, rows, tally, rejected, errors)
