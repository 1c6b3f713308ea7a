"""Drafting with models put in: screen, research, draft, critic, and the rows that follow.

Every call to a model is a column: a pandas UDF that calls only where the row needs it, and
whose failures are values. The guards between the calls are native expressions. So the loop of
drafts and critiques is a bounded number of columns, not a loop over rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import prompts as P
from ..functions import text as T
from ..functions import vectors as X
from ..session import cut
from . import guards
from . import select as S

SCREEN = "worth boolean, reasoning string"
DRAFT = "subject string, body string, points array<string>"
CRITIC = "approved boolean, issues string"
#: Applications that a run may change; a person has moved on all others.
OPEN = ("shortlisted", "drafted")


@dataclass(frozen=True)
class Calls:
    """The model calls: each takes a prompt and gives a dict of its fields; research gives a text."""

    screen: Callable[[str], dict]
    draft: Callable[[str, list[str]], dict]
    critic: Callable[[str], dict] = lambda prompt: {"approved": True, "issues": ""}
    research: Callable[[str], str] | None = None


Factory = Callable[[], Calls]


@lru_cache(maxsize=8)
def _made(factory: Factory) -> Calls:
    """The calls of a factory, made once in a process."""
    return factory()


def _column(factory: Factory, of: Callable[[Calls], Callable], fields: str, need: Column, *args: Column) -> Column:
    """A call for the rows where ``need`` holds: a struct of ``fields`` and ``error``; null elsewhere."""
    names = [f.split()[0] for f in fields.split(", ")]

    @F.pandas_udf(f"{fields}, error string, called boolean")
    def run(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for wanted, *columns in parts:
            rows = []
            for due, *x in zip(wanted, *columns, strict=True):
                row = dict.fromkeys(names) | {"error": None, "called": bool(due)}
                if due:
                    try:
                        got = of(_made(factory))(*(list(v) if hasattr(v, "tolist") else v for v in x))
                        row |= {k: got[k] for k in names}
                    except Exception as e:  # noqa: BLE001  (one bad row must not stop the rest)
                        row["error"] = f"{type(e).__name__}: {e}"
                rows.append(row)
            yield pd.DataFrame(rows, columns=[*names, "error", "called"])

    # not deterministic: no plan may call twice
    got = run.asNondeterministic()(F.coalesce(need, F.lit(False)), *args)
    return got


def retrieve(jobs: DataFrame, profile: str, k: int = 8, encoder: Callable[[], X.Encoder] = X.hashing_encoder) -> DataFrame:
    """``jobs`` (embedding) with ``bullets``: the ``k`` lines of the profile whose vectors are nearest, the nearest first.

    The lines of one profile are encoded once and broadcast as one row.
    """
    spark = jobs.sparkSession
    lines = spark.range(1).select(F.posexplode(T.bullets(F.lit(profile))).alias("at", "line"))
    lines = cut(X.embed(lines, "line", encoder, out="vector"))
    held = lines.agg(F.array_sort(F.collect_list(F.struct("at", "line", "vector"))).alias("_lines"))
    near = F.transform("_lines", lambda b: F.struct((-X.cosine(b["vector"], F.col("embedding"))).alias("far"), b["at"].alias("at"), b["line"].alias("line")))
    best = F.transform(F.slice(F.array_sort(near), 1, k), lambda b: b["line"])
    return jobs.crossJoin(F.broadcast(held)).withColumn("bullets", F.coalesce(best, F.array().cast("array<string>"))).drop("_lines")


def run_agent(jobs: DataFrame, factory: Factory, constraints: str = "", style: str = "", revisions: int = 1, screen: bool = True) -> DataFrame:
    """``jobs`` with ``outcome``: verdict, detail, subject, body, points, research, critique, approved, revisions.

    ``jobs``: title, company, location, url, description, apply_channel, bullets. Decide;
    research, whose failure is tolerated; draft; guards; critic, which sends a draft back
    ``revisions`` times at most. Verdicts: declined (not worth it), refused (most points aren't
    in the bullets), fabricated (claims eligibility that isn't on file), error (a call failed),
    drafted. A draft that is refused isn't tried again.
    """
    job = {c: F.coalesce(F.col(c), F.lit("")) for c in ("title", "company", "location", "url", "description", "apply_channel")}
    yes = F.lit(True)
    got = jobs
    if screen:
        got = got.withColumn("_screen", _column(factory, lambda c: c.screen, SCREEN, yes, P.screen(**{k: job[k] for k in ("title", "company", "location", "description")})))
    else:
        got = got.withColumn("_screen", F.struct(yes.alias("worth"), F.lit("").alias("reasoning"), F.lit(None).cast("string").alias("error"), F.lit(False).alias("called")))
    got = got.withColumn("_alive", F.coalesce(F.col("_screen.error").isNull() & F.col("_screen.worth"), F.lit(False)))
    look = _column(factory, lambda c: lambda p: {"text": c.research(p) if c.research else ""}, "text string", F.col("_alive"), P.research(job["title"], job["company"], job["location"]))
    got = got.withColumn("_research", F.trim(F.coalesce(look["text"], F.lit(""))))
    got = got.withColumn("_draft", F.lit(None).cast(f"struct<{DRAFT.replace(' ', ':', 1).replace(', body ', ', body:').replace(', points ', ', points:')},error:string,called:boolean>"))
    got = got.withColumn("_critic", F.lit(None).cast("struct<approved:boolean,issues:string,error:string,called:boolean>")).withColumn("_rounds", F.lit(0)).withColumn("_bad", F.lit(None).cast("string"))
    for k in range(revisions + 1):
        need = F.col("_alive") if k == 0 else F.col("_alive") & F.col("_bad").isNull() & F.col("_draft.error").isNull() & F.col("_critic.error").isNull() & ~F.col("_critic.approved")
        got = got.withColumn("_need", F.coalesce(need, F.lit(False)))
        prompt = P.draft(**job, bullets=F.col("bullets"), language=T.detect_language(F.concat_ws("\n", "title", "description")), constraints=constraints, style=style, extra=P.context(F.col("_research"), F.col("_critic.issues")))
        got = got.withColumn("_new", _column(factory, lambda c: c.draft, DRAFT, F.col("_need"), prompt, F.col("bullets")))
        got = got.withColumn("_draft", F.when(F.col("_need"), F.col("_new")).otherwise(F.col("_draft")))
        letter = F.concat_ws("\n", "_draft.subject", "_draft.body")
        claims, off = guards.unsupported_claims(F.lit(constraints), letter), guards.ungrounded(F.col("_draft.points"), F.col("bullets"))
        loose = (F.size("bullets") > 0) & (F.size(off) > 0) & (F.size(off) * 2 > F.size("_draft.points"))
        bad = F.when(F.coalesce(loose, F.lit(False)), F.concat(F.lit("refused:"), F.get(off, F.lit(0)))).when(F.coalesce(F.size(claims) > 0, F.lit(False)), F.concat(F.lit("fabricated:"), F.get(claims, F.lit(0))))
        got = got.withColumn("_bad", F.when(F.col("_need") & F.col("_draft.error").isNull(), bad).otherwise(F.col("_bad"))).withColumn("_rounds", F.col("_rounds") + F.when(F.col("_need") & F.lit(k > 0), 1).otherwise(0))
        judge = F.col("_need") & F.col("_bad").isNull() & F.col("_draft.error").isNull()
        asked = P.critic(job["title"], job["company"], job["description"], F.col("bullets"), F.col("_draft.subject"), F.col("_draft.body"), F.col("_draft.points"))
        got = got.withColumn("_judge", F.coalesce(judge, F.lit(False)))
        got = got.withColumn("_said", _column(factory, lambda c: c.critic, CRITIC, F.col("_judge"), asked)).withColumn("_critic", F.when(F.col("_judge"), F.col("_said")).otherwise(F.col("_critic")))
    kind = F.substring_index("_bad", ":", 1)
    error = F.coalesce("_screen.error", "_draft.error", "_critic.error")
    verdict = F.when(error.isNotNull(), "error").when(~F.col("_alive"), "declined").when(F.col("_bad").isNotNull(), kind).otherwise("drafted")
    detail = F.coalesce(error, F.expr("substring(_bad, instr(_bad, ':') + 1)"), "_screen.reasoning")
    drafted = verdict == "drafted"
    only = lambda x: F.when(drafted, x)
    outcome = F.struct(
        verdict.alias("verdict"), detail.alias("detail"), only(F.col("_draft.subject")).alias("subject"), only(F.col("_draft.body")).alias("body"), only(F.col("_draft.points")).alias("points"),
        F.col("_research").alias("research"), only(F.col("_critic.issues")).alias("critique"), only(F.col("_critic.approved")).alias("approved"), F.col("_rounds").alias("revisions"),
    )
    return got.select(*jobs.columns, outcome.alias("outcome"))


def agent_rows(done: DataFrame) -> DataFrame:
    """``job_id, status, cover_letter, notes`` to write after ``run_agent``; errors and fabrications write nothing."""
    o = F.col("outcome")
    points = F.when(F.size(o["points"]) > 0, F.concat(F.lit("Leans on: "), F.array_join(o["points"], "; ")))
    doubts = F.when(~o["approved"] & (o["critique"] != ""), F.concat(F.lit("Reviewer (unresolved): "), o["critique"]))
    found = F.when(o["research"] != "", F.concat(F.lit("Company: "), o["research"]))
    notes = F.when(o["verdict"] == "declined", F.concat(F.lit("Agent declined: "), o["detail"])).when(o["verdict"] == "refused", F.concat(F.lit("Agent refused (ungrounded): "), o["detail"]))
    notes = notes.otherwise(F.nullif(F.concat_ws("\n", points, doubts, found), F.lit("")))
    letter = F.when(o["verdict"] == "drafted", F.concat(F.lit("Subject: "), o["subject"], F.lit("\n\n"), o["body"]))
    status = F.when(o["verdict"] == "drafted", "drafted").otherwise("declined")
    return done.filter(o["verdict"].isin("drafted", "declined", "refused")).select(F.col("id").alias("job_id"), status.alias("status"), letter.alias("cover_letter"), notes.alias("notes"))


def top_for_agent(jobs: DataFrame, applications: DataFrame, limit: int = 5, floor: float = 90.0) -> DataFrame:
    """The first ``limit`` jobs by (remote, score), less those whose application a person has moved on."""
    able = jobs.filter(F.col("score").isNotNull() & F.col("passed") & ~F.col("blocked") & (F.col("percentile") >= floor))
    best = able.orderBy(F.desc("is_remote"), F.desc("score"), "id").limit(limit)
    moved = applications.filter(~F.col("status").isin(*OPEN)).select(F.col("job_id").alias("id")).distinct()
    return best.join(moved, "id", "left_anti")


def agent_draft(jobs: DataFrame, applications: DataFrame, profile: str, factory: Factory, constraints: str = "", style: str = "", limit: int = 5, floor: float = 90.0, encoder: Callable[[], X.Encoder] = X.hashing_encoder) -> DataFrame:
    """The agent over the top of the scored jobs: the rows to write."""
    best = retrieve(top_for_agent(jobs, applications, limit, floor), profile, encoder=encoder)
    return agent_rows(cut(run_agent(best, factory, constraints, style)))


def draft(jobs: DataFrame, handled: DataFrame, profile: str, factory: Factory, constraints: str = "", style: str = "", ids: list[int] | None = None, encoder: Callable[[], X.Encoder] = X.hashing_encoder, screen: bool = True, **shortlist: object) -> tuple[DataFrame, DataFrame]:
    """(rows to write, tally) of a batch of drafts without research, critic and revisions.

    Over the shortlist, or over the jobs of ``ids``, which are done again whatever was decided.
    """
    chosen = jobs.filter(F.col("id").isin(*ids)) if ids is not None else S.shortlist(jobs, handled, **shortlist)
    plain = lambda: Calls(_made(factory).screen, _made(factory).draft)
    done = cut(run_agent(retrieve(chosen, profile, encoder=encoder), plain, constraints, style, revisions=0, screen=screen))
    return guards.state_rows(done), done.groupBy(F.col("outcome.verdict").alias("verdict")).agg(F.count(F.lit(1)).alias("n"))
