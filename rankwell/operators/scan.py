"""The message service as frames: what came in, what it answers, what it changes, what may be cleared."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..schema import unused
from ..session import cut
from ..settings import Settings
from ..streaming import fold, threads
from . import guards, resolve, select, sets


@dataclass
class Scan:
    """Rows to write after a run; ``clear`` are intents, applied outside."""

    replies: DataFrame
    skipped: DataFrame
    applications: DataFrame
    clear: DataFrame
    report: DataFrame


def learn_threads(applications: DataFrame, sent_mail: DataFrame) -> DataFrame:
    """Applications with the thread of their sent mail, where they had none and one fits."""
    return sets.fill_missing(applications, resolve.sent_threads(applications, sent_mail), "id", "thread_id")


def is_unrelated(job_related: Column, strategy: Column) -> Column:
    """Not about a job, and matched by no thread; what wasn't classified is kept."""
    by_thread = F.coalesce(strategy == "thread", F.lit(False))
    return F.coalesce(~job_related & ~by_thread, F.lit(False))


def match_in_order(messages: DataFrame, applications: DataFrame, mailbox: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Matches, and the applications with the threads that were learned.

    As if the messages of a ``mailbox`` (a column; without one, all are of the same) came one by one,
    oldest first (no time before all, ties by id): a conclusive match teaches its application the
    thread, and only messages after that one match by it. What each message names doesn't depend
    on the order, so it is matched once, and the lessons are told from the pairs of thread and
    application alone (see ``threads.lessons``).
    """
    box = mailbox or unused(messages, "_mailbox")
    slim = messages.select("message_id", "thread_id", "received_at", F.col(box) if mailbox else F.lit(0).alias(box))
    slim = slim.withColumn("thread_id", F.coalesce("thread_id", F.lit("")))
    base = cut(resolve.match_replies(messages, applications))
    open_ = applications.filter("thread_id IS NULL").select(F.col("id").alias("application_id"))
    able = base.filter("conclusive AND strategy <> 'thread'").join(slim.filter("thread_id <> ''"), "message_id").join(open_, "application_id", "left_semi")
    taught = cut(threads.lessons(able, box))
    after = slim.filter("thread_id <> ''").join(taught, [box, "thread_id"]).filter(threads.moment() > F.col("moment"))
    by_lesson = cut(after.select("message_id", "application_id", F.lit("thread").alias("strategy"), F.lit(True).alias("conclusive")))
    found = base.join(by_lesson.select("message_id"), "message_id", "left_anti").unionByName(by_lesson)
    learned = taught.select(F.col("application_id").alias("id"), F.col("thread_id").alias("_thread"))
    known = applications.join(learned, "id", "left").withColumn("thread_id", F.coalesce("thread_id", "_thread")).select(applications.columns)
    return found, known


def scan(messages: DataFrame, applications: DataFrame, recorded: DataFrame, skipped: DataFrame, classifier: Callable[[], guards.Classifier] = lambda: guards.keyword_classifier, settings: Settings = Settings()) -> Scan:
    """One run over incoming messages.

    ``applications``: id, company, title, status, thread_id, sent_at, reply_at. Messages that
    are recorded or skipped already are left; the rest is matched, classified (mail of boards
    that answers no application isn't), and dropped as unrelated if it isn't about a job and
    matched by no thread. The states of the applications are folded from the related ones.
    """
    fresh = cut(fold.consume(messages, recorded, skipped))
    live = applications.filter(F.col("status").isin(*fold.REPLYABLE))
    matched, learned = match_in_order(fresh, live)
    both = fresh.join(matched, "message_id", "left")
    bulk = resolve.is_board_sender("from_address") & F.col("application_id").isNull()
    told = guards.classify(both.filter(~bulk), classifier)
    quiet = both.filter(bulk).withColumn("verdict", F.lit(None).cast(told.schema["verdict"].dataType))
    all_ = cut(told.unionByName(quiet))
    unrelated = is_unrelated(F.col("verdict.job_related"), F.col("strategy"))
    replies = all_.filter(~unrelated).select("message_id", "thread_id", "from_address", "subject", "body", "received_at", "application_id", "strategy", F.coalesce("conclusive", F.lit(False)).alias("conclusive"), "verdict.reply_type", "verdict.confidence", "verdict.reasoning", F.col("verdict.company").alias("detected_company"), F.col("verdict.role").alias("detected_role"))
    moves = replies.filter("application_id IS NOT NULL").select("application_id", "message_id", "received_at", "reply_type", "confidence", "conclusive")
    state = fold.fold_messages(moves).select(F.col("application_id").alias("id"), F.col("status").alias("_to"), "evidence_at", "n_moves")
    # evidence that is newer already stays
    late = F.coalesce(F.col("evidence_at") < F.col("reply_at"), F.lit(False))
    take = (F.coalesce("n_moves", F.lit(0)) > 0) & ~late
    after = learned.unionByName(applications.filter(~F.col("status").isin(*fold.REPLYABLE))).join(state, "id", "left")
    after = after.withColumn("status", F.when(take, F.col("_to")).otherwise(F.col("status"))).withColumn("reply_at", F.when(take, F.col("evidence_at")).otherwise(F.col("reply_at"))).drop("_to", "evidence_at", "n_moves")
    rejected = lambda df: df.filter("status = 'rejected'").select("id")
    answered = replies.filter("application_id IS NOT NULL").select(F.col("application_id").alias("id"))
    clear = sets.status_delta(rejected(applications), rejected(after), answered, "id")
    report = replies.agg(F.count(F.lit(1)).alias("stored"), F.count("application_id").alias("matched"), F.count_if("conclusive").alias("conclusive"))
    return Scan(replies, fold.tombstones(all_, unrelated), after, clear, report)


def relink(replies: DataFrame, applications: DataFrame) -> DataFrame:
    """Stored replies without an application, matched anew: message_id, application_id, strategy, conclusive."""
    return match_in_order(replies.filter("application_id IS NULL"), applications)[0]


def route_notices(notices: DataFrame, applications: DataFrame) -> DataFrame:
    """Employer notices: a rejection by its vacancy is conclusive with full confidence, a message by
    its vacancy too; by a unique employer's name it isn't; the rest is cleared.

    ``applications``: id, company, url. Of several applications of a vacancy the newest id counts.
    """
    a = applications.select(F.col("id").alias("application_id"), "company", F.nullif(F.regexp_extract("url", r"hh\.ru/vacancy/(\d+)", 1), F.lit("")).alias("vacancy_id"))
    by_id = a.filter("vacancy_id IS NOT NULL").groupBy("vacancy_id").agg(F.max("application_id").alias("by_vacancy"))
    told = notices.filter("company IS NOT NULL").select("message_id", T.words(T.fold("company")).alias("found")).filter(F.size("found") > 0)
    owners = resolve.companies_of(a.select(F.col("application_id").alias("app_id"), F.col("company").alias("app_company")))
    named = resolve.named_in(told, owners).groupBy("message_id").agg(F.when(F.sum("n_apps") == 1, F.max("app_id")).alias("by_name"))
    got = notices.join(by_id, "vacancy_id", "left").join(named, "message_id", "left")
    rejection = (F.col("kind") == "rejection") & F.col("by_vacancy").isNotNull()
    route = F.when(rejection, "rejection").when(F.coalesce("by_vacancy", "by_name").isNotNull() & (F.col("kind") != "rejection"), "message").otherwise("clear")
    return got.select("message_id", "kind", F.when(route != "clear", F.coalesce("by_vacancy", "by_name")).alias("application_id"), route.alias("route"), (rejection | (F.col("by_vacancy").isNotNull() & (route == "message"))).alias("conclusive"), F.when(rejection, F.lit(1.0)).alias("confidence"))


def record_applications(replies: DataFrame, jobs: DataFrame, applications: DataFrame, manual_source: int) -> tuple[DataFrame, DataFrame]:
    """(links, plan): replies without an application but with an employer, and the records they need.

    One record for each folded company and role: a job of that name is reused (hand-made ones
    first, then the least id), else ``new_job``; its application is reused as it is, else
    ``new_application`` with the time and thread of the first reply.
    """
    title = F.coalesce(F.nullif(T.strip("detected_role"), F.lit("")), F.lit("(role not stated)"))
    r = replies.filter("application_id IS NULL").filter(F.coalesce(T.strip("detected_company"), F.lit("")) != "")
    r = r.select("message_id", "received_at", "thread_id", T.strip("detected_company").alias("company"), title.alias("title"))
    r = r.withColumn("_c", T.role_key("company")).withColumn("_t", T.role_key("title"))
    w = Window.partitionBy(T.role_key("company"), T.role_key("title")).orderBy(F.col("source_id") != manual_source, "id")
    j = jobs.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select(F.col("id").alias("job_id"), T.role_key("company").alias("_c"), T.role_key("title").alias("_t"))
    first = r.groupBy("_c", "_t").agg(F.min_by(F.struct("company", "title", "received_at", "thread_id"), F.struct("received_at", "message_id")).alias("f"))
    plan = first.select("_c", "_t", "f.*").join(j, ["_c", "_t"], "left").join(applications.select(F.col("id").alias("application_id"), "job_id"), "job_id", "left")
    plan = plan.withColumn("new_job", F.col("job_id").isNull()).withColumn("new_application", F.col("application_id").isNull())
    return r.select("message_id", "_c", "_t"), plan


def review_queue(replies: DataFrame, applications: DataFrame, days: int = 7, page: int | None = None, size: int = 50) -> DataFrame:
    """Replies with an employer and no application, newest first, each with the applications that a
    reviewer should see before a record is made (``similar``: application_id and reason, by id). With
    ``page`` (from 1), those of one page, for which alone anything is looked up."""
    open_ = replies.filter("application_id IS NULL").filter(F.coalesce(T.strip("detected_company"), F.lit("")) != "")
    ident = "message_id" if "id" not in replies.columns else "id"
    order = [F.desc_nulls_last("received_at"), F.asc(ident)]
    if page is not None:
        open_ = cut(select.page(open_, order, page, size))
    like = resolve.similar_applications(open_.withColumnRenamed("message_id", "id") if ident == "message_id" else open_, applications, days)
    held = like.groupBy("reply_id").agg(F.array_sort(F.collect_list(F.struct("application_id", "reason"))).alias("similar"))
    return open_.join(held, open_[ident] == held["reply_id"], "left").drop("reply_id").orderBy(*order)


def record_selected(replies: DataFrame, ids: list, jobs: DataFrame, applications: DataFrame, manual_source: int) -> tuple[DataFrame, DataFrame]:
    """``record_applications`` for the replies that a reviewer picked (message ids)."""
    return record_applications(replies.filter(F.col("message_id").isin(*ids)), jobs, applications, manual_source)


def backlog(mail_rows: DataFrame, records: DataFrame, stored: DataFrame) -> DataFrame:
    """Alerts whose records are all stored already, which may be cleared; with how many of how many.

    ``records``: message_id, content_key; alerts without records are told as empty.
    """
    got = sets.contained(records, "message_id", "content_key", stored)
    return mail_rows.select("message_id").join(got, "message_id", "left").select("message_id", F.coalesce("done", F.lit(False)).alias("done"), F.coalesce("n_known", F.lit(0)).alias("n_known"), F.coalesce("n_items", F.lit(0)).alias("n_items"))


def unbounded_query(query: str) -> str:
    """A mail query without its time window."""
    return " ".join(re.sub(r"\b(?:newer_than|older_than):\S+", " ", query).split())

