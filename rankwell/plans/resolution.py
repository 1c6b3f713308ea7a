"""Matching, folding and classifying messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import guards
from ..operators import resolve as M
from ..sources import mail
from ..streaming import fold, threads
from .base import query, table


@query(
    "reply_match",
    """WITH m AS (SELECT conv_id || '-' || turn AS message_id, conv_id, turn FROM conversations),
b AS (SELECT o_custkey, count(*) AS n, min_by(o_orderkey, (o_orderdate > TIMESTAMP '1998-01-01', CASE WHEN o_orderdate > TIMESTAMP '1998-01-01' THEN epoch(o_orderdate) ELSE -epoch(o_orderdate) END, o_orderkey)) AS app
  FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1),
t AS (SELECT message_id, o_orderkey AS app FROM m JOIN (SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey) o ON turn = 2 AND o_orderkey = conv_id AND o_orderkey % 2 = 0),
r AS (SELECT m.message_id, t.app AS by_thread, d.app AS by_domain, d.n AS dn, s.app AS by_subject, s.n AS sn FROM m LEFT JOIN t USING (message_id)
  LEFT JOIN b d ON conv_id % 3 <> 0 AND d.o_custkey = conv_id LEFT JOIN b s ON conv_id % 3 <> 0 AND s.o_custkey = turn)
SELECT message_id, coalesce(by_thread, by_domain, by_subject) AS application_id,
  CASE WHEN by_thread IS NOT NULL THEN 'thread' WHEN by_domain IS NOT NULL THEN 'domain' ELSE 'subject' END AS strategy,
  by_thread IS NOT NULL OR CASE WHEN by_domain IS NOT NULL THEN dn = 1 ELSE sn = 1 END AS conclusive
FROM r WHERE coalesce(by_thread, by_domain, by_subject) IS NOT NULL""",
)
def reply_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as messages; customers' orders as applications."""
    c, o, cust = (table(spark, sf_dir, t) for t in ("conversations", "orders", "customer"))
    m = c.select(
        F.concat_ws("-", "conv_id", "turn").alias("message_id"),
        F.when(F.col("turn") == 2, F.col("conv_id").cast("string")).alias("thread_id"),
        F.when(F.col("conv_id") % 3 == 0, F.lit("x@linkedin.com")).otherwise(F.concat(F.lit("HR <hr@customer"), F.lpad(F.col("conv_id").cast("string"), 9, "0"), F.lit(".com>"))).alias("from_address"),
        F.concat(F.lit("About Customer "), F.lpad(F.col("turn").cast("string"), 9, "0")).alias("subject"),
        F.col("text").alias("body"),
        F.lit("1998-01-01").cast("timestamp").alias("received_at"),
    )
    a = o.join(cust, o["o_custkey"] == cust["c_custkey"]).select(F.col("o_orderkey").alias("id"), F.regexp_replace("c_name", "#", " ").alias("company"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey").cast("string")).alias("thread_id"), F.col("o_orderdate").cast("timestamp").alias("sent_at"))
    return M.match_replies(m, a)


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "error", "rejection").when(F.col("event_type") == "signup", "interview").otherwise("no_reply")
    return e.select(
        F.col("user_id").alias("application_id"),
        F.lpad(F.col("event_id").cast("string"), 19, "0").alias("message_id"),
        F.col("ts").cast("timestamp").alias("received_at"),
        kind.alias("reply_type"),
        (F.pmod(F.col("event_id"), F.lit(10)) / 10).alias("confidence"),
        (F.col("event_id") % 3 != 0).alias("conclusive"),
    )


STATUS = """WITH e AS (SELECT user_id AS application_id, event_id, ts, CASE event_type WHEN 'error' THEN 'rejected' WHEN 'signup' THEN 'interview' END AS to_status,
  event_id % 10 / 10.0 >= 0.7 AND event_id % 3 <> 0 AND event_type IN ('error', 'signup') AS moves FROM events)"""


@query(
    "ordered_fold",
    STATUS + " SELECT application_id, coalesce(max_by(to_status, (ts, event_id)) FILTER (WHERE moves), 'sent') AS status, strftime(max(ts) FILTER (WHERE moves), '%Y-%m-%d %H:%M:%S') AS evidence_at, count(*) FILTER (WHERE moves) AS n_moves, count(*) AS n_messages, 0::BIGINT AS n_late FROM e GROUP BY 1",
)
def ordered_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as messages of an application, folded in order."""
    got = fold.fold_messages(_messages(spark, sf_dir))
    return got.withColumn("evidence_at", F.date_format("evidence_at", "yyyy-MM-dd HH:mm:ss"))


@query(
    "late_guard",
    STATUS
    + """, f AS (SELECT user_id, max(ts) AS since FROM events WHERE event_type = 'purchase' GROUP BY 1),
m AS (SELECT e.*, since, moves AND coalesce(ts < since, false) AS late FROM e LEFT JOIN f ON f.user_id = application_id)
SELECT application_id, coalesce(max_by(to_status, (ts, event_id)) FILTER (WHERE moves AND NOT late), CASE WHEN max(since) IS NULL THEN 'sent' ELSE 'interview' END) AS status,
  strftime(coalesce(max(ts) FILTER (WHERE moves AND NOT late), max(since)), '%Y-%m-%d %H:%M:%S') AS evidence_at,
  count(*) FILTER (WHERE moves AND NOT late) AS n_moves, count(*) AS n_messages, count(*) FILTER (WHERE late) AS n_late FROM m GROUP BY 1""",
)
def late_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ordered_fold, where a user's last purchase is the evidence on file: older messages move nothing."""
    bought = table(spark, sf_dir, "events").filter("event_type = 'purchase'")
    on_file = bought.groupBy(F.col("user_id").alias("application_id")).agg(F.max(F.col("ts").cast("timestamp")).alias("evidence_at")).withColumn("status", F.lit("interview"))
    got = fold.fold_messages(_messages(spark, sf_dir), on_file)
    return got.withColumn("evidence_at", F.date_format("evidence_at", "yyyy-MM-dd HH:mm:ss"))


@query("thread_lessons")
def thread_lessons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which places of a line teach which parts of a supplier: lines as messages, in the order of dates."""
    line = table(spark, sf_dir, "lineitem")
    ident = F.concat_ws("-", F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), "l_linenumber")
    thread = F.concat_ws(" ", "l_returnflag", "l_linenumber")
    told = line.select(F.col("l_suppkey").alias("mailbox"), thread.alias("thread_id"), F.col("l_partkey").alias("application_id"), F.col("l_shipdate").cast("timestamp").alias("received_at"), ident.alias("message_id"))
    return threads.lessons(told, "mailbox").select("mailbox", "thread_id", "application_id", F.col("moment.by").alias("message_id"))


@query(
    "status_machine",
    """WITH e AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'rejected' WHEN 'signup' THEN 'interview' END AS to_status,
  event_id % 10 / 10.0 >= 0.7 AND event_id % 3 <> 0 AND event_type IN ('error', 'signup') AS moves FROM events)
SELECT lpad(CAST(event_id AS VARCHAR), 19, '0') AS application_id, CASE WHEN moves THEN to_status ELSE 'sent' END AS status, CAST(moves AS BIGINT) AS n_moves FROM e""",
)
def status_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transition alone: each event as the only message of an application."""
    got = fold.fold_messages(_messages(spark, sf_dir).withColumn("application_id", F.col("message_id")))
    return got.select("application_id", "status", "n_moves")


@query(
    "counter_expiry",
    """WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS got FROM events GROUP BY 1, 2),
g AS (SELECT *, sum(CASE WHEN got > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY day) AS grp FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, grp ORDER BY day) - CASE WHEN grp > 0 THEN 1 ELSE 0 END AS empty FROM g)
SELECT user_id, max_by(empty, day) AS empty_runs, max(empty) < 4 AS enabled FROM r GROUP BY 1""",
)
def counter_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs without a result in a row, by user and day; off from the fourth on."""
    e = table(spark, sf_dir, "events")
    runs = e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count_if(F.col("event_type") == "purchase").alias("got"))
    return fold.empty_runs(runs, "user_id", "day", "got", 4)


VOTES = "(CASE WHEN contains(t, '{}') THEN 1 ELSE 0 END)"
REFUSE = " + ".join(VOTES.format(w) for w in guards.REJECTION_WORDS)
INVITE = " + ".join(VOTES.format(w) for w in guards.INTERVIEW_WORDS)
ABOUT = " OR ".join(f"contains(t, '{w}')" for w in guards.JOB_WORDS)


@query(
    "udf_classifier",
    f"""WITH d AS (SELECT doc_id, lower(left(text, 40) || chr(10) || text) AS t FROM documents), v AS (SELECT doc_id, t, {REFUSE} AS r, {INVITE} AS i FROM d)
SELECT doc_id, CASE WHEN greatest(r, i) = 0 THEN 'no_reply' WHEN r >= i THEN 'rejection' ELSE 'interview' END AS reply_type,
  CASE WHEN greatest(r, i) = 0 THEN 0.5::DOUBLE ELSE round(least(1.0, 0.6 + 0.2 * greatest(r, i)), 6)::DOUBLE END AS confidence, greatest(r, i) > 0 OR {ABOUT} AS job_related FROM v""",
)
def udf_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 40).alias("subject"), F.col("source").alias("from_address"), F.col("text").alias("body"))
    return guards.classify(d).select("doc_id", "verdict.reply_type", F.round("verdict.confidence", 6).alias("confidence"), "verdict.job_related")


#: An alert of each board, by its sender; # stands for the page's number.
ALERTS = [
    ("a@hh.ru", '<p><a href="https://hh.ru/vacancy/#?from=x">Dev</a></p><p>Fabrika, Omsk</p>', ""),
    ("x@career.habr.com", '<p><a href="https://t/?url=https%3A%2F%2Fcareer.habr.com%2Fvacancies%2F#">Go Dev</a></p><p>Компания: Acme #</p><p>Город: Омск</p><p>Требуемые навыки: Go</p>', ""),
    ("jobs@linkedin.com", '<p><a href="https://www.linkedin.com/comm/jobs/view/#/?x=1">Role #</a></p><p>Company # · Lisbon</p><p>Easy Apply</p>', ""),
    ("x@wellfound.com", "", "Hello,\n\nnew roles for you\n\nBackend Dev  Acme #  / 11-50 Employees  €50k | Remote only, Berlin | Full-time  Actively Hiring\n<https://wellfound.com/jobs/#-backend-dev?utm=1>"),
    ("x@glassdoor.com", '<a href="https://g/jobListing.htm?jobListingId=#"><p>Acme # 4.1 ★</p><p>Eng</p><p>Easy Apply</p><p>Bonn</p></a>', ""),
    ("x@indeed.com", "", "Dev\nAcme # - Bonn\n€50k\nGreat snippet\n2 days ago\nhttps://de.indeed.com/x?a=1&jk=#"),
    ("x@landing.jobs", '<a href="https://t/?url=https%3A%2F%2Flanding.jobs%2Fat%2Facme%2F#">Remote Dev @ Acme #</a>', ""),
    ("x@justjoin.it", '<a href="https://justjoin.it/job-offer/acme-#?x=1"><p>Acme #</p><p>Kraków</p><p>Dev</p><p>10 PLN</p><p>Hybrid, remote</p><p>B2B</p><p>Senior</p><p>3 days</p><p>Apply</p></a>', ""),
    ("x@wysylka.pracuj.pl", '<p><a href="https://www.pracuj.pl/praca/dev-acme,oferta,#?s=1">! Dev</a></p><p><a href="https://www.pracuj.pl/praca/dev-acme,oferta,#">10 000 zł</a></p><p><a href="https://www.pracuj.pl/praca/dev-acme,oferta,#">Acme #</a> Warszawa</p>', ""),
    ("x@elsewhere.com", '<a href="https://hh.ru/vacancy/#">Dev</a>', ""),
]


@query(
    "udtf_split",
    """WITH r(url, company, title, location, is_remote) AS (VALUES
  ('https://hh.ru/vacancy/#', 'Fabrika', 'Dev', 'Omsk', false),
  ('https://career.habr.com/vacancies/#', 'Acme #', 'Go Dev', 'Омск', false),
  ('https://www.linkedin.com/jobs/view/#', 'Company #', 'Role #', 'Lisbon', false),
  ('https://wellfound.com/jobs/#-backend-dev', 'Acme #', 'Backend Dev', 'Berlin', true),
  ('https://www.glassdoor.com/job-listing/j?jl=#', 'Acme #', 'Eng', 'Bonn', false),
  ('https://de.indeed.com/viewjob?jk=#', 'Acme #', 'Dev', 'Bonn', false),
  ('https://landing.jobs/at/acme/#', 'Acme #', 'Remote Dev', NULL, true),
  ('https://justjoin.it/job-offer/acme-#', 'Acme #', 'Dev', 'Kraków', false),
  ('https://pracuj.pl/praca/dev-acme,oferta,#', 'Acme #', 'Dev', 'Warszawa', false))
SELECT 'm' || page_id AS message_id, replace(r.url, '#', CAST(page_id AS VARCHAR)) AS url, replace(company, '#', CAST(page_id AS VARCHAR)) AS company,
  replace(title, '#', CAST(page_id AS VARCHAR)) AS title, location, is_remote FROM pages, r""",
)
def udtf_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as alerts of all boards, each read by its parser through the table function in SQL."""
    mail.register_alerts(spark)
    n = F.col("page_id").cast("string")
    filled = lambda x: F.replace(F.lit(x), F.lit("#"), n)
    boards = F.explode(F.array(*[F.struct(F.lit(s).alias("from_address"), filled(h).alias("html"), filled(t).alias("text")) for s, h, t in ALERTS]))
    alerts = table(spark, sf_dir, "pages").select(F.concat(F.lit("m"), n).alias("message_id"), boards.alias("x")).select("message_id", "x.*")
    return spark.sql("SELECT message_id, url, company, title, location, is_remote FROM {alerts}, LATERAL alert_records(from_address, html, text)", alerts=alerts)
