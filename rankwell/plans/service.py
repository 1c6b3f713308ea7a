"""Operators of the message service, the boards and the cells, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import times as D
from ..functions import urls as U
from ..functions import vectors as X
from ..functions import vocabulary as V
from ..operators import discover, mailbox, maintain, reports, resolve, scan
from .base import query, table
from .relational import HOST
from .textual import quoted

SHOW = "%Y-%m-%d %H:%M:%S"


@query("tally_note", "SELECT string_agg(n || ' ' || o_orderstatus, ', ' ORDER BY n DESC, o_orderstatus) AS note FROM (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1)")
def tally_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by verdict, as one line of text."""
    return reports.note(reports.tally(table(spark, sf_dir, "orders"), "o_orderstatus"), "o_orderstatus")


@query("totals_report", "SELECT (SELECT count(*) FROM labels) AS jobs, (SELECT count(*) FROM labels WHERE quality = 1) AS passed, (SELECT count(toxic) FROM labels) AS scored, (SELECT max(toxic)::DOUBLE FROM labels) AS top_score, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS sent")
def totals_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab, o = table(spark, sf_dir, "labels"), table(spark, sf_dir, "orders")
    return reports.totals(lab.select((F.col("quality") == 1).alias("passed"), F.col("toxic").cast("double").alias("score")), o.select(F.when(F.col("o_orderstatus") == "F", "sent").otherwise("open").alias("status")))


@query(
    "similar_applications",
    """WITH r AS (SELECT event_id AS reply_id, user_id, ts FROM events WHERE event_type = 'signup'),
a AS (SELECT o_orderkey AS application_id, o_custkey, o_orderpriority, o_orderdate FROM orders),
s AS (SELECT reply_id, application_id, 'same employer' AS reason FROM r JOIN a ON o_custkey = user_id),
t AS (SELECT reply_id, application_id, 'employer named in the title' AS reason FROM r JOIN a ON o_custkey + 1 = user_id AND o_custkey <> user_id)
SELECT * FROM s UNION ALL SELECT * FROM t""",
)
def similar_applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups as replies of customers; orders as applications, whose title names the next customer."""
    e, o = table(spark, sf_dir, "events"), table(spark, sf_dir, "orders")
    name = lambda c: F.concat(F.lit("Customer "), F.lpad(c.cast("string"), 9, "0"))
    replies = e.filter("event_type = 'signup'").select(F.col("event_id").alias("id"), name(F.col("user_id")).alias("detected_company"), F.lit(None).cast("string").alias("detected_role"), F.col("ts").cast("timestamp").alias("received_at"))
    apps = o.select(F.col("o_orderkey").alias("id"), name(F.col("o_custkey")).alias("company"), F.concat(F.lit("Clerk at "), name(F.col("o_custkey") + 1)).alias("title"), F.col("o_orderdate").cast("timestamp").alias("sent_at"))
    return resolve.similar_applications(replies, apps)


@query(
    "same_role_week",
    """WITH r AS (SELECT event_id AS reply_id, user_id, ts FROM events WHERE event_type = 'error'),
w AS (SELECT reply_id, max(event_id) AS application_id, count(*) AS n FROM r JOIN (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase') p
  ON p.user_id = r.user_id AND p.ts BETWEEN r.ts - INTERVAL 7 DAYS AND r.ts + INTERVAL 7 DAYS GROUP BY 1)
SELECT reply_id, application_id, 'same role, sent the same week' AS reason FROM w WHERE n = 1""",
)
def same_role_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors as replies of unknown employers, purchases as applications; a user is a role."""
    e = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    role = F.concat(F.lit("engineer "), F.col("user_id").cast("string"))
    replies = e.filter("event_type = 'error'").select(F.col("event_id").alias("id"), F.lit("Nobody").alias("detected_company"), role.alias("detected_role"), F.col("at").alias("received_at"))
    apps = e.filter("event_type = 'purchase'").select(F.col("event_id").alias("id"), F.lit("Somebody").alias("company"), role.alias("title"), F.col("at").alias("sent_at"))
    return resolve.similar_applications(replies, apps)


@query(
    "sent_threads",
    """WITH a AS (SELECT min(o_orderkey) AS id, o_custkey, TIMESTAMP '2024-01-02' AS sent_at FROM orders GROUP BY o_custkey),
n AS (SELECT a.id, event_id FROM a JOIN events m ON m.event_type = 'click' AND m.user_id = a.o_custkey AND m.ts BETWEEN a.sent_at - INTERVAL 1 DAY AND a.sent_at + INTERVAL 3 DAYS)
SELECT id, CAST(max(event_id) AS VARCHAR) AS thread_id FROM n GROUP BY 1 HAVING count(DISTINCT event_id) = 1""",
)
def sent_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks as sent mail, each its own thread; a customer's first order as the application."""
    e, o = table(spark, sf_dir, "events"), table(spark, sf_dir, "orders")
    name = lambda c: F.concat(F.lit("Customer#"), F.lpad(c.cast("string"), 9, "0"))
    mail = e.filter("event_type = 'click'").select(F.col("event_id").cast("string").alias("thread_id"), F.concat(F.lit("to "), name(F.col("user_id")), F.lit(" <x@y.z>")).alias("to_text"), F.col("ts").cast("timestamp").alias("sent_at"))
    apps = o.groupBy("o_custkey").agg(F.min("o_orderkey").alias("id")).select("id", name(F.col("o_custkey")).alias("company"), F.lit("2024-01-02").cast("timestamp").alias("sent_at"))
    return resolve.sent_threads(apps, mail)


@query(
    "tidy_mailbox",
    """WITH t AS (SELECT CAST(o_custkey AS VARCHAR) AS thread, bool_and(o_custkey % 2 = 0 OR o_orderstatus = 'F') AS gone FROM orders GROUP BY 1),
rejected AS (SELECT 'e' || event_id AS message_id FROM events JOIN t ON thread = CAST(user_id AS VARCHAR) WHERE gone AND event_type <> 'signup'),
k AS (SELECT DISTINCT text FROM conversations WHERE role = 'user' OR conv_id % 2 = 0), c AS (SELECT conv_id, bool_and(k.text IS NOT NULL) AS done FROM conversations c LEFT JOIN k ON k.text = c.text GROUP BY 1)
SELECT message_id, 'rejected' AS why FROM rejected UNION ALL SELECT 'c' || conv_id, 'alert' FROM c WHERE done""",
)
def tidy_mailbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as applications of a customer's thread, events as its mail (signups are own mail);
    conversations as alerts whose turns are records, of which those of users and of even conversations are stored."""
    e, o, c = (table(spark, sf_dir, t) for t in ("events", "orders", "conversations"))
    apps = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("thread_id"), F.when((F.col("o_custkey") % 2 == 0) | (F.col("o_orderstatus") == "F"), "rejected").otherwise("sent").alias("status"))
    mail = e.select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("message_id"), F.col("user_id").cast("string").alias("thread_id"), F.when(F.col("event_type") == "signup", F.array(F.lit("SENT"))).otherwise(F.array(F.lit("INBOX"))).alias("labels"))
    records = c.select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("message_id"), F.sha2("text", 256).alias("content_key"))
    stored = c.filter("role = 'user' OR conv_id % 2 = 0").select(F.sha2("text", 256).alias("content_key"))
    return mailbox.tidy(records.select("message_id").distinct(), records, stored, apps, mail)


@query(
    "recompute_remote",
    f"""SELECT doc_id, CASE WHEN lang <> 'en' THEN true WHEN regexp_matches(t, {quoted('(?i)' + V.EXPLICIT_REMOTE)}) THEN true WHEN regexp_matches(t, {quoted('(?i)' + V.HYBRID)}) THEN false
ELSE regexp_matches(t, {quoted('(?i)' + V.REMOTE_HINT)}) END AS is_remote FROM (SELECT doc_id, lang, left(text, 30) || chr(10) || source || chr(10) || text AS t FROM documents)""",
)
def recompute_remote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flag anew for the records of some sources (the English ones), all others as they were."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.substring("text", 1, 30).alias("title"), F.col("source").alias("location"), F.col("text").alias("description"), F.lit(True).alias("is_remote"))
    return maintain.recompute_remote(d, F.col("lang") == "en").select("doc_id", "is_remote")


@query(
    "backfill_routes",
    f"SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'email' WHEN 1 THEN 'telegram' ELSE 'form' END AS apply_channel, page_id % 3 = 2 AND ({HOST} IN ('adzuna.com', 'adzuna.ca', 'remoteok.com')) AS apply_blocked FROM pages",
)
def backfill_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 3
    p = table(spark, sf_dir, "pages").select("page_id", F.when(k == 0, "mailto:x@y.z").when(k == 1, "https://t.me/x").otherwise(F.col("url")).alias("url"), F.when(k == 0, "email").alias("apply_channel"))
    return maintain.backfill_routes(p).select("page_id", "apply_channel", "apply_blocked")


@query("confirm_board", "SELECT s_suppkey, s_suppkey % 2 = 0 OR s_nationkey < 10 AS confirmed FROM supplier")
def confirm_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boards of every second supplier say its name, those of some nations have one of its roles, and all
    have a slug that says no more than the board does."""
    s = table(spark, sf_dir, "supplier")
    said = F.when(F.col("s_suppkey") % 2 == 0, F.upper("s_name")).otherwise(F.lit("first-slug"))
    titles = F.when(F.col("s_nationkey") < 10, F.array(F.lit("Other"), F.lit("dev-OPS!"))).otherwise(F.array(F.lit("Other")))
    got = s.select("s_suppkey", F.col("s_name").alias("company"), F.lit("first-slug").alias("slug"), F.array(F.lit("Dev Ops")).alias("titles"), said.alias("board"), titles.alias("board_titles"))
    return got.select("s_suppkey", discover.confirms("company", "slug", "titles", "board", "board_titles").alias("confirmed"))


@query(
    "discovery_counters",
    """SELECT s_name AS slug, CASE WHEN s_nationkey < 5 THEN s_suppkey % 4 WHEN s_acctbal > 0 THEN 0 ELSE s_suppkey % 4 + 1 END AS empty_runs,
  CASE WHEN s_nationkey < 5 THEN true WHEN s_acctbal > 0 THEN true ELSE s_suppkey % 4 + 1 < 4 END AS enabled FROM supplier""",
)
def discovery_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boards after a run: those of some nations weren't read, those with a balance gave something."""
    s = table(spark, sf_dir, "supplier")
    boards = s.select(F.lit("lever").alias("provider"), F.col("s_name").alias("slug"), F.lit(True).alias("enabled"), (F.col("s_suppkey") % 4).cast("int").alias("empty_runs"))
    results = s.filter("s_nationkey >= 5").select(F.lit("lever").alias("provider"), F.col("s_name").alias("slug"), (F.col("s_acctbal") > 0).cast("int").alias("found"))
    return discover.after_run(boards, results).select("slug", F.col("empty_runs").cast("long").alias("empty_runs"), "enabled")


@query("vector_bytes", "SELECT vec_id, 256 AS bytes, true AS same FROM embeddings")
def vector_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as stored bytes, four a number, and read back."""
    e = table(spark, sf_dir, "embeddings").withColumn("blob", X.pack("embedding"))
    return e.select("vec_id", F.octet_length("blob").alias("bytes"), (X.unpack("blob") == F.col("embedding").cast("array<float>")).alias("same"))


@query(
    "wall_clock",
    """SELECT o_orderkey, strftime((o_orderdate AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Podgorica', '%Y-%m-%d %H:%M') || CASE WHEN date_diff('minute', o_orderdate, (o_orderdate AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Podgorica') = 120 THEN ' CEST' ELSE ' CET' END AS shown, true AS read_back, true AS wrong_is_null FROM orders""",
)
def wall_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times as a reviewer's clock shows them, read back; with the other zone's name they are refused."""
    zone, t = "Europe/Podgorica", F.col("o_orderdate").cast("timestamp")
    shown = D.show_wall_clock(t, zone)
    wrong = F.when(shown.endswith("CEST"), F.replace(shown, F.lit("CEST"), F.lit("CET"))).otherwise(F.replace(shown, F.lit("CET"), F.lit("CEST")))
    back = D.parse_wall_clock(shown, zone)
    return table(spark, sf_dir, "orders").select("o_orderkey", shown.alias("shown"), (back == F.date_trunc("minute", t)).alias("read_back"), D.parse_wall_clock(wrong, zone).isNull().alias("wrong_is_null"))


SAFE = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '>', '&gt;'), '<', '&lt;'), chr(39), '&#39;'), chr(34), '&#34;')"


@query(
    "cell_formats",
    f"""SELECT page_id, '<a href="' || {SAFE.format('url')} || '" target="_blank" rel="noopener">' || {SAFE.format('url')} || '</a>' AS link,
  '<div style="white-space: pre-wrap; overflow-wrap: anywhere; max-width: 60rem">' || {SAFE.format('html')} || '</div>' AS body FROM pages""",
)
def cell_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.link("url").alias("link"), T.multiline("html").alias("body"))


@query(
    "route_threads",
    """WITH m AS (SELECT conv_id || '-' || turn AS message_id, conv_id FROM conversations)
SELECT message_id, o_orderkey AS application_id, 'thread' AS strategy, true AS conclusive FROM m JOIN orders ON o_orderkey = conv_id""",
)
def route_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored replies of a board, matched anew: only their threads count."""
    c, o = table(spark, sf_dir, "conversations"), table(spark, sf_dir, "orders")
    replies = c.select(F.concat_ws("-", "conv_id", "turn").alias("message_id"), F.col("conv_id").cast("string").alias("thread_id"), F.lit("x@linkedin.com").alias("from_address"), F.lit("s").alias("subject"), F.col("text").alias("body"), F.lit("2024-01-01").cast("timestamp").alias("received_at"), F.lit(None).cast("long").alias("application_id"))
    apps = o.select(F.col("o_orderkey").alias("id"), F.lit("Acme").alias("company"), F.col("o_orderkey").cast("string").alias("thread_id"), F.col("o_orderdate").cast("timestamp").alias("sent_at"))
    return scan.relink(replies, apps)


@query("reader_mark_repair", r"SELECT doc_id, regexp_replace(text, '\s+$', '') AS description, CASE WHEN lang <> 'en' THEN 1.0::DOUBLE END AS score FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, text, 1.0 FROM documents WHERE lang <> 'en'")
def reader_mark_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English documents carry the mark and lose it, and what was derived from them."""
    mark = F.lit("\n\nPlease mention the word **GREAT** when applying to show you read this. It is so that we see they're human.")
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("lang") == "en", F.concat("text", mark)).otherwise(F.col("text")).alias("description"), F.lit(1.0).alias("score"))
    return maintain.scrub_reader_marks(d, ("score",)).select("doc_id", "description", "score")
