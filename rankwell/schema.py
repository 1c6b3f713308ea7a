"""Schemas of the stored tables, the vocabularies of their enums, and the contract at the door."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .functions import text as T

WIDTH = 255

SOURCE_KINDS = ("rss", "api", "gmail")
BOARD_PROVIDERS = ("greenhouse", "lever", "ashby", "recruitee", "smartrecruiters")
CHANNELS = ("email", "telegram", "form")
STATUSES = ("shortlisted", "drafted", "declined", "ineligible", "closed", "unreachable", "scam", "sent", "rejected", "interview", "no_reply")
REPLY_TYPES = ("rejection", "interview", "no_reply")
REPLYABLE = ("sent", "interview", "rejected")

RECORD = "url string, company string, title string, description string, location string, is_remote boolean, posted_at timestamp, external_id string, apply_channel string"
SOURCES = "id long, name string, kind string, config map<string,string>, enabled boolean, last_run_at timestamp"
JOBS = f"id long, source_id long, {RECORD}, fetched_at timestamp, content_key string, embedding array<float>, passed boolean, blocked boolean, score double, percentile double"
APPLICATIONS = "id long, job_id long, status string, cover_letter string, sent_at timestamp, reply_at timestamp, thread_id string, reply_type string, notes string, created_at timestamp, updated_at timestamp"
BOARDS = "id long, provider string, slug string, discovered_from string, enabled boolean, empty_runs int, last_run_at timestamp, created_at timestamp"
REPLIES = "id long, application_id long, message_id string, thread_id string, from_address string, subject string, body string, received_at timestamp, reply_type string, confidence double, reasoning string, detected_company string, detected_role string, created_at timestamp"
SKIPPED = "message_id string, received_at timestamp, created_at timestamp"


def of(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def fits(x: Column | str) -> Column:
    return F.coalesce(F.length(F.col(x) if isinstance(x, str) else x).between(1, WIDTH), F.lit(False))


def clamp(x: Column | str) -> Column:
    """Cut to the width of the column, not refused."""
    return T.rstrip(F.substring(F.col(x) if isinstance(x, str) else x, 1, WIDTH))


def validate(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected): texts are repaired, then company and title must be 1 to 255 long,
    then location and id are cut. A bad row is rejected alone, not with its source."""
    for c in ("company", "title", "description", "location"):
        records = records.withColumn(c, T.repair_mojibake(c))
    records = records.withColumn("description", F.coalesce("description", F.lit("")))
    good = fits("company") & fits("title") & F.col("url").isNotNull()
    why = F.array_compact(F.array(F.when(~fits("company"), F.lit("company")), F.when(~fits("title"), F.lit("title")), F.when(F.col("url").isNull(), F.lit("url"))))
    valid = records.filter(good).withColumn("location", clamp("location")).withColumn("external_id", clamp("external_id"))
    return valid, records.filter(~good).withColumn("rejected_for", why)


def known(x: Column | str, values: tuple[str, ...]) -> Column:
    """The value in lower case if it is one of the enum's, else null."""
    low = F.lower(F.col(x) if isinstance(x, str) else x)
    return F.when(low.isin(*values), low)
