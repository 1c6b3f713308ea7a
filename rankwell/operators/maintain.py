"""Repair of stored records: each takes a snapshot and gives the next one, or the plan for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import times, urls
from . import rules, sets

#: Which status wins when duplicates are merged.
STATUS_RANK = {"sent": 6, "interview": 5, "rejected": 4, "no_reply": 3, "declined": 2, "drafted": 1, "shortlisted": 0}


def status_rank(status: Column | str) -> Column:
    s = F.col(status) if isinstance(status, str) else status
    ranks = F.create_map(*[F.lit(x) for kv in STATUS_RANK.items() for x in kv])
    return F.coalesce(F.get(F.array(ranks[s]), F.lit(0)), F.lit(-1))


def merge_plan(rows: DataFrame, key: str, ident: str, status: str) -> DataFrame:
    """``rows`` with merged_into and dropped: of a key the highest status stays, then the least id."""
    w = Window.partitionBy(key).orderBy(status_rank(status).desc(), F.asc(ident))
    got = rows.withColumn("merged_into", F.first(ident).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return got.withColumn("dropped", F.col(ident) != F.col("merged_into"))


def merge_on_content_key(records: DataFrame, status: str = "status") -> DataFrame:
    """Records by their content key computed anew; needs id, company, title, url."""
    return merge_plan(records.withColumn("content_key", urls.content_key("company", "title", "url")), "content_key", "id", status)


def refilter(records: DataFrame) -> DataFrame:
    """The records whose verdict the rules have changed, with the new one."""
    return sets.changed(records, records.withColumn("passed", rules.passes()), "id", ["passed"])


def recompute_remote(records: DataFrame, source: Column) -> DataFrame:
    return records.withColumn("is_remote", F.when(source, rules.looks_remote("title", "location", "description")).otherwise(F.col("is_remote")))


def backfill_routes(records: DataFrame) -> DataFrame:
    """apply_channel where it is missing, apply_blocked everywhere."""
    return records.withColumn("apply_channel", F.coalesce("apply_channel", urls.apply_channel("url"))).withColumn("apply_blocked", urls.is_blocked("url"))


def scrub_reader_marks(records: DataFrame, dependants: tuple[str, ...] = ("embedding", "score", "percentile")) -> DataFrame:
    """Texts without the reader mark; what was derived from a changed text becomes null."""
    clean = T.strip_reader_mark("description")
    hit = F.col("description").rlike("(?i)Please mention the word\\b")
    out = records.withColumn("_hit", F.coalesce(hit, F.lit(False))).withColumn("description", F.when(hit, clean).otherwise(F.col("description")))
    for c in dependants:
        if c in records.columns:
            out = out.withColumn(c, F.when(~F.col("_hit"), F.col(c)))
    return out.drop("_hit")


def reclassify(records: DataFrame, status: str, where: Column, to: str) -> tuple[DataFrame, DataFrame]:
    """The snapshot with a new status where the condition holds, and the rows it returned."""
    hit = F.coalesce(where, F.lit(False))
    got = records.withColumn("returned", hit).withColumn(status, F.when(hit, F.lit(to)).otherwise(F.col(status)))
    return got, got.filter("returned")


def unlink(rows: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """The link is null where it points to one of ``gone``."""
    g = gone.select(F.col(key).alias("_gone")).distinct()
    return rows.join(g, rows[key] == g["_gone"], "left").withColumn(key, F.when(F.col("_gone").isNull(), F.col(key))).drop("_gone")


def shift_zone(rows: DataFrame, column: str, zone: str) -> DataFrame:
    """Times that were entered by the clock of ``zone`` but stored as UTC, put right."""
    return rows.withColumn(column, times.reinterpret_zone(column, zone))


def generated(records: DataFrame, source_id: Column | None = None, external_id: Column | None = None) -> DataFrame:
    """The columns that a write derives: the content key always, the channel where it is null."""
    channel = F.coalesce("apply_channel", urls.apply_channel("url")) if "apply_channel" in records.columns else urls.apply_channel("url")
    return records.withColumn("content_key", urls.content_key("company", "title", "url", source_id, external_id)).withColumn("apply_channel", channel)
