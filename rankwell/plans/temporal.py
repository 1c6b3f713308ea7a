"""Times, JSON and windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import times as D
from ..functions import variants as J
from ..streaming import windows as W
from .base import query, table

SHOW = "%Y-%m-%d %H:%M:%S"


def _show(x) -> F.Column:
    return F.date_format(x, "yyyy-MM-dd HH:mm:ss")


@query(
    "time_parse",
    f"""SELECT event_id, strftime(date_trunc('second', ts), '{SHOW}') AS epoch, strftime(date_trunc('second', ts), '{SHOW}') AS iso, strftime(date_trunc('second', ts), '{SHOW}') AS rfc, strftime(date_trunc('millisecond', ts), '{SHOW}') AS millis, true AS bad_is_null FROM events""",
)
def time_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each time rendered in four ways and read back."""
    t = F.col("ts").cast("timestamp")
    s = F.unix_seconds(t)
    return table(spark, sf_dir, "events").select(
        "event_id",
        _show(D.from_epoch(s.cast("string"))).alias("epoch"),
        _show(D.from_iso(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'"))).alias("iso"),
        _show(D.from_rfc822(F.concat(F.lit("Mon, "), F.date_format(t, "dd MMM yyyy HH:mm:ss"), F.lit(" GMT")))).alias("rfc"),
        _show(D.from_epoch_millis(F.unix_millis(t))).alias("millis"),
        (D.from_epoch(F.lit("x")).isNull() & D.from_epoch(F.lit("0")).isNull() & D.from_iso(F.lit("soon")).isNull() & D.from_rfc822(F.lit("?")).isNull()).alias("bad_is_null"),
    )


@query(
    "zone_shift",
    f"""SELECT o_orderkey, strftime((o_orderdate AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Podgorica', '{SHOW}') AS local, strftime((o_orderdate AT TIME ZONE 'Europe/Podgorica') AT TIME ZONE 'UTC', '{SHOW}') AS utc FROM orders""",
)
def zone_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("o_orderdate").cast("timestamp")
    return table(spark, sf_dir, "orders").select("o_orderkey", _show(D.to_wall_clock(t, "Europe/Podgorica")).alias("local"), _show(D.from_wall_clock(t, "Europe/Podgorica")).alias("utc"))


@query(
    "nested_json",
    """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, coalesce(json_extract_string(props, '$.missing.deep'), 'none') AS deep,
  json_type(props) AS kind, CAST(json_extract(props, '$.k') AS VARCHAR) AS k_text, json_extract_string(props, '$.items[0].name') AS first_item FROM events""",
)
def nested_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free-form JSON as a stored variant: paths of any depth, missing levels and wrong kinds are null."""
    p = J.parsed("props")
    got = table(spark, sf_dir, "events").withColumn("p", p)
    return got.select("event_id", J.at("p", "k", "bigint").alias("k"), F.coalesce(J.at("p", "missing.deep"), F.lit("none")).alias("deep"), J.kind("p").alias("kind"), J.at("p", "k").alias("k_text"), J.at("p", "items[0].name").alias("first_item"))


@query("lookback_window", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 14 DAYS")
def lookback(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.crossJoin(F.broadcast(e.agg(F.max("ts").alias("now")))).filter(F.col("ts") >= F.col("now") - F.expr("INTERVAL 14 DAYS")).select("event_id")


@query("tumbling_counts", f"SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '{SHOW}') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.tumbling(W.timed(table(spark, sf_dir, "events")), "1 hour").withColumn("start", _show("start"))


@query("sliding_counts", f"SELECT strftime(w, '{SHOW}') AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 30 MINUTES, ts), time_bucket(INTERVAL 30 MINUTES, ts) - INTERVAL 30 MINUTES]) AS w FROM events) GROUP BY 1, 2")
def sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.sliding(W.timed(table(spark, sf_dir, "events")), "1 hour", "30 minutes").withColumn("start", _show("start"))


@query(
    "session_counts",
    f"""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, strftime(min(ts), '{SHOW}') AS start, count(*) AS n FROM s GROUP BY user_id, sid""",
)
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.sessions(W.timed(table(spark, sf_dir, "events")), "30 minutes").withColumn("start", _show("start"))
