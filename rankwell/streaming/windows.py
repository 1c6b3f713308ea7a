"""Event-time windows; the same functions serve batch and stream.

The engine's own: what they count has no counterpart in a feed of messages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def timed(events: DataFrame, column: str = "ts") -> DataFrame:
    """With a time that windows and watermarks accept (they take no time without a zone)."""
    return events.withColumn(column, F.col(column).cast("timestamp"))


def _late(events: DataFrame, column: str, watermark: str | None) -> DataFrame:
    return events.withWatermark(column, watermark) if watermark else events


def tumbling(events: DataFrame, width: str, by: str = "event_type", column: str = "ts", watermark: str | None = None) -> DataFrame:
    got = _late(events, column, watermark).groupBy(F.window(column, width), by).agg(F.count(F.lit(1)).alias("n"))
    return got.select(F.col("window.start").alias("start"), by, "n")


def sliding(events: DataFrame, width: str, step: str, by: str = "event_type", column: str = "ts", watermark: str | None = None) -> DataFrame:
    got = _late(events, column, watermark).groupBy(F.window(column, width, step), by).agg(F.count(F.lit(1)).alias("n"))
    return got.select(F.col("window.start").alias("start"), by, "n")


def sessions(events: DataFrame, gap: str, by: str = "user_id", column: str = "ts", watermark: str | None = None) -> DataFrame:
    got = _late(events, column, watermark).groupBy(F.session_window(column, gap), by).agg(F.count(F.lit(1)).alias("n"))
    return got.select(by, F.col("session_window.start").alias("start"), "n")


def read_folder(spark, path: str, schema: str) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def write_once(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Everything that is there now, written as Parquet; a restart goes on where it stopped."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def joined_in_time(left: DataFrame, right: DataFrame, keys: list[str], at: str, other_at: str, before: str, after: str, watermarks: tuple[str, str] = ("1 day", "1 day")) -> DataFrame:
    """Rows of two streams (or tables) with equal keys, where ``other_at`` of the right lies from ``before`` before
    ``at`` of the left to ``after`` after it. Both have watermarks, so each side's state is held only as
    long as the other may still bring a match."""
    a, b = left.withWatermark(at, watermarks[0]), right.withWatermark(other_at, watermarks[1])
    b = b.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in b.columns])
    same = None
    for k in keys:
        eq = F.col(k) == F.col(f"_r_{k}")
        same = eq if same is None else same & eq
    near = F.col(other_at).between(F.col(at) - F.expr(f"INTERVAL {before}"), F.col(at) + F.expr(f"INTERVAL {after}"))
    return a.join(b, same & near).drop(*[f"_r_{k}" for k in keys])
