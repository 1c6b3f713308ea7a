"""Messages folded into the state of applications: in batch, and as a stream.

The transition is one pure function, which the stream calls for each message; the batch fold
gives the same in aggregates.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONFIDENT = 0.7
MOVES = {"rejection": "rejected", "interview": "interview"}
REPLYABLE = ("sent", "interview", "rejected")

STATE = "status string, evidence_at timestamp, n_moves long, n_messages long, n_late long"


def transition(state: dict, received_at: Any, reply_type: str | None, confidence: float | None, conclusive: bool | None) -> dict:
    """The state after a message.

    A message moves the status if its type has one, the match is conclusive and the
    classifier confident, and nothing newer has moved it: a message older than the evidence
    behind the status is linked but moves nothing (late).
    """
    out = dict(state, n_messages=state["n_messages"] + 1)
    if state["status"] not in REPLYABLE or not conclusive or (confidence or 0.0) < CONFIDENT or reply_type not in MOVES:
        return out
    if received_at is not None and state["evidence_at"] is not None and received_at < state["evidence_at"]:
        out["n_late"] += 1
        return out
    out.update(status=MOVES[reply_type], evidence_at=received_at or state["evidence_at"], n_moves=state["n_moves"] + 1)
    return out


def start() -> dict:
    return {"status": "sent", "evidence_at": None, "n_moves": 0, "n_messages": 0, "n_late": 0}


def fold_messages(messages: DataFrame, on_file: DataFrame | None = None) -> DataFrame:
    """``application_id`` with its state after all messages, oldest first (no time before all, ties by
    message_id).

    ``messages``: application_id, message_id, received_at, reply_type, confidence, conclusive.
    ``on_file``: application_id, status, evidence_at, where a status and its evidence are known before.
    A message counts once, however often it occurs. In the order of time nothing is late but what is
    older than the evidence on file, so the last message that may move decides, and aggregates
    say all of the state; only a stream sees messages out of order and folds them one by one.
    """
    once = messages.dropDuplicates(["message_id"])
    before, since = F.lit("sent"), F.lit(None).cast("timestamp")
    if on_file is not None:
        # one row an application: the aggregates carry it along
        once = once.join(on_file.select("application_id", F.col("status").alias("_before"), F.col("evidence_at").alias("_since")), "application_id", "left")
        before, since = F.coalesce("_before", F.lit("sent")), F.col("_since")
    able = F.coalesce(F.col("conclusive") & (F.col("confidence") >= CONFIDENT) & F.col("reply_type").isin(*MOVES) & before.isin(*REPLYABLE), F.lit(False))
    late = able & F.coalesce(F.col("received_at") < since, F.lit(False))
    moves = able & ~late
    to = F.create_map(*[F.lit(x) for kv in MOVES.items() for x in kv])[F.col("reply_type")]
    last = F.max_by(F.when(moves, to), F.when(moves, F.struct("received_at", "message_id")))
    return once.groupBy("application_id").agg(
        F.coalesce(last, F.max(before)).alias("status"),
        F.coalesce(F.max(F.when(moves, F.col("received_at"))), F.max(since)).alias("evidence_at"),
        F.count_if(moves).alias("n_moves"),
        F.count(F.lit(1)).alias("n_messages"),
        F.count_if(late).alias("n_late"),
    )


def empty_runs(runs: DataFrame, key: str, at: str, got: str, most: int) -> DataFrame:
    """``key, empty_runs, enabled``: runs without a result in a row at the end; off once there were ``most``."""
    w = Window.partitionBy(key).orderBy(at)
    grouped = runs.withColumn("_grp", F.sum((F.col(got) > 0).cast("int")).over(w))
    within = Window.partitionBy(key, "_grp").orderBy(at)
    counted = grouped.withColumn("_empty", F.row_number().over(within) - F.when(F.col("_grp") > 0, 1).otherwise(0))
    return counted.groupBy(key).agg(F.max_by("_empty", at).cast("long").alias("empty_runs"), (F.max("_empty") < most).alias("enabled"))


def next_counter(empty: Column, found: Column, enabled: Column, most: int = 4) -> tuple[Column, Column]:
    """The counter and the switch after one more run."""
    count = F.when(found > 0, 0).otherwise(empty + 1)
    return count, enabled & (count < most)


def fold_stream(messages: DataFrame, watermark: str = "14 days") -> DataFrame:
    """The fold over a stream: a row for each application that a micro-batch touches.

    Messages are taken once within the watermark; the state of an application is its status
    and the time of the evidence behind it, which is what judges late messages.
    """
    kind = messages.schema["application_id"].dataType.simpleString()
    once = messages.withWatermark("received_at", watermark).dropDuplicatesWithinWatermark(["message_id"])

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        now = dict(zip(("status", "evidence_at", "n_moves", "n_messages", "n_late"), state.get, strict=True)) if state.exists else start()
        rows = pd.concat(list(batches)).sort_values(["received_at", "message_id"], na_position="first")
        for r in rows.itertuples(index=False):
            at = None if pd.isna(r.received_at) else r.received_at
            now = transition(now, at, r.reply_type, r.confidence, r.conclusive)
        state.update(tuple(now.values()))
        yield pd.DataFrame([{"application_id": key[0], **now}])

    schema = f"application_id {kind}, {STATE}"
    return once.groupBy("application_id").applyInPandasWithState(run, schema, STATE, "update", "NoTimeout")


def consume(batch: DataFrame, recorded: DataFrame, skipped: DataFrame, key: str = "message_id") -> DataFrame:
    """What a micro-batch has that is neither recorded nor a tombstone; each message once."""
    known = recorded.select(key).union(skipped.select(key)).distinct()
    return batch.dropDuplicates([key]).join(known, key, "left_anti")


def tombstones(messages: DataFrame, verdicts: Column) -> DataFrame:
    """Ids alone of the messages that are unrelated: nothing of their content is kept."""
    return messages.filter(verdicts).select("message_id", "received_at")
