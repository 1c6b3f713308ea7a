"""Messages one by one, oldest first, with what earlier ones taught: in batch and as a stream.

A message has a candidate: the application that its sender, subject or body names. A conclusive
one teaches that application the message's thread, if it has none yet and the thread is nobody's;
messages after it in the thread are matched by the thread, whatever they name. So of the pairs
(thread, application) each thread takes at most one and each application at most one, the
earliest first.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from . import fold


def moment(at: str = "received_at", by: str = "message_id") -> Column:
    """The place of a message in the order in which messages count: no time before all, ties by id."""
    return F.struct(F.col(at).isNotNull().alias("timed"), F.col(at).alias("at"), F.col(by).alias("by"))


def lessons(candidates: DataFrame, mailbox: str) -> DataFrame:
    """``mailbox, thread_id, application_id, moment``: which thread is whose, and since which message.

    ``candidates``: ``mailbox``, thread_id, application_id, received_at, message_id of the messages
    that may teach. Of a pair only its first message counts, so the pairs are aggregated first. A
    pair whose thread and application are in no other is taken at once; what is left of a mailbox,
    threads that name several applications and applications that are named in several threads, is
    one sorted pass over slim rows that keeps only what is taken.
    """
    pairs = candidates.groupBy(mailbox, "thread_id", "application_id").agg(F.min(moment()).alias("moment"))
    for c in ("thread_id", "application_id"):
        pairs = pairs.withColumn(f"_{c}", F.count(F.lit(1)).over(Window.partitionBy(mailbox, c)))
    alone = (F.col("_thread_id") == 1) & (F.col("_application_id") == 1)
    rest = pairs.filter(~alone).select(mailbox, "thread_id", "application_id", "moment")
    order = [mailbox, "moment", "application_id"]

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, threads, applications = None, set(), set()
        for batch in batches:
            keep = []
            for box, t, a in zip(*(batch.column(c).to_pylist() for c in (mailbox, "thread_id", "application_id")), strict=True):
                if box != at:
                    at, threads, applications = box, set(), set()
                take = t not in threads and a not in applications
                keep.append(take)
                if take:
                    threads.add(t)
                    applications.add(a)
            yield batch.filter(pa.array(keep, pa.bool_()))

    settled = rest.repartition(mailbox).sortWithinPartitions(*order).mapInArrow(settle, rest.schema)
    return pairs.filter(alone).select(*rest.columns).unionByName(settled)


REPLY = "message_id string, received_at timestamp, application_id {id}, strategy string, conclusive boolean, taught boolean, late boolean"
_PENDING = "message_id string, thread_id string, application_id {id}, strategy string, conclusive boolean, reply_type string, confidence double, received_at timestamp"


class InOrder(StatefulProcessor):
    """The fold of one mailbox. Messages wait (list state) until the clock of arrivals is ``patience``
    past their time, which an event-time timer tells; then they count in order. Threads and
    applications are map states, so a message reads and writes only its own.

    A message that comes later than that isn't dropped: it counts when it comes, and the status is
    kept from it by the time of the evidence (see ``fold.transition``).
    """

    def __init__(self, ident: str, patience: float):
        self.ident, self.patience = ident, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _PENDING.format(id=self.ident))
        self.threads = handle.getMapState("threads", "thread_id string", f"application_id {self.ident}")
        self.applications = handle.getMapState("applications", f"application_id {self.ident}", f"thread_id string, {fold.STATE}")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        fresh = [r for frame in rows for r in self._plain(frame)]
        ready = self._ready(timerValues)
        later = [tuple(r.values()) for r in fresh if not ready(r)]
        if later:
            self.waiting.appendList(later)
        yield from self._fold(key, [r for r in fresh if ready(r)])
        self._wake(timerValues)

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        """What is on file: the application's thread, status and the time of the evidence behind it."""
        for r in initialState.to_dict("records"):
            ident = r["application_id"].item() if hasattr(r["application_id"], "item") else r["application_id"]
            thread = None if pd.isna(r["thread_id"]) or not r["thread_id"] else r["thread_id"]
            at = None if pd.isna(r["evidence_at"]) else r["evidence_at"].to_pydatetime()
            self.applications.updateValue((ident,), (thread, r["status"], at, 0, 0, 0))
            if thread and (not self.threads.containsKey((thread,)) or ident < self.threads.getValue((thread,))[0]):
                self.threads.updateValue((thread,), (ident,))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in _PENDING.split(", ")]
        held = [dict(zip(names, r, strict=True)) for r in self.waiting.get()] if self.waiting.exists() else []
        ready = self._ready(timerValues)
        later = [r for r in held if not ready(r)]
        self.waiting.clear()
        if later:
            self.waiting.put([tuple(r.values()) for r in later])
        yield from self._fold(key, [r for r in held if ready(r)])
        self._wake(timerValues)

    @staticmethod
    def _plain(frame: pd.DataFrame) -> Iterator[dict]:
        for r in frame[[f.split()[0] for f in _PENDING.split(", ")]].to_dict("records"):
            yield {k: None if v is pd.NaT or not isinstance(v, (list, dict)) and pd.isna(v) else v.to_pydatetime() if isinstance(v, pd.Timestamp) else v.item() if hasattr(v, "item") else int(v) if isinstance(v, float) and k == "application_id" else v for k, v in r.items()}

    def _ready(self, timers: Any):
        now = timers.getCurrentWatermarkInMs() / 1000
        return lambda r: r["received_at"] is None and now > 0 or r["received_at"] is not None and _seconds(r["received_at"]) + self.patience < now

    def _wake(self, timers: Any) -> None:
        """One timer, for the first message that waits."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        names = [f.split()[0] for f in _PENDING.split(", ")]
        times = [dict(zip(names, r, strict=True))["received_at"] for r in self.waiting.get()] if self.waiting.exists() else []
        if times:
            first = min(_seconds(t) + self.patience if t is not None else 0 for t in times)
            self.handle.registerTimer(max(int(first * 1000) + 1, timers.getCurrentWatermarkInMs() + 1))

    def _fold(self, key: Any, messages: list[dict]) -> Iterator[pd.DataFrame]:
        out = []
        for m in sorted(messages, key=lambda m: (m["received_at"] is not None, _seconds(m["received_at"]), m["message_id"])):
            found, strategy, conclusive, taught = m["application_id"], m["strategy"], bool(m["conclusive"]), False
            thread = m["thread_id"] or None
            if thread and self.threads.containsKey((thread,)):
                found, strategy, conclusive = self.threads.getValue((thread,))[0], "thread", True
            state = None
            if found is not None:
                has = self.applications.containsKey((found,))
                of, *values = self.applications.getValue((found,)) if has else (None, *fold.start().values())
                state = dict(zip(fold.start(), values, strict=True))
                if thread and of is None and conclusive and strategy != "thread":
                    of, taught = thread, True
                    self.threads.updateValue((thread,), (found,))
                state = fold.transition(state, m["received_at"], m["reply_type"], m["confidence"], conclusive)
                late = state["n_late"] > values[4]
                self.applications.updateValue((found,), (of, *state.values()))
            out.append((key[0], m["message_id"], m["received_at"], found, strategy, conclusive, taught, bool(state and late), *(state or dict.fromkeys(fold.start())).values()))
        if out:
            names = ["mailbox", *[f.split()[0] for f in REPLY.split(", ")], *fold.start()]
            yield pd.DataFrame(out, columns=names).astype({"application_id": "Int64" if self.ident in ("bigint", "int", "long") else object, **dict.fromkeys(("n_moves", "n_messages", "n_late"), "Int64")})


def _seconds(at: Any) -> float:
    return 0.0 if at is None else (pd.Timestamp(at) - pd.Timestamp(0)).total_seconds() if pd.Timestamp(at).tzinfo is None else pd.Timestamp(at).timestamp()


def replies_stream(messages: DataFrame, applications: DataFrame | None = None, mailbox: str = "mailbox", arrived: str = "arrived_at", patience: float = 3600.0, slack: str = "1 second") -> DataFrame:
    """The fold over a stream of messages with their candidates: one row a message, in the order in
    which it counted, with the state of its application after it.

    ``messages``: ``mailbox``, ``arrived`` (when the reader saw it; out of order by ``slack`` at most),
    message_id, thread_id, application_id, strategy, conclusive (the candidate, if any), reply_type,
    confidence, received_at. ``applications`` on file: ``mailbox``, application_id, thread_id, status,
    evidence_at. A message counts once, however often it arrives within ``slack``; what was recorded
    before is for ``sets.once`` to leave out. Needs the RocksDB state store.
    """
    ident = messages.schema["application_id"].dataType.simpleString()
    kind = messages.schema[mailbox].dataType.simpleString()
    cols = [f.split()[0] for f in _PENDING.split(", ")]
    rows = messages.select(F.col(mailbox).alias("mailbox"), F.col(arrived).alias("arrived_at"), *cols)
    once = rows.withWatermark("arrived_at", slack).dropDuplicatesWithinWatermark(["mailbox", "message_id"])
    schema = f"mailbox {kind}, {REPLY.format(id=ident)}, {fold.STATE}"
    known = None if applications is None else applications.select(F.col(mailbox).alias("mailbox"), "application_id", "thread_id", "status", "evidence_at").groupBy("mailbox")
    return once.groupBy("mailbox").transformWithStateInPandas(InOrder(ident, patience), schema, "Append", "EventTime", known)
