"""Clearing mail: which ids, and a sink that applies them one by one by an injected call."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from ..sources import http
from . import resolve, scan, sets


def cause(error: Exception) -> str:
    """Short enough to count by: the status and its reason, without ids or addresses."""
    status, reason = getattr(error, "code", None), getattr(error, "reason", None)
    return f"HTTP {status} {reason or ''}".strip() if status is not None else f"{type(error).__name__}: {error}"[:200]


def rejected_mail(applications: DataFrame, mail: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """``message_id, thread_id`` of mail that came in, in threads of rejected applications that no other
    application shares; of the applications ``ids`` (id) alone, if given.

    ``applications``: id, thread_id, status; ``mail``: message_id, thread_id, labels.
    """
    both = applications.select("thread", "status") if "thread" in applications.columns else applications.select(F.col("thread_id").alias("thread"), "status", "id")
    threads = sets.rejection_threads(both, both.limit(0))
    if ids is not None:
        threads = threads.join(applications.join(ids, "id", "left_semi").select(F.col("thread_id").alias("thread")), "thread", "left_semi")
    return resolve.incoming_in_threads(mail, threads.withColumnRenamed("thread", "thread_id")).select("message_id", "thread_id")


def tidy(alerts: DataFrame, records: DataFrame, stored: DataFrame, applications: DataFrame, mail: DataFrame) -> DataFrame:
    """``message_id, why`` of what may be cleared: alerts whose records are all stored, and rejected mail."""
    done = scan.backlog(alerts, records, stored).filter("done").select("message_id", F.lit("alert").alias("why"))
    gone = rejected_mail(applications, mail).select("message_id", F.lit("rejected").alias("why"))
    return done.unionByName(gone).dropDuplicates(["message_id"])


def clear(ids: DataFrame, trash: Callable[[str], None], policy: http.Policy = http.MAIL) -> DataFrame:
    """``message_id, cleared, cause`` after ``trash`` was called for each id, each in its own right.

    The call has to be harmless when repeated, since a lost task is run again; the result is
    written once.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for m in p["message_id"]:
                try:
                    http.call(lambda m=m: trash(m), policy)
                    rows.append((m, True, None))
                except Exception as e:  # noqa: BLE001  (one failure never stops the rest)
                    rows.append((m, False, cause(e)))
            yield pd.DataFrame(rows, columns=["message_id", "cleared", "cause"])

    return cut(ids.select("message_id").distinct().mapInPandas(run, "message_id string, cleared boolean, cause string"))


def cleared_note(cleared: DataFrame) -> str:
    """How many went, and how many didn't by cause, the most frequent first."""
    tally = {r["cause"]: r["n"] for r in cleared.groupBy("cause").agg(F.count(F.lit(1)).alias("n")).collect()}
    went, failed = tally.pop(None, 0), sorted(tally.items(), key=lambda kv: (-kv[1], kv[0]))
    causes = "; ".join(f"{c} x{n}" for c, n in failed)
    return f"{went} cleared" + (f", {sum(n for _, n in failed)} failed ({causes})" if failed else "")
