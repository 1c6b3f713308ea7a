"""A mailbox behind its web API as a Spark source: predicates go to the server, pages to tasks, arrivals to a stream.

The API is that of a mail service's REST interface: ``/messages?q=&pageToken=`` lists ids, ``/messages/{id}``
gives a message with ``internalDate`` (milliseconds), ``labelIds`` and its ``raw`` text, ``/profile`` the
number of the last change, and ``/history?startHistoryId=`` what was added after one.
"""

from __future__ import annotations

import base64
import json
import urllib.parse
from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from . import http
from .mail import bodies

SCHEMA = (
    "message_id string, thread_id string, sender string, from_address string, subject string, labels array<string>, "
    "inbox boolean, category string, received_at timestamp, text string, html string"
)
CATEGORY = "CATEGORY_"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


class Page(InputPartition):
    """The ids of one page of a listing."""

    def __init__(self, ids: list[str]):
        self.ids = ids


class Api:
    """Calls to one mailbox, tried again by the policy of mail."""

    def __init__(self, options: dict):
        self.base = options["path"].rstrip("/")
        self.size = options.get("pagesize", "100")
        self.query = options.get("q", "")

    def get(self, path: str, **params: str) -> dict:
        at = urllib.parse.urlencode({k: v for k, v in params.items() if v})
        return json.loads(http.fetch(f"{self.base}{path}" + (f"?{at}" if at else ""), policy=http.MAIL))

    def pages(self, path: str, **params: str) -> Iterator[dict]:
        """All pages, from token to token, each once."""
        yield from http.listed(lambda token: (lambda got: {"pages": [got], **got})(self.get(path, pageToken=token or "", maxResults=self.size, **params)), "pages")

    def message(self, ident: str) -> tuple | None:
        """A row of ``SCHEMA``; null if the message has gone since it was listed."""
        try:
            got = self.get(f"/messages/{urllib.parse.quote(ident)}", format="raw")
        except Exception as e:
            if getattr(e, "code", None) in (404, 410):
                return None
            raise
        mail = bodies(base64.urlsafe_b64decode(got.get("raw", "") + "=="))
        labels = got.get("labelIds") or []
        at = datetime.fromtimestamp(int(got["internalDate"]) / 1000, timezone.utc) if got.get("internalDate") else None
        category = next((x.removeprefix(CATEGORY).lower() for x in labels if x.startswith(CATEGORY)), None)
        return (got["id"], got.get("threadId"), mail["from_address"].lower(), mail["from_address"], mail["subject"], labels, "INBOX" in labels, category, at, mail["text"], mail["html"])

    def read(self, page: Page) -> Iterator[tuple]:
        for ident in page.ids:
            row = self.message(ident)
            if row is not None:
                yield row


def _seconds(at: datetime) -> int:
    return int((at if at.tzinfo else at.replace(tzinfo=timezone.utc)).timestamp())


def term(f: ds.Filter) -> str | None:
    """The predicate in the server's language, never narrower than it is; null if it has none.

    Times are whole seconds there and ``after`` leaves its own second out, so bounds are moved outward.
    """
    column = getattr(f, "attribute", None)
    match f:
        case ds.Not(child=ds.StringContains(attribute=("sender",), value=v)) if v and not v.isspace():
            return f'-from:"{v}"' if " " in v else f"-from:{v}"
        case ds.StringContains(attribute=("sender",), value=v) if v and not v.isspace():
            return f'from:"{v}"' if " " in v else f"from:{v}"
        case ds.EqualTo(attribute=("inbox",), value=True):
            return "in:inbox"
        case ds.EqualTo(attribute=("category",), value=v) if v:
            return f"category:{v}"
        case ds.Not(child=ds.EqualTo(attribute=("category",), value=v)) if v:
            return f"-category:{v}"
        case ds.EqualTo(attribute=("thread_id",), value=v) if v:
            return f"thread:{v}"
        case ds.GreaterThanOrEqual(value=v) | ds.GreaterThan(value=v) if column == ("received_at",):
            return f"after:{_seconds(v) - 1}"
        case ds.LessThanOrEqual(value=v) | ds.LessThan(value=v) if column == ("received_at",):
            return f"before:{_seconds(v) + 1}"
    return None


class MailReader(DataSourceReader):
    """Lists the ids that the pushed predicates leave, page by page, and reads each page's messages in a task."""

    def __init__(self, options: dict):
        self.api = Api(options)
        self.terms: list[str] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        for f in filters:
            asked = term(f)
            if asked:
                self.terms.append(asked)
            yield f  # the server rounds, so Spark tests every predicate itself

    def partitions(self) -> list[InputPartition]:
        query = " ".join([self.api.query, *self.terms]).strip()
        pages = (p.get("messages") or [] for p in self.api.pages("/messages", q=query))
        return [Page([m["id"] for m in p]) for p in pages if p] or [Page([])]

    def read(self, partition: Page) -> Iterator[tuple]:
        return self.api.read(partition)


class MailStream(DataSourceStreamReader):
    """What arrives, by the mailbox's own count of changes: an offset is the number of the last change, and a
    batch the messages added between two. A restart goes on from the last one, whatever the clocks say."""

    def __init__(self, options: dict):
        self.api, self.first = Api(options), options.get("since", "0")

    def initialOffset(self) -> dict:
        return {"history": int(self.first)}

    def latestOffset(self) -> dict:
        return {"history": int(self.api.get("/profile")["historyId"])}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        lo, hi, parts, seen = int(start["history"]), int(end["history"]), [], set()
        for page in self.api.pages("/history", startHistoryId=str(lo), historyTypes="messageAdded"):
            ids = []
            for change in page.get("history") or []:
                if lo < int(change["id"]) <= hi:
                    ids += [m["message"]["id"] for m in change.get("messagesAdded") or []]
            fresh = [x for x in dict.fromkeys(ids) if x not in seen]
            seen.update(fresh)
            if fresh:
                parts.append(Page(fresh))
        return parts or [Page([])]

    def read(self, partition: Page) -> Iterator[tuple]:
        return self.api.read(partition)


class Mailbox(DataSource):
    """``spark.read.format("mailbox").load(url)`` and ``spark.readStream``.

    Options: pagesize (ids a page), q (a query in the server's language, joined to what is pushed), since (of a
    stream: the change after which it begins). Predicates on ``sender`` (contains, or not), ``inbox``, ``category``,
    ``thread_id`` and ``received_at`` go to the server if spark.sql.python.filterPushdown.enabled is set.
    """

    @classmethod
    def name(cls) -> str:
        return "mailbox"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MailReader:
        return MailReader(dict(self.options))

    def streamReader(self, schema) -> MailStream:
        return MailStream(dict(self.options))


def _format(spark: SparkSession) -> str:
    spark.dataSource.register(Mailbox)
    return Mailbox.name()


def read_recent(spark: SparkSession, url: str, days: int = 14, exclude: tuple[str, ...] = (), now: datetime | None = None, page_size: int = 100) -> DataFrame:
    """Inbox mail of the last ``days`` before ``now``, without promotions and without some senders; the server
    leaves out the rest. Times count as in the session's time zone."""
    spark.conf.set(PUSHDOWN, "true")
    since = (now or datetime.now(timezone.utc)) - timedelta(days=days)
    got = spark.read.format(_format(spark)).option("pagesize", page_size).load(url)
    got = got.filter(F.col("inbox") & (F.col("received_at") >= F.lit(since)))
    got = got.filter(F.col("category").isNull() | (F.col("category") != "promotions"))
    for s in exclude:
        got = got.filter(~F.contains("sender", F.lit(s.lower())))
    return got


def read_backlog(spark: SparkSession, url: str, query: str, page_size: int = 100) -> DataFrame:
    """All mail that a query finds without its time window, page by page to the end."""
    from ..operators.scan import unbounded_query

    return spark.read.format(_format(spark)).option("pagesize", page_size).option("q", unbounded_query(query)).load(url)


def stream_arrivals(spark: SparkSession, url: str, days: int = 14, since: int = 0, watermark: str = "1 day") -> DataFrame:
    """Mail as it arrives, with a watermark on its time; what is older than ``days`` when it arrives is left."""
    got = spark.readStream.format(_format(spark)).option("since", since).load(url)
    recent = got.filter(F.col("received_at") >= F.current_timestamp() - F.expr(f"INTERVAL {int(days)} DAYS"))
    return recent.withWatermark("received_at", watermark)
