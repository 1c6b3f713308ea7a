"""Paged HTTP sources as a Python data source: one partition for each variant of parameters.

Retries live in the reader: a task that Spark repeats would repeat refusals as well.
"""

from __future__ import annotations

import json
import random
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

Opener = Callable[[str], bytes]


def transient(error: Exception) -> bool:
    """Worth another try: timeouts, too many requests, failures of the server."""
    if isinstance(error, urllib.error.HTTPError):
        return error.code == 429 or error.code >= 500
    return isinstance(error, (TimeoutError, ConnectionError, urllib.error.URLError))


#: Reasons of a refusal (403) that waiting cures.
QUOTA = ("rateLimitExceeded", "userRateLimitExceeded", "Quota exceeded")


def over_quota(error: Exception) -> bool:
    """As ``transient`` for failures with a status, and refusals for the quota's sake; no others."""
    code = getattr(error, "code", None)
    if code == 403:
        return any(q in f"{getattr(error, 'reason', '')} {getattr(error, 'details', '')}" for q in QUOTA)
    return isinstance(code, int) and (code == 429 or code >= 500)


@dataclass(frozen=True)
class Policy:
    """How often a call is tried, and the delays between: a random part of a doubling one."""

    attempts: int = 3
    delay: float = 1.0
    longest: float = 60.0
    retry: Callable[[Exception], bool] = transient
    sleep: Callable[[float], None] = time.sleep


FEED = Policy()
#: A quota counts by the minute: seven tries outlast it.
MAIL = Policy(attempts=7, delay=2.0, retry=over_quota)


def call[T](what: Callable[[], T], policy: Policy = FEED) -> T:
    """``what()``, tried again after failures that the policy retries."""
    for k in range(policy.attempts):
        try:
            return what()
        except Exception as e:
            if k + 1 == policy.attempts or not policy.retry(e):
                raise
            policy.sleep(random.uniform(0, min(policy.longest, policy.delay * 2**k)))
    raise AssertionError("unreachable")


def fetch(url: str, opener: Opener | None = None, policy: Policy = FEED) -> bytes:
    read = opener or (lambda u: urllib.request.urlopen(u, timeout=30).read())
    return call(lambda: read(url), policy)


def listed(page: Callable[[str | None], dict], items: str, token: str = "nextPageToken") -> Iterator:
    """The items of all pages of a listing, from token to token."""
    at = None
    while True:
        got = page(at)
        yield from got.get(items, [])
        at = got.get(token)
        if not at:
            return


def pages(base: str, variant: dict, page: str = "page", first: int = 1, most: int = 5, items: str = "", opener: Opener | None = None, pause: float = 0.0) -> Iterator[dict]:
    """The items of a variant's pages, up to its first empty page; without ``page`` there is one."""
    for k in range(first, first + (most if page else 1)):
        params = urllib.parse.urlencode({**variant, **({page: k} if page else {})})
        payload = json.loads(fetch(f"{base}?{params}" if params else base, opener))
        found = payload.get(items, []) if items else payload
        if not found:
            return
        yield from found
        if pause:
            time.sleep(pause)


class Variant(InputPartition):
    def __init__(self, params: dict):
        self.params = params


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [Variant(v) for v in json.loads(self.options.get("variants", "[{}]"))]

    def read(self, partition: Variant) -> Iterator[tuple]:
        o = self.options
        if o.get("raw"):
            # the whole body of each address, as it is
            yield (fetch(o["path"] + partition.params.get("_path", "")).decode("utf-8", "replace"),)
            return
        for item in pages(o["path"], partition.params, o.get("page", "page"), int(o.get("first", 1)), int(o.get("pages", 5)), o.get("items", ""), pause=float(o.get("pause", 0))):
            yield (json.dumps(item),)


class PagedJson(DataSource):
    """``spark.read.format("paged_json").option("variants", ...).load(url)``: a row of JSON for each item.

    Options: variants (a JSON array of parameter sets, a partition each), page (the parameter
    that counts pages; empty: one page), first, pages, items (the field that holds the items;
    empty: the payload is the array), pause (seconds), raw (the body of ``url`` and the
    variant's ``_path`` as one row)."""

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)
