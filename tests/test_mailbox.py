"""The mailbox source against a stub of its API."""

import base64
import datetime as dt
import json
import re
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest
from pyspark.sql import functions as F

from rankwell.sources import mailbox
from rankwell.streaming import windows

NOW = dt.datetime(2024, 5, 20, 12, tzinfo=dt.timezone.utc)


def message(i, sender, days_ago, labels=("INBOX",), thread=None):
    raw = f"From: {sender}\r\nSubject: No {i}\r\nContent-Type: text/plain; charset=utf-8\r\n\r\nBody {i}\r\n".encode()
    at = int((NOW - dt.timedelta(days=days_ago)).timestamp() * 1000)
    return {"id": f"m{i}", "threadId": thread or f"t{i}", "internalDate": str(at), "labelIds": list(labels), "raw": base64.urlsafe_b64encode(raw).decode().rstrip("=")}


class Stub:
    def __init__(self):
        self.mail, self.seen, self.gone = [], [], set()
        stub = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                url = urlsplit(self.path)
                q = {k: v[0] for k, v in parse_qs(url.query).items()}
                stub.seen.append((url.path, q))
                body = stub.answer(url.path, q)
                self.send_response(200 if body is not None else 404)
                self.end_headers()
                self.wfile.write(json.dumps(body or {}).encode())

            def log_message(self, *args):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_port}/me"

    def matches(self, m, q):
        sender = base64.urlsafe_b64decode(m["raw"] + "==").decode().splitlines()[0].lower()
        at = int(m["internalDate"]) / 1000
        for word in re.findall(r"\S+", q):
            no, (name, value) = word.startswith("-"), word.lstrip("-").split(":", 1)
            hit = {"from": value in sender, "in": value.upper() in m["labelIds"], "category": f"CATEGORY_{value.upper()}" in m["labelIds"], "after": name == "after" and at > int(value), "before": name == "before" and at < int(value), "thread": m["threadId"] == value}.get(name, True)
            if hit == no:
                return False
        return True

    def answer(self, path, q):
        size, at = int(q.get("maxResults", 2)), int(q.get("pageToken", 0))
        if path == "/me/profile":
            return {"historyId": str(100 + len(self.mail))}
        if path == "/me/messages":
            found = [m for m in self.mail if self.matches(m, q.get("q", ""))]
            more = {"nextPageToken": str(at + size)} if at + size < len(found) else {}
            return {"messages": [{"id": m["id"]} for m in found[at : at + size]], **more}
        if path == "/me/history":
            found = [(101 + i, m) for i, m in enumerate(self.mail) if 101 + i > int(q["startHistoryId"])]
            more = {"nextPageToken": str(at + size)} if at + size < len(found) else {}
            return {"history": [{"id": str(n), "messagesAdded": [{"message": {"id": m["id"]}}]} for n, m in found[at : at + size]], **more}
        return next((m for m in self.mail if path == f"/me/messages/{m['id']}" and m["id"] not in self.gone), None)


@pytest.fixture
def stub():
    found = Stub()
    yield found
    found.server.shutdown()


def test_predicates_reach_the_server_and_pages_are_read_once(spark, stub):
    stub.mail = [message(i, f"HR {i} <hr{i}@acme.com>", i) for i in range(9)]
    stub.mail += [message(20, "x@linkedin.com", 1), message(21, "shop@acme.com", 1, ("INBOX", "CATEGORY_PROMOTIONS")), message(22, "a@b.c", 1, ("SENT",)), message(23, "old@acme.com", 90)]
    stub.gone.add("m3")
    got = mailbox.read_recent(spark, stub.url, 5, ("LinkedIn.com",), NOW, page_size=2).select("message_id", "subject", "text", "thread_id", "received_at").collect()
    assert sorted(r.message_id for r in got) == ["m0", "m1", "m2", "m4", "m5"]
    assert {r.subject for r in got} == {f"No {i}" for i in (0, 1, 2, 4, 5)} and all(r.text.strip() == f"Body {r.message_id[1:]}" for r in got)
    lists = [q for p, q in stub.seen if p == "/me/messages"]
    since = int((NOW - dt.timedelta(days=5)).timestamp()) - 1
    asked = lists[0]["q"].split()
    assert sorted(asked) == sorted([f"after:{since}", "-from:linkedin.com", "in:inbox"])
    # every page once, and nothing read that the server could leave out
    tokens = [q.get("pageToken") for q in lists]
    assert tokens == [None, "2", "4", "6"] and sorted({p for p, _ in stub.seen if p.startswith("/me/messages/")}) == [f"/me/messages/m{i}" for i in (0, 1, 2, 21, 3, 4, 5)]


def test_terms_are_never_narrower(spark, stub):
    stub.mail = [message(1, "a@x.com", 0, ("INBOX", "CATEGORY_UPDATES")), message(2, "b@x.com", 0, thread="t1")]
    spark.conf.set(mailbox.PUSHDOWN, "true")
    read = lambda: spark.read.format(mailbox._format(spark)).load(stub.url)
    for where, want, term in [
        ("category = 'updates'", ["m1"], "category:updates"),
        ("category <> 'updates'", [], "-category:updates"),
        ("contains(sender, 'b@')", ["m2"], "from:b@"),
        ("thread_id = 't1'", ["m1", "m2"], "thread:t1"),
        ("received_at < timestamp'2024-05-20 12:00:00'", [], "before:1716206401"),
        ("received_at <= timestamp'2024-05-20 12:00:00'", ["m1", "m2"], "before:1716206401"),
        ("subject = 'No 1'", ["m1"], None),
    ]:
        stub.seen.clear()
        assert sorted(r.message_id for r in read().filter(where).select("message_id").collect()) == want, where
        asked = next(q for p, q in stub.seen if p == "/me/messages").get("q")
        assert asked == term, where


def test_backlog_reads_every_page_without_the_window(spark, stub):
    stub.mail = [message(i, "jobs@acme.com", 40 * i) for i in range(7)]
    got = mailbox.read_backlog(spark, stub.url, "from:acme.com newer_than:30d", page_size=3)
    assert got.count() == 7
    assert [q.get("pageToken") for p, q in stub.seen if p == "/me/messages"] == [None, "3", "6"] and stub.seen[0][1]["q"] == "from:acme.com"


def test_a_restarted_stream_reads_nothing_twice(spark, stub, tmp_path):
    now = dt.datetime.now(dt.timezone.utc)
    age = (NOW - now).total_seconds() / 86400  # the stub's clock is NOW's
    got = []

    def run():
        query = mailbox.stream_arrivals(spark, stub.url, 14).select("message_id").writeStream.foreachBatch(lambda b, _: got.extend(r.message_id for r in b.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        query.awaitTermination(120)

    stub.mail = [message(i, "a@x.com", age + i) for i in range(3)] + [message(3, "a@x.com", age + 30)]
    run()
    assert sorted(got) == ["m0", "m1", "m2"]  # the fourth is older than the window
    reads = len([1 for p, _ in stub.seen if p.startswith("/me/messages/")])
    run()
    assert sorted(got) == ["m0", "m1", "m2"] and len([1 for p, _ in stub.seen if p.startswith("/me/messages/")]) == reads
    stub.mail += [message(5, "a@x.com", age + 2)]  # arrives late, and is read all the same
    run()
    assert sorted(got) == ["m0", "m1", "m2", "m5"]


def test_streams_joined_in_time_are_the_batch(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    mail = [(f"m{i}", f"c{i % 3}", t0 + dt.timedelta(days=i)) for i in range(12)]
    sent = [(i, f"c{i % 3}", t0 + dt.timedelta(days=i // 2)) for i in range(18)]
    a, b = spark.createDataFrame(mail, "message_id string, company string, received_at timestamp"), spark.createDataFrame(sent, "id long, company string, sent_at timestamp")
    join = lambda x, y: windows.joined_in_time(x, y, ["company"], "received_at", "sent_at", "7 days", "0 days", ("60 days", "60 days")).select("message_id", "id")
    want = sorted((m, i) for m, c, r in mail for i, d, s in sent if c == d and r - dt.timedelta(days=7) <= s <= r)
    assert sorted(tuple(x) for x in join(a, b).collect()) == want and want
    got = []
    for k in range(2):
        a.filter(F.col("received_at").between(t0 + dt.timedelta(days=6 * k), t0 + dt.timedelta(days=6 * k + 5.9))).coalesce(1).write.mode("append").parquet(str(tmp_path / "a"))
        b.filter(F.col("id") % 2 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "b"))
        both = join(windows.read_folder(spark, str(tmp_path / "a"), a.schema), windows.read_folder(spark, str(tmp_path / "b"), b.schema))
        query = both.writeStream.foreachBatch(lambda x, _: got.extend(tuple(r) for r in x.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        query.awaitTermination(120)
    assert sorted(got) == want
