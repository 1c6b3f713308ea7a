import dataclasses
import datetime
import json
import threading
import urllib.error
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest

from rankwell.sources import feeds, http, mail, registry


def write(tmp_path, name, content):
    p = tmp_path / name
    p.write_text(content if isinstance(content, str) else json.dumps(content), encoding="utf-8")
    return str(p)


RSS = '<rss version="2.0" xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel>{}</channel></rss>'


def test_json_feeds(spark, tmp_path):
    p = write(tmp_path, "r.json", {"0-legal": "x", "jobs": [{"id": 1, "url": "https://a/1", "title": "Dev", "company_name": "Acme", "publication_date": "2026-01-02T03:04:05", "candidate_required_location": "EU", "description": "<p>Hi</p>"}, {"id": 2, "title": "no url"}]})
    r = feeds.remotive(spark, p, {}).collect()
    assert len(r) == 1 and (r[0].company, r[0].description, r[0].location, r[0].external_id, r[0].is_remote) == ("Acme", "Hi", "EU", "1", True) and str(r[0].posted_at) == "2026-01-02 03:04:05"
    p = write(tmp_path, "ok.json", [{"legal": "metadata"}, {"id": "7", "date": "2026-01-02T00:00:00+00:00", "company": "Patti&amp;More!", "position": "Eng", "apply_url": "https://b/7", "description": "x"}])
    r = feeds.remoteok(spark, p, {}).collect()
    assert [(x.company, x.url) for x in r] == [("Patti&More!", "https://b/7")]
    p = write(tmp_path, "m.json", {"results": [{"id": 5, "name": "N", "company": {"name": "C"}, "locations": [{"name": "Berlin"}, {"name": "Flexible / Remote"}], "contents": "<b>t</b>", "refs": {"landing_page": "https://m/5"}}]})
    r = feeds.themuse(spark, p, {}).first()
    assert r.location == "Berlin, Flexible / Remote" and r.is_remote
    p = write(tmp_path, "z.json", {"results": [{"id": 5, "title": "Dev <b>x</b>", "company": {"display_name": "C"}, "location": None, "description": "Fully remote", "redirect_url": "https://z", "created": "bad"}]})
    r = feeds.adzuna(spark, p, {}).first()
    assert r.title == "Dev x" and r.is_remote and r.posted_at is None


def test_xml_feeds(spark, tmp_path):
    item = "<item><title>{}</title><region>EU</region><link>https://w/{}?utm=1</link><guid>https://teletype.in/@me/g{}</guid><pubDate>Tue, 04 Aug 2026 10:00:00 +0000</pubDate><description>&lt;p&gt;Body&lt;/p&gt;</description>{}</item>"
    encoded = "<content:encoded><![CDATA[<p>{}</p><p>text</p>]]></content:encoded>"
    p = write(tmp_path, "w.rss", RSS.format(item.format("Acme: Dev: Ops", 1, 1, "") + item.format("No separator", 2, 2, encoded.format("Офис Минск"))))
    r = feeds.weworkremotely(spark, p, {}).collect()
    assert [(x.company, x.title, x.location, x.description) for x in r] == [("Acme", "Dev: Ops", "EU", "Body")] and str(r[0].posted_at) == "2026-08-04 10:00:00"
    # the first line is the place by its words, cut; remote by the word in the raw body
    long = "Hybrid, Kyiv " + "x" * 300
    posts = [item.format(f"P{i}", i, i, encoded.format(t)) for i, t in enumerate(["Офис Минск", "Relocation only", long, "Berlin<i title='remote'>!</i>", "Remote OK"])] + [item.format("", 9, 9, ""), item.format("No body", 8, 8, "").replace("&lt;p&gt;Body&lt;/p&gt;", "")]
    r = {x.external_id: x for x in feeds.teletype(spark, write(tmp_path, "t.rss", RSS.format("".join(posts))), {"author": "me"}).collect()}
    assert set(r) == {"g0", "g1", "g2", "g3", "g4"}
    assert [r[f"g{i}"].location for i in range(5)] == [None, "Relocation only", long[:200], None, "Remote OK"]
    assert [r[f"g{i}"].is_remote for i in range(5)] == [False, False, False, True, True]
    assert r["g0"].company == "Teletype (me)" and r["g0"].url == "https://w/0" and r["g0"].description == "Офис Минск\ntext"


def test_boards(spark, tmp_path):
    p = write(tmp_path, "g.json", {"jobs": [{"id": 1, "title": "T", "absolute_url": "https://g/1", "location": {"name": "Remote"}, "content": "&lt;p&gt;x&lt;/p&gt;"}]})
    assert feeds.greenhouse(spark, p, {"slug": "acme"}).first().description == "x"
    p = write(tmp_path, "l.json", [{"id": "a", "text": "T", "hostedUrl": "https://l/a", "createdAt": 1785837600000, "workplaceType": "remote", "categories": {"location": "X"}}])
    r = feeds.lever(spark, p, {"slug": "acme"}).first()
    assert r.is_remote and str(r.posted_at) == "2026-08-04 10:00:00"
    p = write(tmp_path, "s.json", {"content": [{"id": "9", "name": "T", "company": {"identifier": "Acme"}, "location": {"city": "Wien", "country": "at", "remote": True}}]})
    r = feeds.smartrecruiters(spark, p, {}).first()
    assert r.url == "https://jobs.smartrecruiters.com/Acme/9" and r.location == "Wien, AT"


GOOD = {"data": [{"slug": "s", "company_name": "C", "title": "T", "url": "https://x/1", "remote": True, "created_at": 1785837600}, {"slug": "s", "company_name": "C", "title": "T", "url": "https://x/2"}]}


def test_ingest_isolates_sources(spark, tmp_path):
    """A wrong name, a wrong path and a source that breaks while it is read stop no other."""

    def breaking(spark, path, config):
        from pyspark.sql import functions as F

        return feeds.arbeitnow(spark, path, config).withColumn("title", F.raise_error(F.lit("broken page")).cast("string"))

    registry._SOURCES["breaking"] = registry.Source("breaking", breaking)
    try:
        good = write(tmp_path, "a.json", GOOD)
        new, rejected, errors = registry.ingest(spark, {"breaking": good, "remotive": str(tmp_path / "none.json"), "arbeitnow": good, "unknown": "nowhere"})
        assert new.count() == 1 and rejected.count() == 0
        assert sorted(r.source for r in errors.collect()) == ["breaking", "remotive", "unknown"] and "broken page" in str(errors.collect())
    finally:
        del registry._SOURCES["breaking"]
    with pytest.raises(KeyError):
        registry.get("unknown")
    with pytest.raises(ValueError):
        registry.register(registry.get("arbeitnow"))


def test_intents_follow_the_commit(spark, tmp_path):
    """Alerts that gave records and discarded mail, of the sources that were read; a broken hook is told."""
    mails = {"m1": ("a@hh.ru", HTML["hh"][1]), "m2": ("a@hh.ru", "<p>nothing</p>"), "m3": ("x@spam.com", "<p>buy</p>")}
    for k, (sender, body) in mails.items():
        (tmp_path / f"{k}.eml").write_text(f"From: {sender}\nSubject: s\nMessage-ID: <{k}>\nMIME-Version: 1.0\nContent-Type: text/html; charset=utf-8\n\n{body}", encoding="utf-8")
    paths, config = {"gmail_alerts": str(tmp_path)}, {"gmail_alerts": {"discard": ["@SPAM.com"]}}
    new, _, errors = registry.ingest(spark, paths, config=config)
    assert new.count() == 1
    intents, failed = registry.after_commit(spark, paths, errors, config)
    assert sorted(r.message_id for r in intents.collect()) == ["m1", "m3"] and failed.count() == 0
    bad = spark.createDataFrame([("gmail_alerts", "x")], "source string, error string")
    assert registry.after_commit(spark, paths, bad, config)[0].count() == 0
    assert [r.source for r in registry.after_commit(spark, {"gmail_alerts": "/nowhere/at/all"}, errors)[1].collect()] == ["gmail_alerts"]


@pytest.fixture
def server():
    """An HTTP server on this machine; pages by path and number, with a first answer that fails."""
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            url = urlsplit(self.path)
            q = parse_qs(url.query)
            seen.append(self.path)
            if url.path == "/jobs" and len(seen) == 1:
                self.send_error(503)
                return
            page, lang = int(q.get("page", ["1"])[0]), q.get("lang", ["x"])[0]
            rows = [{"slug": f"{lang}{page}", "company_name": "C", "title": f"T{page}", "url": f"https://x/{lang}/{page}"}] if page < 3 else []
            feed = RSS.format(f"<item><title>Acme: {url.path}</title><link>https://w{url.path}</link><guid>g</guid><description>b</description></item>")
            body = json.dumps({"data": rows}) if url.path == "/jobs" else json.dumps([{"id": "7", "company": "A", "position": "P", "url": "https://b/7"}]) if url.path == "/one" else feed
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *args):
            pass

    srv = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=srv.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{srv.server_port}", seen
    srv.shutdown()


def test_sources_fetch(spark, server):
    """Pages of each variant up to the first empty one; one address; feeds of several authors; through ingest."""
    base, seen = server
    r = feeds.arbeitnow(spark, base + "/jobs", {"variants": [{"lang": "de"}, {"lang": "en"}], "page": "page", "pages": 9}).collect()
    assert sorted(x.url for x in r) == ["https://x/de/1", "https://x/de/2", "https://x/en/1", "https://x/en/2"]
    assert not any("page=4" in u for u in seen)
    assert [x.url for x in feeds.remoteok(spark, base + "/one", {}).collect()] == ["https://b/7"]
    r = feeds.weworkremotely(spark, base, {"paths": ["/a", "/b"]}).collect()
    assert sorted(x.title for x in r) == ["/a", "/b"]
    new, _, errors = registry.ingest(spark, {"remoteok": base + "/one", "remotive": "http://127.0.0.1:9/none"})
    assert new.count() == 1 and [x.source for x in errors.collect()] == ["remotive"]


def test_retries():
    def refusing(code, calls):
        def open_(url):
            calls.append(url)
            raise urllib.error.HTTPError(url, code, "", None, None)

        return open_

    quick = dataclasses.replace(http.FEED, sleep=lambda s: None)
    for code, n in ((503, 3), (429, 3), (404, 1)):
        calls = []
        with pytest.raises(urllib.error.HTTPError):
            http.fetch("u", refusing(code, calls), quick)
        assert len(calls) == n
    waits = []
    mailbox_policy = dataclasses.replace(http.MAIL, sleep=waits.append)
    for code, reason, n in ((503, "x", 7), (429, "x", 7), (403, "Quota exceeded for quota metric", 7), (403, "insufficient scope", 1), (400, "x", 1)):
        calls = []

        def refuse(code=code, reason=reason, calls=calls):
            calls.append(1)
            raise urllib.error.HTTPError("u", code, reason, None, None)

        with pytest.raises(urllib.error.HTTPError):
            http.call(refuse, mailbox_policy)
        assert len(calls) == n
    assert all(0 <= w <= 60 for w in waits)
    pages = {None: {"messages": [1, 2], "nextPageToken": "b"}, "b": {"nextPageToken": "c"}, "c": {"messages": [3]}}
    assert list(http.listed(pages.__getitem__, "messages")) == [1, 2, 3]
    seen = []

    def opener(url):
        seen.append(url)
        return json.dumps({"data": [1, 2]} if "page=1" in url else {"data": []}).encode()

    assert list(http.pages("b", {"q": "x"}, items="data", opener=opener)) == [1, 2] and len(seen) == 2


HTML = {
    "hh": ("a@hh.ru", '<p><a href="https://hh.ru/vacancy/11?x=1">Dev</a></p><p>от 100 ₽</p><p>Acme, Москва</p><p>Можно удаленно</p><p><a href="https://hh.ru/vacancy/11">Посмотреть вакансию</a></p><p>Other</p>'),
    "habr": ("x@career.habr.com", '<p><a href="https://t/?url=https%3A%2F%2Fcareer.habr.com%2Fvacancies%2F22">Go Dev</a></p><p>Компания: Acme</p><p>Город: Омск</p><p>Дополнительно: Можно удаленно</p><p>Требуемые навыки: Go</p>'),
    "linkedin": ("x@linkedin.com", '<p><a href="https://www.linkedin.com/comm/jobs/view/33/">Eng</a></p><p>Easy Apply · x</p><p>Acme · Remote EU</p>'),
    "glassdoor": ("x@glassdoor.com", '<a href="https://g/jobListing.htm?jobListingId=44"><p>Acme 4.1 ★</p><p>Eng</p><p>Easy Apply</p><p>Bonn</p></a>'),
    "landing": ("x@landing.jobs", '<a href="https://t/?url=https%3A%2F%2Flanding.jobs%2Fat%2Facme%2Fdev">Remote Dev @ Acme</a>'),
    "justjoin": ("x@justjoin.it", '<a href="https://justjoin.it/job-offer/acme-dev?x=1">' + "".join(f"<p>{x}</p>" for x in ("Acme", "Kraków", "Dev", "10 PLN", "Hybrid, remote", "B2B", "Senior", "3 days", "Apply")) + "</a>"),
    "pracuj": ("x@wysylka.pracuj.pl", '<p><a href="https://www.pracuj.pl/praca/dev-acme,oferta,55?s=1">! Dev</a></p><p><a href="https://www.pracuj.pl/praca/dev-acme,oferta,55">10 000 zł</a></p><p><a href="https://www.pracuj.pl/praca/dev-acme,oferta,55">Acme</a> Warszawa</p>'),
}
WANT = {
    "hh": ("https://hh.ru/vacancy/11", "Acme", "Dev", "Москва", True),
    "habr": ("https://career.habr.com/vacancies/22", "Acme", "Go Dev", "Омск", True),
    "linkedin": ("https://www.linkedin.com/jobs/view/33", "Acme", "Eng", "Remote EU", True),
    "glassdoor": ("https://www.glassdoor.com/job-listing/j?jl=44", "Acme", "Eng", "Bonn", False),
    "landing": ("https://landing.jobs/at/acme/dev", "Acme", "Remote Dev", None, True),
    "justjoin": ("https://justjoin.it/job-offer/acme-dev", "Acme", "Dev", "Kraków", False),
    "pracuj": ("https://pracuj.pl/praca/dev-acme,oferta,55", "Acme", "Dev", "Warszawa", False),
}


@pytest.mark.parametrize("board", sorted(HTML))
def test_alerts(board):
    got = mail.parse_alert(*HTML[board])
    assert [(r["url"], r["company"], r["title"], r["location"], r["is_remote"]) for r in got] == [WANT[board]]


def test_plain_alerts():
    now = "Hello,\n\nnew roles for you\n\nBackend Dev  Acme  / 11-50 Employees  €50k | Remote only, Berlin | Full-time  Actively Hiring\n<https://wellfound.com/jobs/66-backend-dev?utm=1>"
    wrapped = "Senior Backend\nEngineer  Big \nCorp  $100k – $120k | In office or remote, Lisbon\n| 3 years of exp  Learn more\n<https://wellfound.com/jobs/67-senior>\n\nOps Dev  Tiny  0.5% – 1.0% | Remote  <https://wellfound.com/jobs/68-ops>"
    old = "New jobs\n\nDev\n\nAcme / 11-50 Employees\n\n$5k | Lisbon | 2 years of exp | Full-time\n\nhttps://wellfound.com/jobs?job_listing_slug=77-dev"
    ind = "Dev\nAcme - Bonn\n€50k\nGreat snippet\n2 days ago\nhttps://de.indeed.com/x?a=1&jk=0ab9"
    of = lambda text: [(r["external_id"], r["company"], r["title"], r["location"], r["is_remote"]) for r in mail.parse_alert("x@wellfound.com", "", text)]
    assert of(now) == [("66", "Acme", "Backend Dev", "Berlin", True)]
    assert of(wrapped) == [("67", "Big Corp", "Senior Backend Engineer", "In office or remote, Lisbon", True), ("68", "Tiny", "Ops Dev", "Remote", True)]
    assert of(old) == [("77", "Acme", "Dev", "Lisbon", False)] and of("no card\n\nhttps://wellfound.com/jobs/1-x") == []
    assert [(r["external_id"], r["location"], r["title"]) for r in mail.parse_alert("x@wellfound.com", "", old)] == [("77", "Lisbon", "Dev")]
    assert [(r["url"], r["description"], r["location"]) for r in mail.parse_alert("x@indeed.com", "", ind)] == [("https://de.indeed.com/viewjob?jk=0ab9", "Great snippet", "Bonn")]
    assert mail.parse_alert("x@else.com", "", "y") == []


def test_mail_files(spark, tmp_path):
    raw = 'From: X <a@hh.ru>\nSubject: s\nMessage-ID: <m1>\nDate: Tue, 04 Aug 2026 10:00:00 +0000\nMIME-Version: 1.0\nContent-Type: text/html; charset="utf-8"\n\n' + HTML["hh"][1]
    (tmp_path / "m.eml").write_text(raw, encoding="utf-8")
    (tmp_path / "bad.eml").write_bytes(b"\xff\xfe no headers")
    m = mail.read_mail(spark, str(tmp_path))
    assert m.count() == 2
    rows = mail.alert_records(m).collect()
    assert [(r.message_id, r.company) for r in rows] == [("m1", "Acme")]
    assert [r.message_id for r in mail.clear_intents(mail.alert_records(m)).collect()] == ["m1"]
    n = spark.createDataFrame([("1", "Сообщение от работодателя", "<p>Компания: Acme.</p><a href='https://hh.ru/vacancy/9'>x</a>", None), ("2", "Sale", "", None)], "message_id string, subject string, html string, received_at timestamp")
    assert [(r.kind, r.vacancy_id, r.company) for r in mail.notices(n).collect()] == [("vacancy_message", "9", "Acme")]


def test_incoming_counts_from_the_run(spark):
    at = lambda d: datetime.datetime(2026, 8, d)
    rows = [("a", "x@y.com", at(1), ["INBOX"]), ("b", "x@y.com", at(20), ["INBOX"]), ("c", "n@linkedin.com", at(20), ["INBOX"]), ("d", "x@y.com", at(21), ["INBOX", "CATEGORY_PROMOTIONS"]), ("e", "x@y.com", at(21), ["SENT"]), ("f", "x@y.com", None, ["INBOX"])]
    df = spark.createDataFrame(rows, "message_id string, from_address string, received_at timestamp, labels array<string>")
    assert [r.message_id for r in mail.incoming(df, 14, exclude=("LinkedIn.com",), now=at(22)).collect()] == ["b"]
    assert mail.incoming(df.drop("labels"), 14, now=datetime.datetime(2027, 1, 1)).count() == 0
    assert mail.incoming(df.drop("labels"), 30, most=2, now=at(22)).count() == 2


def test_alerts_as_a_table_function(spark):
    rows = [("m1", *HTML["hh"], ""), ("m2", "x@new.board", "<b>A</b><b>B</b>", None), ("m3", "x@else.com", "", ""), ("m4", None, None, None), ("m5", *HTML["linkedin"], "")]
    spark.createDataFrame(rows, "message_id string, from_address string, html string, text string").createOrReplaceTempView("alerts")

    def new_board(html, text):
        import re

        for x in re.findall("<b>(.*?)</b>", html):
            yield {"url": f"https://n/{x}", "company": "N", "title": x, "description": "", "location": None, "is_remote": False, "external_id": x}

    mail.register_alerts(spark, {"new.board": new_board})
    got = spark.sql("SELECT message_id, r.title FROM alerts, LATERAL alert_records(from_address, html, text) r").collect()
    assert sorted(tuple(x) for x in got) == [("m1", "Dev"), ("m2", "A"), ("m2", "B"), ("m5", "Eng")]
    # a board by name, whoever sent it; one that isn't known is told before anything runs
    named = spark.sql("SELECT message_id FROM alerts, LATERAL alert_records('fwd@x', html, text, 'hh.ru')").collect()
    assert [x.message_id for x in named] == ["m1"]
    with pytest.raises(Exception, match="no parser for nowhere"):
        spark.sql("SELECT * FROM alerts, LATERAL alert_records(from_address, html, text, 'nowhere')")
    with pytest.raises(Exception, match="must be a string"):
        spark.sql("SELECT * FROM alert_records(1, '', '')")
    assert sorted((x.message_id, x.company) for x in mail.alert_records(spark.table("alerts"), {"new.board": new_board}).collect()) == [("m1", "Acme"), ("m2", "N"), ("m2", "N"), ("m5", "Acme")]
