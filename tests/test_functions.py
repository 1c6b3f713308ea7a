import json
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankwell import schema
from rankwell.functions import text as T
from rankwell.functions import times as D
from rankwell.functions import urls as U
from rankwell.functions import vectors as X


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names)).select(column.alias("x")).first().x


@pytest.mark.parametrize("text, folded", [("Szkoła", "szkola"), ("STRASSE ß", "strasse ss"), ("Crème Brûlée", "creme brulee"), ("Ærø", "aero"), (None, ""), ("й", "и"), ("plain", "plain")])
def test_fold(spark, text, folded):
    assert one(spark, T.fold("a"), a=text) == folded == T.fold_text(text)


def test_company_names(spark):
    assert one(spark, T.company_slug(T.fold("a")), a="The Acme Group Sp. z o.o.") == "acme"
    assert one(spark, T.company_slug(T.fold("a")), a="The Studio Group") == "thestudiogroup"
    assert one(spark, T.identity_key("a"), a="Szkoła 1") == "szkoa1"
    assert one(spark, T.registrable_domain("a"), a="careers.acme.co.uk") == "acme"
    assert one(spark, T.registrable_domain("a"), a="com") == "com"
    assert one(spark, F.array_join(T.slug_candidates("a"), ","), a="Moon Active Ltd.") == "moonactive,moon-active,moon"


def test_senders(spark):
    h = '"Moon Active Hiring" <Jobs@Mail.Acme.com>'
    assert one(spark, T.sender_domain("a"), a=h) == "mail.acme.com" and one(spark, T.sender_mailbox("a"), a=h) == "jobs@mail.acme.com"
    assert one(spark, T.display_name("a"), a=h) == "Moon Active Hiring" and one(spark, T.display_name("a"), a="x@y.com") == ""


@pytest.mark.parametrize("raw, text", [("a &amp;amp; b", "a & b"), ("<p>x</p><br>y", "x\ny"), ("Patti&amp;More!", "Patti&More!"), ("&lt;b&gt;t&lt;/b&gt;", "t"), ("", ""), (None, None), ("a  b<script>s</script>", "a bs")])
def test_html(spark, raw, text):
    assert one(spark, T.strip_html("a"), a=raw) in (text, text or "")


def test_clip(spark):
    assert one(spark, T.clip("a", 10, 3), a="one two three") == "one two"
    assert one(spark, T.clip("a", 10, 3), a="one two\nthree") == "one two"
    assert one(spark, T.clip("a", 5), a="abcdefgh") == "abcde"
    assert one(spark, T.clip("a", 20), a="short") == "short"


def test_mojibake(spark):
    for good in ("Café – “quoted”", "Łódź", "naïve €5", "Привет"):
        bad = good.encode().decode("cp1252", "replace") if good != "Łódź" else good.encode().decode("latin-1")
        if "�" not in bad:
            assert one(spark, T.repair_mojibake("a"), a=bad) == good
        assert one(spark, T.repair_mojibake("a"), a=good) == good
    assert one(spark, T.repair_mojibake("a"), a=None) is None


@pytest.mark.parametrize(
    "raw, clean",
    [
        ("HTTPS://WWW.Example.com/Jobs/1/?utm_source=x&b=2&a=1#top", "https://example.com/Jobs/1?a=1&b=2"),
        ("https://x.com/?ref=1&se=2", "https://x.com"),
        ("https://x.com/a?q=a%20b&q=", "https://x.com/a?q=&q=a+b"),
        ("", ""),
    ],
)
def test_normalize_url(spark, raw, clean):
    assert one(spark, U.normalize_url("a"), a=raw) == clean


def test_routes(spark):
    assert one(spark, U.is_blocked("a"), a="https://www.adzuna.com/x") and one(spark, U.is_blocked("a"), a="https://jobs.remoteok.com/x")
    assert not one(spark, U.is_blocked("a"), a="https://adzuna.com.au") and not one(spark, U.is_blocked("a"), a="https://notremoteok.com") and not one(spark, U.is_blocked("a"), a=None)
    assert [one(spark, U.apply_channel("a"), a=u) for u in ("MAILTO:x@y.z", "https://t.me/x", "https://x.y", None)] == ["email", "telegram", "form", "form"]


def test_times(spark):
    at = datetime(2026, 8, 4, 10, 0, 0)
    for f, v in ((D.from_epoch, "1785837600"), (D.from_iso, "2026-08-04T12:00:00+02:00"), (D.from_iso, "2026-08-04T10:00:00"), (D.from_rfc822, "Tue, 04 Aug 2026 10:00:00 GMT"), (D.from_rfc822, "4 Aug 2026 12:00:00 +0200"), (D.from_epoch_millis, "1785837600000")):
        got = one(spark, f("a").cast("string"), a=v)
        assert got == at.strftime("%Y-%m-%d %H:%M:%S"), (f, v)
    for f in (D.from_epoch, D.from_iso, D.from_rfc822):
        assert [one(spark, f("a"), a=v) for v in (None, "", "0" if f is D.from_epoch else "x")] == [None] * 3


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [0.0, 0.0])], "id int, embedding array<float>")
    got = [r.c for r in v.orderBy("id").select(X.cosine("embedding", F.array(F.lit(1.0), F.lit(1.0))).alias("c")).collect()]
    assert got == pytest.approx([0.5**0.5, 0.5**0.5, 0])
    assert X.mean_vector(v).first().centre == pytest.approx([1 / 3, 2 / 3])
    assert X.from_bytes(X.to_bytes([1.5, 2.5])).tolist() == [1.5, 2.5]
    s = spark.createDataFrame([(0.1,), (0.3,), (0.2,), (0.4,), (0.4,), (None,)], "score double")
    assert sorted((r.score, r.percentile) for r in X.percentile(s).collect() if r.score is not None) == [(0.1, 0), (0.2, 20), (0.3, 40), (0.4, 60), (0.4, 60)]
    e = X.embed(spark.createDataFrame([("a b",), ("",), (None,)], "t string"), "t").collect()
    assert np.linalg.norm(e[0].embedding) == pytest.approx(1) and not any(e[1].embedding) and not any(e[2].embedding)


def test_contract(spark):
    rows = [("u", "c", "t", None, "x" * 300, "e", None), ("u", "", "t", "", "", "", None), (None, "c", "t" * 256, "", "", "", None)]
    df = spark.createDataFrame(rows, "url string, company string, title string, description string, location string, external_id string, apply_channel string")
    good, bad = schema.validate(df)
    assert [len(r.location) for r in good.collect()] == [255] and [r.rejected_for for r in bad.collect()] == [["company"], ["title", "url"]]
    assert json.loads(schema.of(schema.JOBS).json())["type"] == "struct"


def test_cells(spark):
    df = spark.createDataFrame([("https://x/?a=1&b='<\"",), ("",), (None,)], "u string")
    got = [tuple(r) for r in df.select(T.link("u"), T.multiline("u")).collect()]
    safe = "https://x/?a=1&amp;b=&#39;&lt;&#34;"
    assert got[0][0] == f'<a href="{safe}" target="_blank" rel="noopener">{safe}</a>' and got[0][1].endswith(f">{safe}</div>")
    assert got[1][0] == got[2] [0] == got[2][1] == "" and got[1][1].endswith("></div>")


def test_zone_names(spark):
    """What a clock shows is read back; a zone's name has to be that of the date."""
    rows = ["2026-08-04 21:00 CEST", "2026-08-04 21:00 CET", "2026-01-04 21:00:30 CET", "2026-01-04 21:00", "2026-10-25 02:30 CEST", "soon", "", None]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    got = [r.x for r in df.select(F.date_format(D.parse_wall_clock("t", "Europe/Podgorica"), "yyyy-MM-dd HH:mm:ss").alias("x")).collect()]
    assert got == ["2026-08-04 19:00:00", None, "2026-01-04 20:00:30", "2026-01-04 20:00:00", "2026-10-25 00:30:00", None, None, None]
    utc = spark.createDataFrame([("2026-08-04 19:00:00",), ("2026-01-04 20:00:30",)], "t string").select(F.to_timestamp("t").alias("t"))
    assert [r.x for r in utc.select(D.show_wall_clock("t", "Europe/Podgorica").alias("x")).collect()] == ["2026-08-04 21:00 CEST", "2026-01-04 21:00 CET"]


def test_fast_patterns_are_the_slow_ones(spark):
    from rankwell.functions import vocabulary as V

    texts = ["We are HIRING", "teams", "a Team.", "roleplay", "Опыт работы", "ACTIVE ts/sci", "security  clearance", "Security Clearance", "x", "", None, "Erfahrung", "JOIN US"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select(T.matches("t", V.HIRING_WORDS).alias("a"), T.matches_any("t", V.HIRING_WORDS).alias("b"), T.matches("t", V.CLEARANCE).alias("c"), T.matches_hinted("t", V.CLEARANCE, ("clearance", "active")).alias("d")).collect():
        assert r.a == r.b and r.c == r.d


def test_mean_vector_is_one_row_a_task(spark):
    rows = [([1.0, 2.0],), ([3.0],), (None,), ([],), ([5.0, None, 7.0],)]
    df = spark.createDataFrame(rows, "v array<float>").repartition(3)
    got = X.mean_vector(df, "v")
    assert got.first().centre == [3.0, 2.0, 7.0]
    assert X.mean_vector(df.filter("v IS NULL"), "v").first().centre is None
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in text and text.count("Generate explode") == 0


def test_percentile_of_many_scores_is_brute_force(spark, monkeypatch):
    import random

    r = random.Random(2)
    scores = [r.choice([None, 0.5, round(r.random(), 2), r.random()]) for _ in range(700)]
    df = spark.createDataFrame(list(enumerate(scores)), "id int, score double")
    known = [s for s in scores if s is not None]
    want = {i: None if s is None else 100 * sum(k < s for k in known) / len(known) for i, s in enumerate(scores)}
    assert {x.id: x.percentile for x in X.percentile(df).collect()} == want
    monkeypatch.setattr(X, "RANGE_SCORES", 20)
    assert {x.id: x.percentile for x in X.percentile(df).collect()} == want
    monkeypatch.setattr(X, "BROADCAST_SCORES", 10)
    assert {x.id: x.percentile for x in X.percentile(df).collect()} == want
    assert X.percentile(df.filter("score IS NULL")).filter("percentile IS NOT NULL").count() == 0


def test_variants(spark, tmp_path):
    from rankwell.functions import variants as J

    rows = [(1, '{"k": 1, "a": {"b": [{"c": "x"}, 2]}, "n": null}'), (2, "[1, 2]"), (3, "not json"), (4, None), (5, '{"k": "seven", "a": 3}'), (6, '""')]
    df = spark.createDataFrame(rows, "id int, j string").select("id", J.parsed("j").alias("v"))
    df.write.parquet(str(tmp_path / "v"))
    stored = spark.read.parquet(str(tmp_path / "v"))  # a variant is a stored column
    got = {r.id: (r.k, r.c, r.n, r.kind) for r in stored.select("id", J.at("v", "k", "bigint").alias("k"), J.at("v", "a.b[0].c").alias("c"), J.at("v", "n").alias("n"), J.kind("v").alias("kind")).collect()}
    assert got == {1: (1, "x", None, "OBJECT"), 2: (None, None, None, "ARRAY"), 3: (None,) * 4, 4: (None,) * 4, 5: (None, None, None, "OBJECT"), 6: (None, None, None, "STRING")}
    made = J.lookup(stored, "v", {"c": ("a.b[0].c", "none"), "k": ("k", "0")}).select("id", "c", "k").collect()
    assert {r.id: (r.c, r.k) for r in made} == {1: ("x", "1"), 2: ("none", "0"), 3: ("none", "0"), 4: ("none", "0"), 5: ("none", "seven"), 6: ("none", "0")}


def test_fold_is_the_compatibility_form_of_every_character(spark):
    # Hangul syllables stay composed; Java and Python differ in how they lower a few characters
    every = [chr(i) for i in range(0x20, 0x30000) if not 0xD800 <= i < 0xE000 and not 0xAC00 <= i < 0xD7A4]
    df = spark.createDataFrame([(f"a{c}b",) for c in every], "x string")
    low = {r.x: (r.low, r.f) for r in df.select("x", F.lower("x").alias("low"), T.fold("x").alias("f")).collect()}
    same = [x for x, (j, _) in low.items() if j == x.lower()]
    wrong = [(x, low[x][1], T.fold_text(x)) for x in same if low[x][1] != T.fold_text(x)]
    assert len(same) > 0.99 * len(every)
    assert not wrong, wrong[:5]
    assert one(spark, T.fold("a"), a="Ǆungla № ﬁne ㎏ ½ 𝔅𝔢𝔯𝔩𝔦𝔫 ｱｸﾒ") == T.fold_text("Ǆungla № ﬁne ㎏ ½ 𝔅𝔢𝔯𝔩𝔦𝔫 ｱｸﾒ")
