"""JSON and XML feeds: one mapping projection for each shape, over an explicit schema."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import times as D
from ..functions import urls as U
from ..functions import vocabulary as V
from ..operators import rules as R
from . import http
from .registry import Source, register

LIMIT = 4000


def _body(x: Column | str) -> Column:
    """Text of a description: tags off, reader mark off, clipped."""
    return T.clip(T.strip_reader_mark(T.strip_html(x)), LIMIT)


def _first(*alternatives: Column | str) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.col(a) if isinstance(a, str) else a, F.lit("")) for a in alternatives])


def _record(rows: DataFrame, required: tuple[str, ...] = ("url", "company", "title"), **cols: Column) -> DataFrame:
    """The record shape; rows that lack a required value are skipped."""
    text = {"url": F.lit(None), "company": F.lit(None), "title": F.lit(None), "description": F.lit(""), "location": F.lit(None), "external_id": F.lit(None)} | cols
    out = rows.select(
        *[text[n].cast("string").alias(n) for n in ("url", "company", "title", "description", "location")],
        cols.get("is_remote", F.lit(False)).cast("boolean").alias("is_remote"),
        cols.get("posted_at", F.lit(None)).cast("timestamp").alias("posted_at"),
        text["external_id"].cast("string").alias("external_id"),
    )
    out = out.withColumn("apply_channel", U.apply_channel("url"))
    for c in required:
        out = out.filter(F.coalesce(F.trim(c), F.lit("")) != "")
    return out


def _remote(path: str) -> bool:
    return path.startswith(("http://", "https://"))


def _paged(spark: SparkSession, path: str, items: str, config: dict) -> DataFrame:
    """JSON of the items of all pages and variants; see ``http.PagedJson``."""
    spark.dataSource.register(http.PagedJson)
    read = spark.read.format("paged_json").option("items", items).option("variants", json.dumps(config.get("variants", [{}])))
    for k in ("page", "first", "pages", "pause"):
        read = read.option(k, str(config.get(k, {"page": "", "first": 1, "pages": 5, "pause": 0}[k])))
    return read.load(path)


def _json(spark: SparkSession, path: str, ddl: str, config: dict) -> DataFrame:
    """Items of a top-level array, from files or over HTTP."""
    if _remote(path):
        return _paged(spark, path, "", config).select(F.from_json("value", ddl).alias("r")).select("r.*")
    return spark.read.schema(ddl).json(path, multiLine=True)


def _nested(spark: SparkSession, path: str, array: str, item: str, config: dict) -> DataFrame:
    """Items of an array in an object, from files or over HTTP."""
    if _remote(path):
        return _paged(spark, path, array, config).select(F.from_json("value", f"struct<{item}>").alias("r")).select("r.*")
    return spark.read.schema(f"{array} array<struct<{item}>>").json(path, multiLine=True).select(F.explode(array).alias("r")).select("r.*")


def _xml(spark: SparkSession, path: str, ddl: str, config: dict) -> DataFrame:
    """Items of a feed, from files or over HTTP: ``path`` followed by each of ``config["paths"]``."""
    if not _remote(path):
        return spark.read.format("xml").option("rowTag", "item").option("ignoreNamespace", "true").schema(ddl).load(path)
    spark.dataSource.register(http.PagedJson)
    variants = json.dumps([{"_path": p} for p in config.get("paths", [""])])
    body = spark.read.format("paged_json").option("raw", "true").option("variants", variants).load(path)
    items = body.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)<item\b.*?</item>"), F.lit(0))).alias("x"))
    return items.select(F.from_xml("x", F.lit(ddl), {"ignoreNamespace": "true"}).alias("r")).select("r.*")


# -- feeds ------------------------------------------------------------------------------------


def remotive(spark: SparkSession, path: str, config: dict) -> DataFrame:
    r = _nested(spark, path, "jobs", "id: string, url: string, title: string, company_name: string, publication_date: string, candidate_required_location: string, description: string", config)
    return _record(r, url=F.col("url"), company=F.col("company_name"), title=F.col("title"), description=_body("description"), location=F.col("candidate_required_location"), is_remote=F.lit(True), posted_at=D.from_iso("publication_date"), external_id=F.col("id"))


def arbeitnow(spark: SparkSession, path: str, config: dict) -> DataFrame:
    r = _nested(spark, path, "data", "slug: string, company_name: string, title: string, description: string, remote: boolean, url: string, location: string, created_at: string", config)
    return _record(r, url=F.col("url"), company=F.col("company_name"), title=F.col("title"), description=_body("description"), location=F.col("location"), is_remote=F.coalesce("remote", F.lit(False)), posted_at=D.from_epoch("created_at"), external_id=F.col("slug"))


def adzuna(spark: SparkSession, path: str, config: dict) -> DataFrame:
    r = _nested(spark, path, "results", "id: string, title: string, company: struct<display_name: string>, location: struct<display_name: string, area: array<string>>, description: string, redirect_url: string, created: string", config)
    title, body = T.strip_html("title"), _body("description")
    return _record(r, url=F.col("redirect_url"), company=F.col("company.display_name"), title=title, description=body, location=F.col("location.display_name"), is_remote=R.looks_remote(title, F.col("location.display_name"), body), posted_at=D.from_iso("created"), external_id=F.col("id"))


def themuse(spark: SparkSession, path: str, config: dict) -> DataFrame:
    r = _nested(spark, path, "results", "id: string, name: string, company: struct<name: string>, locations: array<struct<name: string>>, contents: string, refs: struct<landing_page: string>, publication_date: string", config)
    places = F.filter(F.transform("locations", lambda x: x["name"]), lambda n: F.coalesce(n, F.lit("")) != "")
    remote = F.exists(places, lambda n: F.lower(n).rlike("remote|flexible"))
    return _record(r, url=F.col("refs.landing_page"), company=F.col("company.name"), title=F.col("name"), description=_body("contents"), location=F.nullif(F.array_join(places, ", "), F.lit("")), is_remote=F.coalesce(remote, F.lit(False)), posted_at=D.from_iso("publication_date"), external_id=F.col("id"))


def remoteok(spark: SparkSession, path: str, config: dict) -> DataFrame:
    """A top-level array whose first element is no posting: it lacks position and company."""
    r = _json(spark, path, "id string, date string, company string, position string, description string, location string, apply_url string, url string", config)
    return _record(r, url=_first("url", "apply_url"), company=T.strip_html("company"), title=T.strip_html("position"), description=_body("description"), location=F.col("location"), is_remote=F.lit(True), posted_at=D.from_iso("date"), external_id=F.col("id"))


def weworkremotely(spark: SparkSession, path: str, config: dict) -> DataFrame:
    """Titles are "Company: Position"; items without the separator are skipped."""
    r = _xml(spark, path, "title string, region string, country string, description string, pubDate string, guid string, link string", config).filter(F.instr("title", ": ") > 0)
    title = F.expr("substring(title, instr(title, ': ') + 2)")
    place = F.nullif(F.array_join(F.filter(F.array(F.trim("region"), F.trim("country")), lambda x: F.coalesce(x, F.lit("")) != ""), ", "), F.lit(""))
    return _record(r, url=F.col("link"), company=F.substring_index("title", ": ", 1), title=title, description=_body("description"), location=place, is_remote=F.lit(True), posted_at=D.from_rfc822("pubDate"), external_id=F.col("guid"))


def teletype(spark: SparkSession, path: str, config: dict) -> DataFrame:
    """An author's blog: the body is content:encoded, else the description; its first line is the place if
    it has a word of place in it."""
    r = _xml(spark, path, "title string, link string, guid string, pubDate string, description string, encoded string", config)
    raw, link = F.coalesce("encoded", "description", F.lit("")), _first(F.trim("link"), F.trim("guid"))
    text = T.strip_html(raw)
    first = F.get(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), F.lit(0))
    place = F.when(T.matches(first, V.GEO_LINE), F.substring(first, 1, V.GEO_LENGTH))
    ident = F.nullif(F.regexp_extract(_first(F.trim("guid"), link), V.POST_SLUG, 1), F.lit(""))
    author = config.get("author", "unknown")
    return _record(
        r, ("url", "company", "title", "description"), url=F.substring_index(link, "?", 1), company=F.lit(f"Teletype ({author})"), title=F.trim("title"),
        description=T.clip(text), location=place, is_remote=T.matches(raw, V.REMOTE_WORD), posted_at=D.from_rfc822("pubDate"), external_id=ident,
    )


# -- boards of one company each ---------------------------------------------------------------


def greenhouse(spark: SparkSession, path: str, config: dict) -> DataFrame:
    r = _nested(spark, path, "jobs", "id: string, title: string, absolute_url: string, updated_at: string, first_published: string, location: struct<name: string>, content: string", config)
    body = _body("content")
    return _record(r, url=F.col("absolute_url"), company=F.lit(config.get("company", config.get("slug", ""))), title=F.col("title"), description=body, location=F.col("location.name"), is_remote=R.looks_remote("title", F.col("location.name"), body), posted_at=F.coalesce(D.from_iso("first_published"), D.from_iso("updated_at")), external_id=F.col("id"))


def lever(spark: SparkSession, path: str, config: dict) -> DataFrame:
    r = _json(spark, path, "id string, text string, hostedUrl string, createdAt long, workplaceType string, descriptionPlain string, description string, categories struct<location: string>", config)
    body = T.clip(_first(T.strip("descriptionPlain"), T.strip_html("description")))
    remote = (F.lower(F.coalesce("workplaceType", F.lit(""))) == "remote") | R.looks_remote("text", F.col("categories.location"), F.lit(""))
    return _record(r, url=F.col("hostedUrl"), company=F.lit(config.get("company", config.get("slug", ""))), title=F.col("text"), description=F.coalesce(body, F.lit("")), location=F.col("categories.location"), is_remote=remote, posted_at=D.from_epoch_millis("createdAt"), external_id=F.col("id"))


def ashby(spark: SparkSession, path: str, config: dict) -> DataFrame:
    r = _nested(spark, path, "jobs", "id: string, title: string, jobUrl: string, applyUrl: string, location: string, isRemote: boolean, publishedAt: string, descriptionPlain: string, descriptionHtml: string, isListed: boolean", config)
    r = r.filter(F.coalesce("isListed", F.lit(True)))
    body = T.clip(_first(T.strip("descriptionPlain"), T.strip_html("descriptionHtml")))
    return _record(r, url=_first("jobUrl", "applyUrl"), company=F.lit(config.get("company", config.get("slug", ""))), title=F.col("title"), description=F.coalesce(body, F.lit("")), location=F.col("location"), is_remote=F.coalesce("isRemote", F.lit(False)), posted_at=D.from_iso("publishedAt"), external_id=F.col("id"))


def recruitee(spark: SparkSession, path: str, config: dict) -> DataFrame:
    r = _nested(spark, path, "offers", "id: string, title: string, careers_url: string, careers_apply_url: string, company_name: string, location: string, city: string, country: string, remote: boolean, description: string, requirements: string, published_at: string, created_at: string", config)
    place = _first("location", F.concat_ws(", ", F.nullif("city", F.lit("")), F.nullif("country", F.lit(""))))
    body = _body(F.concat_ws("\n", "description", "requirements"))
    when = lambda c: D.from_iso(F.regexp_replace(c, r"\s*UTC$", "+00:00"))
    return _record(r, url=_first("careers_url", "careers_apply_url"), company=_first("company_name", F.lit(config.get("slug", ""))), title=F.col("title"), description=body, location=place, is_remote=F.coalesce("remote", F.lit(False)), posted_at=F.coalesce(when("published_at"), when("created_at")), external_id=F.col("id"))


def smartrecruiters(spark: SparkSession, path: str, config: dict) -> DataFrame:
    r = _nested(spark, path, "content", "id: string, name: string, company: struct<identifier: string, name: string>, location: struct<city: string, region: string, country: string, remote: boolean>, releasedDate: string", config)
    place = F.nullif(F.concat_ws(", ", F.nullif("location.city", F.lit("")), F.nullif("location.region", F.lit("")), F.upper(F.nullif("location.country", F.lit("")))), F.lit(""))
    company = _first("company.identifier", F.lit(config.get("slug", "")))
    return _record(r, url=F.concat(F.lit("https://jobs.smartrecruiters.com/"), company, F.lit("/"), F.col("id")), company=_first("company.name", company), title=F.col("name"), location=place, is_remote=F.coalesce("location.remote", F.lit(False)), posted_at=D.from_iso("releasedDate"), external_id=F.col("id"))


for _name, _read, _kind in (
    ("remotive", remotive, "api"),
    ("arbeitnow", arbeitnow, "api"),
    ("adzuna", adzuna, "api"),
    ("themuse", themuse, "api"),
    ("remoteok", remoteok, "api"),
    ("weworkremotely", weworkremotely, "rss"),
    ("teletype", teletype, "rss"),
    ("greenhouse", greenhouse, "api"),
    ("lever", lever, "api"),
    ("ashby", ashby, "api"),
    ("recruitee", recruitee, "api"),
    ("smartrecruiters", smartrecruiters, "api"),
):
    register(Source(_name, _read, _kind))
