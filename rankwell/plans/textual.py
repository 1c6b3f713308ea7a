"""Text, URL and rule expressions over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import prompts as P
from ..functions import text as T
from ..functions import urls as U
from ..functions import vocabulary as V
from ..operators import guards
from ..operators import rules as R
from .base import query, table
from .relational import HOST


def quoted(text: str) -> str:
    """A text as a literal of SQL."""
    return "'" + text.replace("'", "''") + "'"


def any_of(values: tuple[str, ...]) -> str:
    return ", ".join(quoted(v) for v in values)


@query(
    "rule_engine_flags",
    rf"""SELECT doc_id,
  lower(regexp_replace(trim(regexp_replace(left(text, 40), '\s+', ' ', 'g')), '^[ \-–—:|]+|[ \-–—:|]+$', '', 'g')) IN ({any_of(V.JUNK_TITLES)}) AS junk_title,
  length(text) >= {R.JUDGEABLE} AND regexp_matches(text, {quoted(V.PROSE)}) AND NOT regexp_matches(text, {quoted(V.TRUNCATED)})
    AND NOT regexp_matches(left(text, 40) || chr(10) || text, {quoted('(?i)' + V.HIRING_WORDS)}) AS unwritten_body,
  regexp_matches(text, {quoted('(?i)' + V.CLEARANCE)}) AS clearance,
  regexp_matches(left(text, 40), {quoted('(?i)' + V.JUNIOR_TITLE)}) AND NOT regexp_matches(left(text, 40), {quoted('(?i)' + V.MIDDLE_TITLE)}) AS below_middle,
  length(trim(text)) >= 300 AS draftable
FROM documents""",
)
def rule_engine_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 40).alias("title"), F.col("text").alias("description"), F.lit("").alias("location"), F.lit(False).alias("is_remote"))
    return d.select("doc_id", R.junk_title().alias("junk_title"), R.unwritten_body().alias("unwritten_body"), R.clearance_required().alias("clearance"), R.below_middle().alias("below_middle"), (F.length(F.trim("description")) >= 300).alias("draftable"))


#: Postings whose texts make each rule speak; no table has such texts, so each is dealt to documents.
EXAMPLES = [
    (1, "Senior Engineer", "We need experience. Fluent German is required for this role.", "Berlin", False),
    (2, "Senior Engineer", "Experience with Go. German is a plus, English is fine.", "Berlin", False),
    (3, "Backend Developer", "You will build. Must be authorized to work in the US.", "", True),
    (4, "Backend Developer", "You will build. Must be based in Portugal; open across Europe.", "", True),
    (5, "Backend Developer", "Must be located in Spain and hold EU citizenship.", "Spain", True),
    (6, "Старший разработчик", "Опыт работы от трёх лет.", "Томск", False),
    (7, "Developer", "OFFICE MINSK | games\nWe are looking for you.", "", False),
    (8, "Platform Engineer", "Experience. We cannot sponsor visas.", "Podgorica", False),
    (9, "Platform Engineer", "Experience. We cannot sponsor visas.", "Munich", False),
    (10, "Junior Developer", "Our team needs skills.", "Paris", False),
    (11, "Junior/Middle Developer", "Our team needs skills.", "Paris", False),
    (12, "ML Engineer", "Our team needs skills.", "Paris", False),
    (13, "ML Engineer, platform", "Our team needs skills.", "Paris", False),
    (14, "Developer", "Active TS/SCI needed. Experience.", "Austin", False),
    (15, "Developer", "Visa sponsorship. Valid international passport. Java, Python, PHP, Ruby or similar.", "Berlin", False),
    (16, "Job Details", "Experience.", "Rome", False),
    (17, "Developer", "US only. Contractor welcome, experience.", None, True),
    (18, None, None, None, None),
]


#: What stops each example.
STOPPED = ["language", "", "geo_locked", "", "geo_locked", "stopped_place", "stopped_place", "", "sponsorship_refused", "below_middle", "", "model_training", "", "clearance", "relocation_scam", "junk_title", "", ""]


def _dealt(rows: list[tuple], names: tuple[str, ...], ident: str = "doc_id") -> list[Column]:
    """The columns of the row that is dealt to each id in turn."""
    at = F.pmod(F.col(ident), F.lit(len(rows))).cast("int") + 1
    return [F.element_at(F.array(*[F.lit(r[k]) for r in rows]), at).alias(name) for k, name in enumerate(names)]


def _values(wanted: list[str]) -> str:
    return "[" + ", ".join(quoted(w) for w in wanted) + "]"


@query(
    "location_rule",
    f"""SELECT doc_id, {_values(STOPPED)}[CAST(doc_id % {len(STOPPED)} AS INTEGER) + 1] AS reasons,
  {_values(STOPPED)}[CAST(doc_id % {len(STOPPED)} AS INTEGER) + 1] = '' AS passed FROM documents""",
)
def location_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as the body of a posting that makes one rule speak, or none: its text, which tells of
    nothing, stands below."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", *_dealt([x[1:] for x in EXAMPLES], ("title", "body", "location", "is_remote")))
    body = F.concat_ws("\n\n", "body", F.lit("experience"), "text")
    posting = d.select("doc_id", "title", body.alias("description"), "location", "is_remote")
    return R.judged(posting).select("doc_id", F.array_join("reasons", ",").alias("reasons"), "passed")


#: Clauses about languages, and whether they demand one.
DEMANDS = [
    ("Fluent German is required for this role.", True),
    ("German is a plus.", False),
    ("Fluent German is required; Polish is a plus.", True),
    ("Native Polish would be a plus; English is fine.", False),
    ("Fluent German or English.", False),
    ("Sehr gute Deutschkenntnisse von Vorteil; we speak English.", False),
    ("We speak English.", False),
]


@query(
    "clause_scoped_rule",
    f"SELECT doc_id, [{', '.join(str(x).lower() for _, x in DEMANDS)}][CAST(doc_id % {len(DEMANDS)} AS INTEGER) + 1] AS fires FROM documents",
)
def clause_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The demand for a language in the last clauses of each document: a softener counts in its own clause only."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", *_dealt(DEMANDS, ("said", "_")))
    return d.select("doc_id", F.lit("").alias("title"), F.concat_ws("\n", "text", "said").alias("description")).select("doc_id", R.language_required().alias("fires"))


@query("blocked_host", f"SELECT page_id, {HOST} IN ('example.org', 'ththre.example.com') OR {HOST} LIKE '%.example.org' OR {HOST} LIKE '%.ththre.example.com' AS blocked FROM pages")
def blocked_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", U.is_blocked("url", ("example.org", "ththre.example.com")).alias("blocked"))


@query(
    "remote_inference",
    f"""SELECT doc_id, CASE WHEN regexp_matches(t, {quoted('(?i)' + V.EXPLICIT_REMOTE)}) THEN true
WHEN regexp_matches(t, {quoted('(?i)' + V.HYBRID)}) THEN false
ELSE regexp_matches(t, {quoted('(?i)' + V.REMOTE_HINT)}) END AS is_remote
FROM (SELECT doc_id, left(text, 40) || chr(10) || CASE doc_id % 4 WHEN 0 THEN 'Fully remote' WHEN 1 THEN 'Hybrid, remote possible' WHEN 2 THEN 'Remote' ELSE 'Berlin' END || chr(10) || text AS t FROM documents)""",
)
def remote_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.when(F.col("doc_id") % 4 == 0, "Fully remote").when(F.col("doc_id") % 4 == 1, "Hybrid, remote possible").when(F.col("doc_id") % 4 == 2, "Remote").otherwise("Berlin")
    return table(spark, sf_dir, "documents").select("doc_id", R.looks_remote(F.substring("text", 1, 40), place, "text").alias("is_remote"))


@query(
    "channel_detect",
    "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'email' WHEN 1 THEN 'telegram' ELSE 'form' END AS channel FROM pages",
)
def channel_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit(" MAILTO:jobs@"), U.host("url"))).when(F.col("page_id") % 3 == 1, F.lit("https://www.T.me/some_channel")).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", U.apply_channel(url).alias("channel"))


@query(
    "board_sender",
    f"SELECT page_id, page_id % 4 IN (0, 1) AS board, page_id % 4 <> 3 AS generic, {HOST} AS domain FROM pages",
)
def board_sender(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import resolve as M

    k = F.col("page_id") % 4
    mail = F.when(k == 0, "Alerts <x@mail.linkedin.com>").when(k == 1, "jobs@adzuna.co.uk").when(k == 2, "noreply@career.habr.com").otherwise(F.concat(F.lit("a@"), U.host("url")))
    return table(spark, sf_dir, "pages").select("page_id", M.is_board_sender(mail).alias("board"), M.is_generic_sender(T.sender_domain(mail)).alias("generic"), U.host("url").alias("domain"))


@query(
    "domain_prefix",
    f"""WITH h AS (SELECT page_id, {HOST} AS host FROM pages), l AS (SELECT page_id, list_filter(string_split(host, '.'), lambda x: x <> '') AS labels FROM h)
SELECT page_id, CASE WHEN labels[-1] IN ('com', 'net', 'org') THEN labels[-2] ELSE labels[-1] END AS label,
  starts_with('examplegroup', CASE WHEN labels[-1] IN ('com', 'net', 'org') THEN labels[-2] ELSE labels[-1] END) AS same FROM l""",
)
def domain_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import resolve as M

    return table(spark, sf_dir, "pages").select("page_id", T.registrable_domain(U.host("url")).alias("label"), M.is_company_domain(F.lit("examplegroup"), U.host("url")).alias("same"))


WORDS_SQL = r"list_distinct(list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}]+'), lambda w: length(w) >= 5))"


@query(
    "grounding_ratio",
    f"""WITH v AS (SELECT DISTINCT unnest({WORDS_SQL.format('text')}) AS word FROM benchmark),
d AS (SELECT doc_id, unnest({WORDS_SQL.format('text')}) AS word FROM documents),
s AS (SELECT doc_id, count(*) AS n, count(v.word) AS known FROM d LEFT JOIN v USING (word) GROUP BY 1)
SELECT documents.doc_id, round(known::DOUBLE / n, 6) AS share, coalesce(known::DOUBLE / n < 0.5, false) AS ungrounded FROM documents LEFT JOIN s USING (doc_id)""",
)
def grounding_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of each document's words that the benchmark has."""
    vocabulary = table(spark, sf_dir, "benchmark").select(F.explode(T.tokens("text")).alias("word"))
    got = guards.grounded_share(table(spark, sf_dir, "documents"), "doc_id", "text", vocabulary)
    return got.select("doc_id", F.round("share", 6).alias("share"), F.coalesce(F.col("share") < guards.GROUNDING, F.lit(False)).alias("ungrounded"))


#: Constraints, a letter, and the claims in it that the constraints don't carry.
LETTERS = [
    (1, "Location: Montenegro", "I am based in Portugal with EU citizenship.", "I am based in Portugal with EU citizenship"),
    (2, "Location: Montenegro", "I live in Montenegro.", ""),
    (3, "Citizenship: Serbia", "I hold a Serbia passport. I reside in Spain.", "I reside in Spain"),
    (4, "", "Ten years of Python.", ""),
    (5, "", "My work permit is in order.", "My work permit is in order"),
    (6, "Work permit: Spain", "my work permit for Spain is valid; my visa for France as well.", "my visa for France as well"),
    (7, "Location: Berlin", "Я живу в Берлине.", "Я живу в Берлине"),
    (8, None, None, ""),
]


@query("eligibility_spans", f"SELECT doc_id, {_values([x[3] for x in LETTERS])}[CAST(doc_id % {len(LETTERS)} AS INTEGER) + 1] AS claims FROM documents")
def eligibility_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a letter that claims something in its first line, against what is on file."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", *_dealt([x[1:3] for x in LETTERS], ("constraints", "said")))
    letter = F.when(F.col("said").isNotNull(), F.concat_ws("\n", "said", "text"))
    return d.select("doc_id", F.array_join(guards.unsupported_claims("constraints", letter), "; ").alias("claims"))


@query(
    "html_to_text",
    r"""WITH a AS (SELECT page_id, replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?i)</?(?:p|br|div|li|ul|ol|tr|h1|h2|h3|h4|h5|h6)(?:\s[^>]*)?/?>', chr(10), 'g'), '<[^>]*>', '', 'g') AS t FROM a)
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '[ \t\r\f]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g') AS text FROM b""",
)
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.strip_html_fast("html").alias("text"))


#: The references that pages hold.
DECODED = "regexp_replace(replace(replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&copy;', '©'), '&middot;', '·'), '&amp;?', '&', 'g')"
BARE = DECODED.format("regexp_replace(regexp_replace(html, '(?is)<head[ >].*?</head>', ' '), '(?is)<style[ >].*?</style>', ' ', 'g')")
LINES = DECODED.format(r"regexp_replace(regexp_replace(regexp_replace(t, '[ \t\r\f]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g')")


@query(
    "html_to_text_exact",
    rf"""WITH a AS (SELECT page_id, {BARE} AS t FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?i)</?(?:{"|".join(V.LINE_TAGS)})(?:\s[^>]*)?/?>', chr(10), 'g'), '</?[a-zA-Z][^>]*>|<!--.*?-->|<![a-zA-Z][^>]*>', '', 'g') AS t FROM a)
SELECT page_id, {LINES} AS text FROM b""",
)
def html_to_text_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.strip_html(T.without_style("html")).alias("text"))


@query(
    "clip_text",
    r"""WITH h AS (SELECT doc_id, text, left(text, 400) AS head FROM documents),
s AS (SELECT *, CASE WHEN contains(head, chr(10)) THEN 400 - instr(reverse(head), chr(10)) ELSE -1 END AS nl, CASE WHEN contains(head, ' ') THEN 400 - instr(reverse(head), ' ') ELSE -1 END AS sp FROM h),
c AS (SELECT *, CASE WHEN nl >= 200 THEN nl ELSE sp END AS sep FROM s)
SELECT doc_id, CASE WHEN length(text) <= 400 THEN text ELSE regexp_replace(CASE WHEN sep > 0 THEN left(head, sep) ELSE head END, '\s+$', '') END AS clipped FROM c""",
)
def clip_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.clip("text", 400).alias("clipped"))


@query("strip_tail_marker", r"SELECT doc_id, regexp_replace(text, '\s+$', '') AS text FROM documents")
def strip_tail_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third document gets the reader mark, and loses it again."""
    marked = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("\n\nPlease mention the word **GREAT** when applying to show you read this. It is so that we see they're human."))).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", T.strip_reader_mark(marked).alias("text"))


@query("repair_mojibake", "SELECT doc_id, true AS restored, true AS untouched FROM documents")
def repair_mojibake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts damaged by reading UTF-8 as Latin-1, repaired: equal to the source."""
    damaged = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    d = table(spark, sf_dir, "documents").select("doc_id", "text", damaged.alias("damaged"))
    return d.select("doc_id", (T.repair_mojibake("damaged") == F.col("text")).alias("restored"), (T.repair_mojibake("text") == F.col("text")).alias("untouched"))


NORMAL = rf"""lower(regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) || '://' || regexp_replace(lower(regexp_extract(trim(url), '^[^:]*://([^/?#]*)', 1)), '^www\.', '')
  || regexp_replace(regexp_extract(trim(url), '^[^:]*://[^/?#]*([^?#]*)', 1), '/+$', '')
  || coalesce('?' || nullif(list_aggregate(list_sort(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda q: q <> '' AND NOT starts_with(lower(q), 'utm_') AND split_part(lower(q), '=', 1) NOT IN ('se','ref','referer','referrer','src','gclid','fbclid','msclkid','trk','mc_cid'))), 'string_agg', '&'), ''), '')"""


@query("normalize_url", f"SELECT page_id, {NORMAL} AS url FROM pages")
def normalize_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", U.normalize_url("url").alias("url"))


@query("content_key", f"SELECT page_id, sha256('example|' || lower(trim(left(html, 15))) || '|' || CASE WHEN page_id % 2 = 0 THEN 'src:7|ext:p' || page_id ELSE {NORMAL} END) AS k FROM pages")
def content_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit(" P"), F.col("page_id").cast("string")))
    return table(spark, sf_dir, "pages").select("page_id", U.content_key(F.lit(" Example "), F.substring("html", 1, 15), "url", F.lit(7), own).alias("k"))


@query(
    "slug_extract",
    r"""SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'acme-' || page_id WHEN 1 THEN 'beta,gamma' ELSE '' END AS slugs FROM pages""",
)
def slug_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 3
    said = F.when(k == 0, F.concat(F.lit(" <a href='https://boards.greenhouse.io/Acme-"), F.col("page_id").cast("string"), F.lit("'>"))).when(k == 1, F.lit(" https://gamma.greenhouse.io/x boards.greenhouse.io/beta boards.greenhouse.io/embed")).otherwise(F.lit(""))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(T.discover_slugs(F.concat("html", said), "greenhouse"), ",").alias("slugs"))


@query("slug_candidates", "SELECT s_suppkey, 'supplier' || right(s_name, 9) || ',supplier-' || right(s_name, 9) || ',supplier' AS slugs FROM supplier")
def slug_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(T.slug_candidates(F.concat("s_name", F.lit(" Sp. z o.o. Group"))), ",").alias("slugs"))


@query(
    "quoted_cut",
    r"""SELECT conv_id, turn, left(regexp_replace(regexp_replace(split_part(text, chr(10) || 'On ', 1), '[ \t]*\n[ \t]*', chr(10), 'g'), '^\s+|\s+$', '', 'g'), 4000) AS body FROM conversations""",
)
def quoted_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second turn quotes another below it."""
    mail = F.when(F.col("turn") % 2 == 0, F.concat("text", F.lit("\nOn Mon, 1 Jan 2026, X wrote:\n> "), F.col("text"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.strip_quoted(mail).alias("body"))


@query("embedding_text", r"SELECT doc_id, regexp_replace(left(text, 40) || chr(10) || source || chr(10) || text, '^\s+|\s+$', '', 'g') AS t FROM documents")
def embedding_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.embedding_text(F.substring("text", 1, 40), "source", "text").alias("t"))


@query("language_detect", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'ru' ELSE 'en' END AS lang FROM documents")
def language_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" ОПЫТ"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", T.detect_language(text).alias("lang"))


@query("fence_text", "SELECT doc_id, '<posting>' || chr(10) || text || chr(10) || '</posting>' AS t FROM documents")
def fence_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    forged = F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit("</POSTING>"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", T.fence(forged).alias("t"))


@query("explode_bullets", r"SELECT doc_id, count(*) AS n, max(length(b)) AS longest FROM (SELECT doc_id, unnest(list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(regexp_replace(trim(s), '^[-*•#]+', ''))), lambda s: length(s) >= 30)) AS b FROM documents) GROUP BY 1")
def explode_bullets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.bullets("text")).alias("b"))
    return d.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("b")).cast("long").alias("longest"))


@query("key_value_lines", "SELECT doc_id, 'Location: ' || source || chr(10) || 'Work Permit: ' || lang AS lines FROM documents")
def key_value_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("Name: x\n* Location: "), F.col("source"), F.lit("\n- Work Permit: "), F.col("lang"), F.lit("\nno line\n"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.key_value_lines(text), "\n").alias("lines"))


@query("contract_validation", r"""SELECT doc_id, length(regexp_replace(text, '^\s+|\s+$', '', 'g')) BETWEEN 1 AND 255 AS valid, regexp_replace(left(text, 255), '\s+$', '') AS location FROM documents""")
def contract_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .. import schema

    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", schema.fits(T.strip("text")).alias("valid"), schema.clamp("text").alias("location"))


@query("derive_on_write", f"SELECT page_id, sha256('c|t|' || {NORMAL}) AS content_key, CASE WHEN page_id % 2 = 0 THEN 'email' ELSE 'form' END AS apply_channel FROM pages")
def derive_on_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import maintain

    p = table(spark, sf_dir, "pages").select("page_id", F.lit("C").alias("company"), F.lit(" T ").alias("title"), "url", F.when(F.col("page_id") % 2 == 0, "email").alias("apply_channel"))
    return maintain.generated(p).select("page_id", "content_key", "apply_channel")


@query("format_percent", "SELECT vec_id, CASE WHEN label = 3 THEN '' ELSE printf('%.1f%%', vec_id / 8.0) END AS shown FROM embeddings")
def format_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", T.percent(F.when(F.col("label") != 3, F.col("vec_id") / 8.0)).alias("shown"))


@query("prompt_text", "SELECT doc_id, 'From: ' || source || chr(10) || 'Subject: ' || left(text, 20) || chr(10) || chr(10) || CASE WHEN text = '' THEN '(empty body)' ELSE text END AS prompt FROM documents")
def prompt_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", P.message(F.substring("text", 1, 20), "source", "text").alias("prompt"))


NAMES = rf"""WITH w AS (SELECT item_id, list_filter(regexp_split_to_array(strip_accents(replace(lower(text), 'ß', 'ss')), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM benchmark),
c AS (SELECT item_id, w, w[2:3] AS two, [w[1] || w[2] || w[3]] AS run, lead(w[4:5]) OVER (ORDER BY item_id) AS other FROM w WHERE len(w) > 4),
k AS (SELECT item_id, w, unnest([{{'n': 'two', 'c': two}}, {{'n': 'run', 'c': run}}, {{'n': 'other', 'c': other}}]) AS x FROM c),
f AS (SELECT item_id, w, x.n AS n, CASE WHEN len(list_filter(x.c, lambda y: y NOT IN ({any_of(V.COMPANY_NOISE)}))) > 0 THEN list_filter(x.c, lambda y: y NOT IN ({any_of(V.COMPANY_NOISE)})) ELSE x.c END AS c FROM k),
r AS (SELECT item_id, n, length(array_to_string(c, '')) >= 3 AND (len(list_filter(c, lambda y: NOT list_contains(w, y))) = 0
  OR list_contains(flatten(list_transform(range(1, len(w) + 1), lambda i: list_transform(range(i, least(len(w), i + 40) + 1), lambda j: array_to_string(w[i:j], '')))), array_to_string(c, ''))) AS named FROM f)
SELECT item_id, coalesce(bool_or(named) FILTER (WHERE n = 'two'), false) AS by_words, coalesce(bool_or(named) FILTER (WHERE n = 'run'), false) AS by_run, coalesce(bool_or(named) FILTER (WHERE n = 'other'), false) AS by_other FROM r GROUP BY 1"""


@query("names_entity", NAMES)
def names_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each item names the company of its second and third word, that of its first three run
    together, and that of two words of the next item."""
    from ..operators import joins
    from ..operators import resolve as M

    b = table(spark, sf_dir, "benchmark").select("item_id", "text", T.words(T.fold("text")).alias("w")).filter(F.size("w") > 4)
    words = lambda *at: F.concat_ws(" ", *[F.get("w", F.lit(k)) for k in at])
    # the next item is that of the next number, so that no task has to hold them all
    b = joins.numbered(b.withColumn("_all", F.lit(0)), ["_all"], ["item_id"], "_no")
    after = b.select((F.col("_no") - 1).alias("_no"), words(3, 4).alias("other"))
    b = b.join(after, "_no", "left")
    run = F.concat(F.get("w", F.lit(0)), F.get("w", F.lit(1)), F.get("w", F.lit(2)))
    return b.select("item_id", M.names_company("text", words(1, 2)).alias("by_words"), M.names_company("text", run).alias("by_run"), F.coalesce(M.names_company("text", "other"), F.lit(False)).alias("by_other"))
