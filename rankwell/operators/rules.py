"""The rule engine: named boolean columns and their conjunction.

A posting needs title, description, location and is_remote. Nulls count as empty texts and
as not remote. ``reasons`` says which rules stopped a posting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocabulary as V

JUDGEABLE, HEADING = 100, 80


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def normalized_title(title: Column | str = "title") -> Column:
    t = F.coalesce(F.col(title) if isinstance(title, str) else title, F.lit(""))
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.lower(F.regexp_replace(T.collapse(t), r"^[ \-–—:|]+|[ \-–—:|]+$", ""))


def junk_title(title: Column | str = "title") -> Column:
    return normalized_title(title).isin(*V.JUNK_TITLES)


def unwritten_body() -> Column:
    """Long, complete prose in which no word of hiring occurs."""
    body = _text("description")
    both = F.concat(_text("title"), F.lit("\n"), body)
    return (F.length(body) >= JUDGEABLE) & body.rlike(V.PROSE) & ~body.rlike(V.TRUNCATED) & ~T.matches_any(both, V.HIRING_WORDS)


def relocation_scam() -> Column:
    both = F.concat(_text("title"), F.lit("\n"), _text("description"))
    return T.matches(both, V.PASSPORT) & T.matches(both, V.RELOCATION) & (T.matches(both, V.LANGUAGE_SOUP) | T.matches(both, V.BOILERPLATE))


def heading_location() -> Column:
    """The first line of the body, where the location is empty and the line is short."""
    first = T.strip(F.get(F.split(T.strip(_text("description")), r"\R"), F.lit(0)))
    return F.when((T.strip(_text("location")) == "") & (F.length(first) <= HEADING), first).otherwise(F.lit(""))


def stopped_place() -> Column:
    return T.matches("location", V.STOP_PLACES) | T.matches(heading_location(), V.STOP_PLACES)


def haystack() -> Column:
    return F.concat_ws("\n", _text("title"), _text("description"), _text("location"))


def clearance_required() -> Column:
    return T.matches_hinted(haystack(), V.CLEARANCE, ("clearance", "active"))


def language_required() -> Column:
    """A clause that demands a language and doesn't take it back itself. Texts, and then clauses, that
    name no language are left out by that alone."""
    both = F.concat(_text("title"), F.lit("\n"), _text("description"))
    named, demands, optional = ("(?iU)" + x for x in (V.LANGUAGE_NAMED, V.LANGUAGE_REQUIRED, V.LANGUAGE_OPTIONAL))
    return both.rlike(named) & F.exists(T.clauses(both), lambda c: c.rlike(named) & c.rlike(demands) & ~c.rlike(optional))


def below_middle() -> Column:
    return T.matches("title", V.JUNIOR_TITLE) & ~T.matches("title", V.MIDDLE_TITLE)


def training_primary() -> Column:
    return T.matches("title", V.TRAINING_TITLE) & ~T.matches("title", V.PLATFORM_TITLE)


def sponsorship_refused() -> Column:
    return T.matches(haystack(), V.NO_SPONSORSHIP) & ~T.matches("location", V.LOCAL_PLACES)


def geo_locked() -> Column:
    """A remote posting tied to a region, with none of the escapes."""
    hay = haystack()
    invites = F.regexp_replace(hay, "(?iU)" + V.REGION_AS_REQUIREMENT, " ")
    return (T.matches(hay, V.GEO_LOCKED) | sponsorship_refused()) & ~T.matches(hay, V.CONTRACTOR_OK) & ~T.matches(invites, V.REGION_OK) & ~T.matches(hay, V.AUTHORIZATION_OPEN)


def rules() -> dict[str, Column]:
    """Rule by name, in the order of evaluation; true stops the posting."""
    remote = F.coalesce(F.col("is_remote"), F.lit(False))
    return {
        "junk_title": junk_title(),
        "unwritten_body": unwritten_body(),
        "relocation_scam": relocation_scam(),
        "stopped_place": stopped_place(),
        "clearance": clearance_required(),
        "language": language_required(),
        "below_middle": below_middle(),
        "model_training": training_primary(),
        "sponsorship_refused": ~remote & sponsorship_refused(),
        "geo_locked": remote & geo_locked(),
    }


def passes() -> Column:
    stop = F.lit(False)
    for rule in rules().values():
        stop = stop | rule
    return ~stop


def reasons() -> Column:
    """The names of the rules that stop a posting."""
    return F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules().items()]))


def judged(postings: DataFrame) -> DataFrame:
    missing = {"title", "description", "location", "is_remote"} - set(postings.columns)
    if missing:
        raise ValueError(f"postings lack {sorted(missing)}")
    # each rule is tried once: what nothing stopped passes
    got = postings.withColumn("reasons", reasons()).withColumn("passed", F.size("reasons") == 0)
    return got.select(*[c for c in got.columns if c != "reasons"], "reasons")


def looks_remote(title: Column | str, location: Column | str, description: Column | str) -> Column:
    """An outright claim wins, else a hybrid marker is decisive against, else a mention counts."""
    col = lambda c: F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    text = F.concat(col(title), F.lit("\n"), col(location), F.lit("\n"), col(description))
    return F.when(T.matches(text, V.EXPLICIT_REMOTE), True).when(T.matches(text, V.HYBRID), False).otherwise(T.matches(text, V.REMOTE_HINT))
