"""Text guards around a drafter, and the places where models are put in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

GROUNDING = 0.5

# What a claim of residence and of eligibility looks like, and the words that show
# that the profile says something about it.
RESIDENCE = (
    r"\bI(?:'m|’m| am)\s+(?:currently\s+|now\s+)?(?:based|located|living|residing)\b[^.;!?\n]*"
    r"|\bI\s+(?:live|reside)\b[^.;!?\n]*|\bя\s+(?:живу|нахожусь|проживаю|базируюсь)\b[^.;!?\n]*"
)
ELIGIBILITY = (
    r"\b(?:citizen|citizens|citizenship|passport|nationality|work permit|residence permit|residency|work visa|visa"
    r"|authoriz(?:ed|ation)\s+to\s+work|right\s+to\s+work|work\s+authoriz\w*)\b"
    r"|гражданств|паспорт|вид на жительство|разрешени[ея] на работу"
)
ON_FILE = ("citizen", "passport", "nationality", "permit", "visa", "authoriz", "гражданств", "паспорт")
PLACE = r"(?U)\b(?:[A-Z]{2,}|[A-ZА-ЯЁ][\wа-я-]+)"


def grounding(point: Column | str, vocabulary: Column | str) -> Column:
    """The share of a point's words that the vocabulary has; null without words."""
    own = T.tokens(point)
    return F.when(F.size(own) > 0, F.size(F.array_intersect(own, F.col(vocabulary) if isinstance(vocabulary, str) else vocabulary)) / F.size(own))


def ungrounded(points: Column | str, bullets: Column | str) -> Column:
    """The points of which less than half is in the bullets; none if the bullets have no words."""
    vocabulary = T.tokens(F.array_join(bullets, " "))
    return F.when(F.size(vocabulary) == 0, F.array().cast("array<string>")).otherwise(F.filter(points, lambda p: F.coalesce(grounding(p, vocabulary) < GROUNDING, F.lit(False))))


def refuse(points: Column | str, bullets: Column | str) -> Column:
    """Whether more than half of the points are ungrounded."""
    p = F.col(points) if isinstance(points, str) else points
    return F.size(ungrounded(p, bullets)) * 2 > F.size(p)


def unsupported_claims(constraints: Column | str, letter: Column | str) -> Column:
    """The claims of residence or eligibility that the constraints don't carry."""
    hay = F.lower(F.coalesce(F.col(constraints) if isinstance(constraints, str) else constraints, F.lit("")))
    text = F.coalesce(F.col(letter) if isinstance(letter, str) else letter, F.lit(""))
    spans = lambda p: F.transform(F.regexp_extract_all(text, F.lit("(?iU)" + p), F.lit(0)), lambda c: T.strip(c))
    foreign = lambda c: F.exists(F.regexp_extract_all(c, F.lit(PLACE), F.lit(0)), lambda w: ~F.contains(hay, F.lower(w)))
    filed = F.exists(F.array(*[F.lit(w) for w in ON_FILE]), lambda w: F.contains(hay, w))
    residence = F.filter(spans(RESIDENCE), foreign)
    # a claim of eligibility is the whole clause, so clauses are tested, once each
    told = F.transform(F.filter(F.split(text, r"[.;!?\n]"), lambda c: c.rlike("(?iU)" + ELIGIBILITY)), lambda c: T.strip(c))
    told = F.filter(told, lambda c: (c != "") & (~filed | foreign(c)))
    # the residence claims are found once, and bound to r
    return F.get(F.transform(F.array(residence), lambda r: F.concat(r, F.filter(told, lambda c: ~F.array_contains(r, c)))), F.lit(0))


Classifier = Callable[[str, str, str], dict]


REJECTION_WORDS = ("unfortunately", "not moving forward", "other candidates", "regret", "к сожалению")
INTERVIEW_WORDS = ("interview", "schedule", "call with", "next step", "собеседован")
JOB_WORDS = ("application", "applied", "role", "position", "отклик")


def keyword_classifier(subject: str, sender: str, body: str) -> dict:
    """A deterministic stand-in for a model: reply type by words, confidence by how many."""
    text = f"{subject}\n{body}".lower()
    votes = {
        "rejection": sum(w in text for w in REJECTION_WORDS),
        "interview": sum(w in text for w in INTERVIEW_WORDS),
    }
    best = max(votes, key=lambda k: (votes[k], k))
    kind = best if votes[best] else "no_reply"
    job_related = bool(votes[best]) or any(w in text for w in JOB_WORDS)
    return {"reply_type": kind, "confidence": min(1.0, 0.6 + 0.2 * votes[best]) if votes[best] else 0.5, "reasoning": f"{votes[best]} words", "company": None, "role": None, "job_related": job_related}


VERDICT = "reply_type string, confidence double, reasoning string, company string, role string, job_related boolean"


def classify(messages: DataFrame, classifier: Callable[[], Classifier] = lambda: keyword_classifier) -> DataFrame:
    """``messages`` (subject, from_address, body) with a verdict struct.

    ``classifier`` makes the callable once in each worker; whatever it raises becomes the
    reasoning of a no_reply verdict, so one message never stops the rest.
    """

    @F.pandas_udf(VERDICT)
    def run(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        call = classifier()
        for s, f, b in parts:
            rows = []
            for x in zip(s.fillna(""), f.fillna(""), b.fillna(""), strict=True):
                try:
                    rows.append(call(*x))
                except Exception as e:  # noqa: BLE001
                    rows.append({"reply_type": "no_reply", "confidence": 0.0, "reasoning": f"error: {e}", "company": None, "role": None, "job_related": True})
            yield pd.DataFrame(rows, columns=["reply_type", "confidence", "reasoning", "company", "role", "job_related"])

    return messages.withColumn("verdict", run("subject", "from_address", "body"))


Drafter = Callable[[str, list[str]], dict]


def plain_drafter(posting: str, bullets: list[str]) -> dict:
    """A deterministic drafter: quotes the bullets it was given."""
    return {"subject": "Application", "body": "Hello,\n" + "\n".join(bullets), "points": list(bullets)}


OUTCOME = "verdict string, detail string, subject string, body string, points array<string>"


def screen_and_draft(jobs: DataFrame, screen: Callable[[str], tuple[bool, str]], drafter: Drafter = plain_drafter, constraints: str = "") -> DataFrame:
    """``jobs`` (posting, bullets) with outcome: declined, drafted, refused (points that the bullets don't
    carry), fabricated (claims of eligibility that isn't on file) or error.

    The drafter is called for what the screen lets through; the guards are native expressions
    over what it gives back. A failure of either call is an outcome of its row.
    """

    @F.pandas_udf(OUTCOME)
    def run(posting: pd.Series, bullets: pd.Series) -> pd.DataFrame:
        rows = []
        for p, b in zip(posting, bullets, strict=True):
            try:
                worth, why = screen(p)
                draft = drafter(p, list(b)) if worth else {"subject": None, "body": None, "points": []}
                rows.append({"verdict": "drafted" if worth else "declined", "detail": why, **{k: draft[k] for k in ("subject", "body", "points")}})
            except Exception as e:  # noqa: BLE001
                rows.append({"verdict": "error", "detail": str(e), "subject": None, "body": None, "points": []})
        return pd.DataFrame(rows, columns=["verdict", "detail", "subject", "body", "points"])

    def guarded(outcome: Column) -> Column:
        drafted = outcome["verdict"] == "drafted"
        loose = drafted & (F.size("bullets") > 0) & refuse(outcome["points"], F.col("bullets"))
        claims = drafted & (F.size(unsupported_claims(F.lit(constraints), F.concat_ws("\n", outcome["subject"], outcome["body"]))) > 0)
        as_ = lambda v: outcome.withField("verdict", F.lit(v))
        return F.when(F.coalesce(loose, F.lit(False)), as_("refused")).when(F.coalesce(claims, F.lit(False)), as_("fabricated")).otherwise(outcome)

    return jobs.withColumn("outcome", run.asNondeterministic()("posting", "bullets")).withColumn("outcome", guarded(F.col("outcome")))


def state_rows(done: DataFrame) -> DataFrame:
    """``job_id, status, cover_letter, notes`` to write after a batch of drafts: what was declined and
    what was drafted; errors, refusals and fabrications write nothing."""
    o = F.col("outcome")
    drafted = o["verdict"] == "drafted"
    letter = F.when(drafted, F.concat(F.lit("Subject: "), o["subject"], F.lit("\n\n"), o["body"]))
    points = F.when(F.size(o["points"]) > 0, F.concat(F.lit("Leans on: "), F.array_join(o["points"], "; ")))
    notes = F.when(drafted, points).otherwise(F.concat(F.lit("Screen declined: "), o["detail"]))
    return done.filter(o["verdict"].isin("drafted", "declined")).select(F.col("id").alias("job_id"), o["verdict"].alias("status"), letter.alias("cover_letter"), notes.alias("notes"))


def grounded_share(points: DataFrame, ident: str, point: str, vocabulary: DataFrame) -> DataFrame:
    """``ident, share`` for each row of ``points``: the share of its words among those of ``vocabulary`` (word).

    For a vocabulary of any size: words meet by equality. Null without words.
    """
    words = points.select(ident, F.explode_outer(T.tokens(point)).alias("word"))
    known = vocabulary.select("word").distinct().withColumn("_known", F.lit(1))
    return words.join(known, "word", "left").groupBy(ident).agg((F.count("_known") / F.nullif(F.count("word"), F.lit(0))).alias("share"))
