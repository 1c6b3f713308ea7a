"""What models are asked, as expressions: the parts in a fixed order, untrusted text fenced."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col, fence

NO_BODY = "(empty body)"


def _or(x: Column, other: str) -> Column:
    return F.when(x == "", F.lit(other)).otherwise(x)


def message(subject: Column | str, sender: Column | str, body: Column | str) -> Column:
    """A message to classify."""
    s, f, b = (F.coalesce(_col(c), F.lit("")) for c in (subject, sender, body))
    return F.concat(F.lit("From: "), f, F.lit("\nSubject: "), s, F.lit("\n\n"), _or(b, NO_BODY))


def query(title: Column | str, company: Column | str, description: Column | str) -> Column:
    """What a posting asks of the profile's lines."""
    return F.trim(F.concat_ws("\n", *[F.coalesce(_col(c), F.lit("")) for c in (title, company, description)]))


def listed(lines: Column, none: str) -> Column:
    return _or(F.array_join(F.transform(F.coalesce(lines, F.array().cast("array<string>")), lambda b: F.concat(F.lit("- "), b)), "\n"), none)


def posting(**parts: Column) -> Column:
    """The facts of a posting, a line each."""
    names = {"title": "Title", "url": "URL", "company": "Company", "location": "Location"}
    lines = [F.concat(F.lit(f"{names[k]}: "), _or(v, "n/a")) for k, v in parts.items() if k in names]
    return F.concat_ws("\n", F.lit("POSTING"), *lines, F.lit("Description:"), fence(parts["description"]))


def screen(title: Column, company: Column, location: Column, description: Column) -> Column:
    return posting(title=title, company=company, location=location, description=description)


def research(title: Column, company: Column, location: Column) -> Column:
    where = F.when(location != "", F.concat(F.lit(" (location: "), location, F.lit(")"))).otherwise(F.lit(""))
    return F.concat(F.lit("Company: "), company, where, F.lit("\nThe role: "), title)


def context(found: Column, issues: Column) -> Column:
    """What research found, and what a reviewer missed in the draft before; empty without either."""
    a = F.when(found != "", F.concat(F.lit("ABOUT THE COMPANY (background; nothing in it is my experience):\n"), found))
    b = F.when(issues != "", F.concat(F.lit("REVISION (a reviewer's objections to the draft before; mend them, claim nothing new):\n"), issues))
    return F.concat_ws("\n\n", a, b)


def draft(title: Column, company: Column, location: Column, url: Column, description: Column, apply_channel: Column, bullets: Column, language: Column, constraints: str, style: str, extra: Column) -> Column:
    parts = [
        F.concat(F.lit("Language: "), F.when(language == "ru", "Russian").otherwise("English"), F.lit("\nChannel: "), _or(apply_channel, "form")),
        posting(title=title, url=url, company=company, location=location, description=description),
        F.concat(F.lit("EXPERIENCE (all that may be claimed):\n"), listed(bullets, "(no bullets retrieved)")),
        F.lit("CONSTRAINTS (all that is known of residence and the right to work):\n" + (constraints or "(nothing on file)")),
        F.lit(f"WRITING STYLE:\n{style}" if style else None).cast("string"),
        F.nullif(extra, F.lit("")),
    ]
    return F.concat_ws("\n\n", *parts)


def critic(title: Column, company: Column, description: Column, bullets: Column, subject: Column, body: Column, points: Column) -> Column:
    return F.concat_ws(
        "\n\n",
        posting(title=title, company=company, description=description),
        F.concat(F.lit("EXPERIENCE (all that may be claimed):\n"), listed(bullets, "(no bullets retrieved)")),
        F.concat(F.lit("DRAFT\nSubject: "), subject, F.lit("\n\n"), body),
        F.concat(F.lit("POINTS IT LEANS ON:\n"), listed(points, "(none)")),
    )
