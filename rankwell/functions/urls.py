"""URLs: what identifies a page, and where one applies."""

from __future__ import annotations

from urllib.parse import parse_qsl, urlencode

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import vocabulary as V
from .text import _col, strip

BLOCKED_HOSTS = ("adzuna.com", "adzuna.ca", "remoteok.com")
CHAT_HOSTS = ("t.me", "telegram.me", "telegram.dog")


def host(url: Column | str) -> Column:
    """The host in lower case without ``www.``; empty if there is none."""
    authority = F.regexp_extract(strip(F.coalesce(_col(url), F.lit(""))), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(F.lower(authority), r"^www\.", "")


def under(name: Column, hosts: tuple[str, ...]) -> Column:
    """Whether a host is one of ``hosts`` or below one; never a mere part of the name."""
    return F.coalesce(name.isin(*hosts) | F.exists(F.array(*[F.lit(f".{h}") for h in hosts]), lambda h: F.endswith(name, h)), F.lit(False))


def is_blocked(url: Column | str, hosts: tuple[str, ...] = BLOCKED_HOSTS) -> Column:
    return under(host(url), hosts)


def apply_channel(url: Column | str) -> Column:
    raw = F.lower(strip(F.coalesce(_col(url), F.lit(""))))
    return F.when(raw.startswith("mailto:"), "email").when(host(url).isin(*CHAT_HOSTS), "telegram").otherwise("form")


@F.pandas_udf(StringType())
def _query(q: pd.Series) -> pd.Series:
    return q.map(lambda s: urlencode(sorted(parse_qsl(s or "", keep_blank_values=True))))


def normalize_url(url: Column | str) -> Column:
    """Scheme and host in lower case, no ``www.``, no slash at the end, no fragment, no
    parameters that change between fetches; the rest in order.

    Queries that hold encoded characters are decoded and encoded anew in Python; of other
    rows a null goes there.
    """
    u = strip(F.coalesce(_col(url), F.lit("")))
    part = lambda g: F.regexp_extract(u, r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?", g)
    volatile = F.array(*[F.lit(p) for p in V.VOLATILE_PARAMS])
    name = lambda p: F.lower(F.substring_index(p, "=", 1))
    pairs = F.filter(F.split(part(4), "&"), lambda p: (p != "") & ~F.array_contains(volatile, name(p)) & ~name(p).startswith("utm_"))
    whole = F.transform(pairs, lambda p: F.when(F.instr(p, "=") > 0, p).otherwise(F.concat(p, F.lit("="))))
    plain = F.array_join(F.transform(F.array_sort(F.transform(whole, lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.substring(p, F.instr(p, "=") + 1, F.length(p)).alias("v")))), lambda s: F.concat(s["k"], F.lit("="), s["v"])), "&")
    odd = F.coalesce(plain.rlike(r"[^A-Za-z0-9_.~=&-]"), F.lit(False))
    query = F.when(odd, _query(F.when(odd, plain))).otherwise(plain)
    scheme, authority = F.lower(part(1)), F.regexp_replace(F.lower(part(2)), r"^www\.", "")
    path = F.regexp_replace(F.regexp_replace(part(3), r";[^/]*$", ""), "/+$", "")
    out = F.concat(F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(F.lit("")), F.when(authority != "", F.concat(F.lit("//"), authority)).otherwise(F.lit("")), path)
    return F.concat(out, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def content_key(company: Column | str, title: Column | str, url: Column | str, source_id: Column | None = None, external_id: Column | None = None) -> Column:
    """The key of a record: company, title, and its id at the source, else its URL."""
    ident = normalize_url(url)
    if source_id is not None and external_id is not None:
        own = strip(F.coalesce(external_id, F.lit("")))
        ident = F.when(source_id.isNotNull() & (own != ""), F.concat(F.lit("src:"), source_id.cast("string"), F.lit("|ext:"), F.lower(own))).otherwise(ident)
    return F.sha2(F.concat_ws("|", F.lower(strip(F.coalesce(_col(company), F.lit("")))), F.lower(strip(F.coalesce(_col(title), F.lit("")))), ident), 256)
