"""Times out of feeds and mail, and the zone of the reviewer."""

from __future__ import annotations

from datetime import UTC, datetime
from functools import lru_cache
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col


def from_epoch(x: Column | str) -> Column:
    """Seconds since 1970; null, empty, zero and what isn't a number give null."""
    n = _col(x).try_cast("long")
    return F.when(n != 0, F.timestamp_seconds(n))


def from_epoch_millis(x: Column | str) -> Column:
    n = _col(x).try_cast("long")
    return F.when(n != 0, F.timestamp_millis(n))


def from_iso(x: Column | str) -> Column:
    """ISO 8601; without a zone it is UTC (the session's zone has to be UTC)."""
    return F.try_to_timestamp(_col(x))


def from_rfc822(x: Column | str) -> Column:
    """``Tue, 04 Aug 2026 10:00:00 +0000``, with or without the weekday, zone by number or name."""
    t = F.regexp_replace(_col(x), r"^\s*[A-Za-z]{3},\s*", "")
    t = F.regexp_replace(t, r"\s(?:GMT|UT|UTC|Z)\s*$", " +0000")
    for name, offset in (("EST", "-0500"), ("EDT", "-0400"), ("CST", "-0600"), ("CDT", "-0500"), ("MST", "-0700"), ("MDT", "-0600"), ("PST", "-0800"), ("PDT", "-0700")):
        t = F.regexp_replace(t, rf"\s{name}\s*$", f" {offset}")
    return F.coalesce(F.try_to_timestamp(t, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(t, F.lit("d MMM yyyy HH:mm Z")), F.try_to_timestamp(t, F.lit("d MMM yyyy HH:mm:ss")))


def to_wall_clock(x: Column | str, zone: str) -> Column:
    """A stored UTC time as the clock of ``zone`` shows it."""
    return F.from_utc_timestamp(_col(x), zone)


def from_wall_clock(x: Column | str, zone: str) -> Column:
    """The inverse; of a repeated hour the first pass."""
    return F.to_utc_timestamp(_col(x), zone)


reinterpret_zone = from_wall_clock


@lru_cache
def _names(zone: str) -> tuple[tuple[int, str], ...]:
    """Offsets of a zone in minutes, and what they are called, by now."""
    year, z = datetime.now(UTC).year, ZoneInfo(zone)
    days = [datetime(year, m, 15, 12, tzinfo=z) for m in range(1, 13)]
    return tuple(sorted({(int(d.utcoffset().total_seconds() // 60), d.tzname()) for d in days}))


def zone_name(utc: Column | str, zone: str) -> Column:
    """What the zone is called at that time (CET or CEST)."""
    local = F.from_utc_timestamp(_col(utc), zone)
    minutes = ((F.unix_seconds(local) - F.unix_seconds(_col(utc))) / 60).cast("int")
    return F.create_map(*[F.lit(x) for pair in _names(zone) for x in pair])[minutes]


def show_wall_clock(utc: Column | str, zone: str) -> Column:
    """``2026-08-04 21:00 CEST``."""
    return F.concat_ws(" ", F.date_format(to_wall_clock(utc, zone), "yyyy-MM-dd HH:mm"), zone_name(utc, zone))


def parse_wall_clock(text: Column | str, zone: str) -> Column:
    """A time by the clock of ``zone`` as UTC, with seconds or without. A zone's name behind it has to
    be the one that the zone has at that time, else the result is null."""
    t = F.trim(_col(text))
    name = F.regexp_extract(t, r"\s([A-Za-z]+)$", 1)
    bare = F.trim(F.regexp_replace(t, r"\s[A-Za-z]+$", ""))
    local = F.coalesce(F.try_to_timestamp(bare, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(bare, F.lit("yyyy-MM-dd HH:mm")))
    utc = from_wall_clock(local, zone)
    return F.when((name == "") | (name == zone_name(utc, zone)), utc)
