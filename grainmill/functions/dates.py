"""Deadlines in words, buckets of urgency, dates found in prose."""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import date

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DateType

from grainmill.functions.instants import parse_instant, utc_date

ZONE = "America/Chicago"
#: Notations of a date in prose, the first that gives one counts (fixed patterns).
NOTATIONS = (r"[A-Z][a-z]{2,8}\.? \d{1,2},?\s*\d{4}", r"\d{1,2} [A-Z][a-z]{2,8},?\s*\d{4}", r"\d{1,2}/\d{1,2}/\d{2,4}", r"\d{4}-\d{2}-\d{2}", r"[A-Z][a-z]{2,8}\.?\s+\d{4}")
#: Labels that stand before a deadline, then phrases that lead to one (fixed patterns).
LABELS = r"(?:deadline|due date|closes?|closing date|expiration|expires?|submit by|applications? due|apply by)[:\s]*"
PHRASES = (
    r"applications?\s+(?:are\s+)?due\s+(?:by|on|:?\s*)\s*",
    r"deadline\s+(?:is|to apply)\s+",
    r"must\s+be\s+(?:submitted|received)\s+(?:by|before)\s+",
    r"submit\s+(?:your\s+)?applications?\s+(?:by|before)\s+",
    r"no\s+later\s+than\s+",
    r"(?:closes?|closing)\s+(?:on\s+|date\s+)",
    r"(?:open|available)\s+(?:through|until|till)\s+",
    r"accepting\s+applications?\s+(?:through|until|till)\s+",
    r"(?:apply|register)\s+(?:by|before)\s+",
)
#: Characters after a label or phrase in which its date may stand.
REACH = 80
_NOTATIONS = [re.compile(p, re.I) for p in NOTATIONS]
_LEADS = [re.compile(p, re.I) for p in (LABELS, *PHRASES)]
_MONTH = re.compile(r"(?i)^(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+(\d{4})$")
_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def days_left(deadline: Column, as_of: Column) -> Column:
    """Days until a deadline, begun days counting whole; negative once it has passed for a day."""
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    return F.ceil((us(deadline) - us(as_of)) / 86_400_000_000)


def has_passed(deadline: Column, as_of: Column) -> Column:
    """Whether a deadline lies before the moment; false for none."""
    return F.coalesce(deadline < as_of, F.lit(False))


def is_urgent(deadline: Column, as_of: Column, days: int = 7) -> Column:
    """Whether a deadline is ahead, by less than so many days."""
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    ahead = us(deadline) - us(as_of)
    return F.coalesce((ahead > 0) & (ahead < days * 86_400_000_000), F.lit(False))


def urgency_label(deadline: Column, as_of: Column) -> Column:
    """"Closing tomorrow" or "Closing in Nd" for what is urgent, else null."""
    d = days_left(deadline, as_of)
    return F.when(is_urgent(deadline, as_of), F.when(d == 1, "Closing tomorrow").otherwise(F.concat(F.lit("Closing in "), d.cast("string"), F.lit("d"))))


def urgency_bucket(deadline: Column, as_of: Column) -> Column:
    """EXPIRED, THIS WEEK, NEXT WEEK, THIS MONTH, UPCOMING within 60 days, else null."""
    d = days_left(deadline, as_of)
    return F.when(d < 0, "EXPIRED").when(d <= 7, "THIS WEEK").when(d <= 14, "NEXT WEEK").when(d <= 30, "THIS MONTH").when(d <= 60, "UPCOMING")


def short_deadline(deadline: Column, as_of: Column) -> Column:
    """A deadline in a few words, in the display zone."""
    shown = F.date_format(F.from_utc_timestamp(deadline.cast("timestamp"), ZONE), "MMM d, yyyy")
    d = days_left(deadline, as_of)
    return F.when(deadline.isNull(), "No deadline").when(d < 0, F.concat(F.lit("Closed "), shown)).when(d <= 30, F.concat(d.cast("string"), F.lit("d left - "), shown)).otherwise(shown)


def _plain(text: str | None) -> str:
    return re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", text or ""))


def _day(written: str, first_year: int, last_year: int) -> date | None:
    """The day that a written date means, a month alone its first; None outside the years."""
    m = _MONTH.match(written.strip())
    if m:
        got = date(int(m[2]), _MONTHS.index(m[1].lower()) + 1, 1)
    else:
        us = parse_instant(re.sub(r"(?<=[A-Za-z])\.", "", written))
        got = None if us is None else utc_date(us)
    return got if got is not None and first_year <= got.year <= last_year else None


def in_years(deadline: Column, as_of: Column) -> Column:
    """A deadline whose year lies between the last one and ten years ahead, else null."""
    return F.when((F.year(deadline) >= F.year(as_of) - 1) & (F.year(deadline) <= F.year(as_of) + 10), deadline)


def needs_check(deadline: Column, candidates: Column, as_of: Column) -> Column:
    """Whether a deadline should be looked at: none, one that has passed, or a date in the text more than a day off."""
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    off = F.exists(candidates, lambda d: F.abs(us(d) - us(deadline)) > 86_400_000_000)
    return F.coalesce(deadline < as_of, F.lit(True)) | F.coalesce(off, F.lit(False))


def open_ended(text: Column) -> Column:
    """Whether a deadline in words leaves the date open."""
    return F.coalesce(text.rlike(r"(?i)rolling|ongoing|year-round|open|varies|tbd|n/a"), F.lit(False))


def written_day(text: Column, first_year: int = 2024) -> Column:
    """The day of a deadline written alone, open-ended ones null; years before the first count as mistakes."""
    t = F.trim(text)
    ways = [F.try_to_timestamp(t, F.lit(f)) for f in ("MMMM d, yyyy", "MMM d, yyyy", "M/d/yyyy")]
    iso = F.try_to_timestamp(F.regexp_extract(t, r"^(\d{4}-\d{2}-\d{2})", 1), F.lit("yyyy-MM-dd"))
    day = F.coalesce(iso, *ways).cast("date")
    return F.when(~open_ended(t) & (F.year(day) >= first_year), day)


def dates_in(text: str | None, first_year: int, last_year: int) -> list[date]:
    """The dates that a text names within the years, notation by notation."""
    plain = _plain(text)
    return [d for p in _NOTATIONS for m in p.finditer(plain) if (d := _day(m[0], first_year, last_year))]


def first_date(text: str, first_year: int, last_year: int) -> date | None:
    """The first hit of the first notation that means a day within the years."""
    hits = (p.search(text) for p in _NOTATIONS)
    return next((d for m in hits if m and (d := _day(m[0], first_year, last_year))), None)


def deadline_in(text: str | None, first_year: int, last_year: int) -> date | None:
    """The date soon after a label, label by label; else after a phrase, phrase by phrase."""
    plain = _plain(text)
    near = (first_date(plain[m.end() : m.end() + REACH], first_year, last_year) for lead in _LEADS for m in lead.finditer(plain))
    return next((d for d in near if d), None)


def date_candidates(year: int):
    """A pandas UDF: all dates in a text from the year before to ten years after."""

    @F.pandas_udf(ArrayType(DateType()))
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series([dates_in(t, year - 1, year + 10) for t in s], dtype="object")

    return run


def labelled_deadline(year: int):
    """A pandas UDF: the date that a text gives for its deadline."""

    @F.pandas_udf(DateType())
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series([deadline_in(t, year - 1, year + 10) for t in s], dtype="object")

    return run
