"""One written date or time -> microseconds since 1970 in UTC.

Pure Python, used once per distinct (text, zone, order) by operators.instants.
"""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_MONTH = {m: i for i, name in enumerate(MONTHS, 1) for m in (name, name[:3])} | {"sept": 9}
_MONTH_RE = "(" + "|".join(sorted(_MONTH, key=len, reverse=True)) + r")\b\.?"

#: Hours east of UTC of fixed abbreviations, and zones of the generic ones (fixed values).
FIXED_ABBR = {"z": 0, "utc": 0, "gmt": 0, "bst": 1, "cest": 2, "cet": 1, "est": -5, "edt": -4, "cst": -6, "cdt": -5, "mst": -7, "mdt": -6, "pst": -8, "pdt": -7, "akst": -9, "akdt": -8, "hst": -10}
GENERIC_ABBR = {"et": "America/New_York", "ct": "America/Chicago", "mt": "America/Denver", "pt": "America/Los_Angeles"}
GENERIC_WORDS = {"eastern": "et", "central": "ct", "mountain": "mt", "pacific": "pt"}

_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
_JSON_DATE = re.compile(r"^/Date\((-?\d+)(?:[+-]\d{4})?\)/$")
_COMPACT = re.compile(r"^(\d{4})(\d{2})(\d{2})(?:[T ]?(\d{2})(\d{2})(\d{2})?)?$")
_DATES = (
    ("ymd", re.compile(r"(?<!\d)(\d{4})([-/.])(\d{1,2})\2(\d{1,2})(?!\d)")),
    ("num", re.compile(r"(?<![\d.:/-])(\d{1,2})([-/.])(\d{1,2})\2(\d{4}|\d{2})(?![\d/-])")),
    ("java", re.compile(rf"\b{_MONTH_RE}\s+(\d{{1,2}})\s+(?=\d{{1,2}}:\d{{2}}.*\b(\d{{4}})\s*$)", re.I)),
    ("mdy", re.compile(rf"\b{_MONTH_RE}\s*(\d{{1,2}})(?:st|nd|rd|th)?\b,?\s*,?\s*(\d{{4}})(?!\d)", re.I)),
    ("dmy", re.compile(rf"(?<!\d)(\d{{1,2}})(?:st|nd|rd|th)?(?:\s+of)?[-\s/.]*{_MONTH_RE},?[-\s/.]*(\d{{4}}|\d{{2}}(?![\d:]))(?!\d)", re.I)),
    ("ymond", re.compile(rf"(?<!\d)(\d{{4}})[-\s/]+{_MONTH_RE}[-\s/]+(\d{{1,2}})(?!\d)", re.I)),
)
_OFFSET = r"(?:(?:utc|gmt)?\s*([+-])(\d{2})(?::?(\d{2}))?(?!\d))"
_ABBR = r"\b(" + "|".join([*FIXED_ABBR, *GENERIC_ABBR]) + r")\b"
_TIME = re.compile(r"(?<![\d.])(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?(?!\d)(?:\s*(noon|midnight|[ap]\.?\s?m\b\.?))?", re.I)
_HOUR = re.compile(r"(?<![\d.:])(\d{1,2})\s*(noon|midnight|[ap]\.?\s?m\b\.?)", re.I)
_NOON = re.compile(r"\b(noon|midnight)\b", re.I)
_AFTER = re.compile(rf"^\s*{_OFFSET}", re.I)
_WORD_ZONE = re.compile(r"\b(eastern|central|mountain|pacific)\b(?:\s+(?:standard|daylight))?(?:\s+time\b)?", re.I)
_ABBR_RE = re.compile(_ABBR, re.I)
_LEAD = re.compile(r"^\W*(?:(?:the\s+)?(?:application|submission|response|final|proposal|grant|next)s?\s+)?(?:deadline|due|closing|closes?|close|apply|applications?|submit|submissions?|responses?|date|by|is|are|on|before|until|through|at|no later than|must be received|ends?|end|time|local)\b\W*", re.I)
#: A word before the date that makes it something other than a closing day.
_OTHER = re.compile(r"\b(?:opens?|opening|posted|starts?|starting|begins?|early|mid|late|around|about|circa|week|month|quarter|after|from|since)\b", re.I)


@lru_cache(maxsize=256)
def _zone(name: str | None):
    try:
        return ZoneInfo(name) if name else timezone.utc
    except Exception:
        return timezone.utc


def _us(moment: datetime) -> int:
    d = moment - _EPOCH
    return (d.days * 86400 + d.seconds) * 1_000_000 + d.microseconds


def _instant(y: int, mo: int, d: int, clock: tuple[int, int, int, int], zone) -> int | None:
    h, mi, s, us = clock
    try:
        day = datetime(y, mo, d)
    except ValueError:
        return None
    if h == 24 and (mi, s, us) == (0, 0, 0):
        h, day = 0, day + timedelta(days=1)
    if h > 23 or mi > 59 or s > 60:
        return None
    # fold=0: of an hour that occurs twice the earlier; a skipped one moves ahead by the gap
    local = day.replace(hour=h, minute=mi, second=min(s, 59), microsecond=us, tzinfo=zone)
    return _us(local.astimezone(timezone.utc)) + (1_000_000 if s == 60 else 0)


def _half(hour: int, word: str | None) -> int | None:
    """The hour of the day for a clock of twelve hours."""
    if not word:
        return hour
    w = re.sub(r"[.\s]", "", word.lower())
    if w in ("noon", "midnight"):
        return None if hour != 12 else (12 if w == "noon" else 0)
    if hour > 12:
        return hour if w == "pm" else None
    if hour == 0:
        return None
    return hour % 12 + (12 if w == "pm" else 0)


def _century(text: str) -> int:
    return int(text) + (2000 if len(text) == 2 else 0)


def _find_date(text: str, order: str):
    for kind, pattern in _DATES:
        m = pattern.search(text)
        if not m:
            continue
        g = m.groups()
        if kind == "ymd":
            return m, int(g[0]), int(g[2]), int(g[3])
        if kind == "num":
            a, b = int(g[0]), int(g[2])
            mo, d = (b, a) if order == "DMY" else (a, b)
            return m, _century(g[3]), mo, d
        if kind == "java" or kind == "mdy":
            return m, int(g[2]), _MONTH[g[0].lower()], int(g[1])
        if kind == "dmy":
            return m, _century(g[2]), _MONTH[g[1].lower()], int(g[0])
        return m, int(g[0]), _MONTH[g[1].lower()], int(g[2])
    return None


def parse_instant(raw: str | None, zone_name: str | None = "UTC", order: str | None = "MDY") -> int | None:
    """Microseconds since 1970-01-01 00:00 UTC, or None if the text names no day or instant.

    A value without zone is local to `zone_name`; digits follow `order` (MDY or DMY) unless
    they begin with the year; two-digit years are 20xx; a day alone is its first moment.
    Months, quarters, seasons, open ends and impossible dates give None.
    """
    if raw is None:
        return None
    text = re.sub(r"[\s  -​  　﻿]+", " ", raw).strip()
    if len(text) < 6:
        return None
    order, zone = (order or "MDY").upper(), _zone(zone_name)
    m = _JSON_DATE.match(text)
    if m:
        return int(m[1]) * 1000
    if text.isdigit():
        if len(text) == 13:
            return int(text) * 1000
        if len(text) == 10:
            return int(text) * 1_000_000
        if len(text) == 16:
            return int(text)
        if len(text) == 8 and not text.startswith(("19", "20")):
            a, b, y = int(text[:2]), int(text[2:4]), int(text[4:])
            mo, d = (b, a) if order == "DMY" else (a, b)
            return _instant(y, mo, d, (0, 0, 0, 0), zone) if 1900 <= y < 2200 else None
    m = _COMPACT.match(text)
    if m:
        y, mo, d = int(m[1]), int(m[2]), int(m[3])
        got = _instant(y, mo, d, (int(m[4] or 0), int(m[5] or 0), int(m[6] or 0), 0), zone)
        if got is None and len(text) == 8 and text[4:6] in ("19", "20"):
            a, b = int(text[:2]), int(text[2:4])
            mo, d = (b, a) if order == "DMY" else (a, b)
            return _instant(int(text[4:]), mo, d, (0, 0, 0, 0), zone)
        return got
    m = re.match(r"^(\d{4})(\d{2})(\d{2})(T\d{2}.*)$", text)
    if m:
        text = f"{m[1]}-{m[2]}-{m[3]}{re.sub(r'^T(\d{2})(\d{2})(\d{2})?', lambda t: f'T{t[1]}:{t[2]}:{t[3] or '00'}', m[4])}"
    found = _find_date(text, order)
    if not found:
        return None
    m, y, mo, d = found
    before, rest = text[: m.start()], text[m.end() :]
    if _OTHER.search(before):
        return None
    outside = f"{before} {rest}"
    clock, hit, where = (0, 0, 0, 0), None, ""
    for side in (rest, before):
        if hit := _TIME.search(side):
            h = _half(int(hit[1]), hit[5])
            if h is None:
                return None
            clock = (h, int(hit[2]), int(hit[3] or 0), int((hit[4] or "0")[:6].ljust(6, "0")))
        elif hit := _HOUR.search(side):
            h = _half(int(hit[1]), hit[2])
            if h is None:
                return None
            clock = (h, 0, 0, 0)
        elif hit := _NOON.search(side):
            clock = (12 if hit[1].lower() == "noon" else 0, 0, 0, 0)
        if hit:
            where = side[hit.end() :]
            break
    offset = _AFTER.match(where) if hit else None
    if offset:
        sign = -1 if offset[1] == "-" else 1
        hh, mm = int(offset[2]), int(offset[3] or 0)
        if hh > 18 or mm > 59:
            return None
        zone = timezone(sign * timedelta(hours=hh, minutes=mm))
    elif z := (_ABBR_RE.search(where) or _ABBR_RE.search(outside) or re.search(r"(?<=\d)(z)\b", where if hit else rest, re.I)):
        name = z[1].lower()
        zone = timezone(timedelta(hours=FIXED_ABBR[name])) if name in FIXED_ABBR else _zone(GENERIC_ABBR[name])
    elif z := _WORD_ZONE.search(outside):
        zone = _zone(GENERIC_ABBR[GENERIC_WORDS[z[1].lower()]])
    return _instant(y, mo, d, clock, zone)


def utc_date(us: int) -> date:
    """The UTC day of an instant."""
    return (_EPOCH + timedelta(microseconds=us)).date()
