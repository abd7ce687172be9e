"""Sums of money as written: numbers, units named in the text and the kind of bound."""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

#: Scale words and unit notations (fixed values).
SCALES = {"k": 1e3, "thousand": 1e3, "thousands": 1e3, "m": 1e6, "mm": 1e6, "mn": 1e6, "mil": 1e6, "million": 1e6, "millions": 1e6, "b": 1e9, "bn": 1e9, "billion": 1e9, "billions": 1e9}
_WORDS = {
    "a": 1, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14,
    "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90,
}
_W = "|".join(sorted(_WORDS, key=len, reverse=True))
_WORD_NUMBER = re.compile(rf"\b(?:(half|quarter|a half|a quarter|three quarters)(?:\s+(?:of\s+)?an?)?|((?:{_W}|hundred)(?:[\s-]+(?:and\s+)?(?:{_W}|hundred))*))\s+(thousand|million|billion|hundred)\b", re.I)
_PARTS = {"half": 0.5, "a half": 0.5, "quarter": 0.25, "a quarter": 0.25, "three quarters": 0.75}

_NOISE = tuple(
    re.compile(p, re.I)
    for p in (
        r"\d+(?:\.\d+)?\s*(?:%|percent\b)[^,;()]*",
        r"\b(?:over|for|within|in|across)\s+(?:up to\s+)?\d+\s*(?:-\s*)?(?:months?|years?|quarters?|weeks?|days?)\b",
        r"\b\d+\s+(?:awards?|grants?|projects?|firms?)\s+(?:are\s+)?(?:expected|planned|anticipated)\b",
        r"\b\d+\s+(?:awards?|grants?)\s+of\b(?:\s+up\s+to\b)?",
        r"\b(?:in|for|by|since|until|fy|fiscal year)\s*(?:19|20)\d{2}\b",
        r"\b(?:\(\s*)?(?:19|20)\d{2}\s*(?:-|/)\s*(?:19|20)?\d{2}\b(?!\d)(?=\s*(?:round|cycle|season))",
    )
)
_OVERALL = (
    (1e3, re.compile(r"\(\s*(?:in\s+)?\$?\s*(?:,?000s?|thousands?)\s*\)|\$\s?000s?\b|\bk\s?\$|\(?\bin\s+thousands?(?:\s+of\s+(?:us\s+)?dollars)?\)?|\$\s*thousands?\s*:|\bfigures in thousands\b|\b[x×]\s*\$?\s*1,?000\b|×\s*\$?\s*1,?000\b|\busd\s*(?:_|\s)?(?:k|thousands?)\s*:", re.I)),
    (1e6, re.compile(r"\(\s*(?:in\s+)?\$?\s*(?:,?000,?000s?|millions?)\s*\)|\bm\s?\$|\(?\bin\s+millions?(?:\s+of\s+(?:us\s+)?dollars)?\)?|\$\s*millions?\s*:|\bfigures in millions\b|\b[x×]\s*\$?\s*1,?000,?000\b", re.I)),
    (0.01, re.compile(r"\(?\bin\s+(?:us\s+)?cents\)?|\b(?:us\s+)?cents\b|¢", re.I)),
)
_NUMBER = re.compile(r"(us\s?\$|usd|\$)?\s*(?<![\d.])(\d{1,3}(?:[, ]\d{3})+(?!\d)(?:\.\d+)?|\d+(?:\.\d+)?)\s*(?:(thousands?|millions?|billions?|mil|mm|mn|bn|k|m|b)(?![a-z]))?\s*((?:in\s+)?(?:us\s?\$|usd|us\s+dollars?|dollars?|bucks)(?![a-z\d]))?", re.I)
_UPPER = re.compile(r"\b(?:up to|as much as|max(?:imum)?|not (?:to )?exceed(?:ing)?|no more than|at most|under|ceiling|capped at|limit(?:ed)? (?:of|to))\b", re.I)
_LOWER = re.compile(r"\b(?:at least|min(?:imum)?|from|starting (?:at|from)|no less than|not less than|floor|or more|upwards of)\b", re.I)
_BETWEEN = re.compile(r"^\W*(?:-|–|—|to|and|through|until)?\W*$", re.I)


class Sum(NamedTuple):
    """A single award as written: numbers before any unit, their units, and what they bound."""

    low: float | None
    high: float | None
    low_unit: float | None  # None: the text names no unit
    high_unit: float | None


NOTHING = Sum(None, None, None, None)


def _words_to_digits(text: str) -> str:
    def swap(m: re.Match) -> str:
        scale = {"thousand": 1e3, "million": 1e6, "billion": 1e9, "hundred": 1e2}[m[3].lower()]
        if m[1]:
            value = _PARTS[m[1].lower()]
        else:
            value, last = 0, 0
            for w in re.split(r"[\s-]+", m[2].lower()):
                if w == "hundred":
                    value, last = (value - last) + max(last, 1) * 100, 0
                elif w in _WORDS:
                    last = _WORDS[w]
                    value += last
        return f"{value * scale:.0f}"

    return _WORD_NUMBER.sub(swap, text)


@lru_cache(maxsize=50_000)
def parse_sum(raw: str | None) -> Sum:
    """The single award that a text states.

    A range bounds both sides, a single sum is both bounds, an upper limit only the high,
    a lower limit only the low one. A scale word after the second number of a range with
    one currency sign or none holds for both. Counts of awards, shares, durations and years
    are no sums. Texts that state no sum, or several, give NOTHING.
    """
    if not raw:
        return NOTHING
    text = re.sub(r"[\s    ]+", " ", raw).strip()
    overall = None
    for scale, pattern in _OVERALL:
        if pattern.search(text):
            overall, text = scale, pattern.sub(" ", text)
            break
    for pattern in _NOISE:
        text = pattern.sub(" ", text)
    worded = _words_to_digits(text)
    hits = list(_NUMBER.finditer(worded))
    if not hits or len(hits) > 2:
        return NOTHING
    signs = sum(bool(m[1]) + bool(m[4]) for m in hits)
    value = [float(re.sub(r"[, ]", "", m[2])) for m in hits]
    scale = [SCALES[m[3].lower()] if m[3] else None for m in hits]
    named = bool(signs) or overall is not None or any(scale) or worded != text
    if len(hits) == 2:
        if not _BETWEEN.match(worded[hits[0].end() : hits[1].start()]):
            return NOTHING
        if scale[1] and not scale[0] and signs <= 1:
            scale[0] = scale[1]
        units = [(s or overall or 1.0) if named else None for s in scale]
        return Sum(value[0], value[1], units[0], units[1])
    unit = (scale[0] or overall or 1.0) if named else None
    around = worded[: hits[0].start()] + " " + worded[hits[0].end() :]
    if _UPPER.search(around):
        return Sum(None, value[0], None, unit)
    if _LOWER.search(around):
        return Sum(value[0], None, unit, None)
    return Sum(value[0], value[0], unit, unit)


def unit_named(text: str | None) -> float | None:
    """Dollars per unit of a unit written on its own ("thousand USD", "$000s", "US cents")."""
    if not text or not text.strip():
        return None
    t = text.strip().lower()
    if re.search(r"cent|¢", t):
        return 0.01
    if re.search(r"billion|\bbn\b|_b\b", t):
        return 1e9
    if re.search(r"million|\bmm?\b|_mm?\b|000,?000", t):
        return 1e6
    if re.search(r"thousand|000|\bk\b|_k\b|k\$|\$k|usdk|kusd", t):
        return 1e3
    if re.search(r"dollar|usd|\$|buck", t):
        return 1.0
    return None
