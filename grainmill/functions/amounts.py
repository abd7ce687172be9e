"""Sums in display texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A dollar sum with an optional scale that no letter follows.
SUM = r"\$\s*(\d[\d,]*(?:\.\d+)?)\s*((?:[KMBkmb]|thousand|million|billion)\b)?"
RANGE = r"\$[\d,.]+\s*(?:[KMBkmb]|thousand|million|billion)?\s*(?:-|–|—|to)\s*\$[\d,.]+"
#: Sums without a scale below this are not awards.
LEAST = 100


def sums_in(text: Column) -> Column:
    """All dollar sums of a text as whole dollars, those below LEAST without a scale left out."""
    numbers = F.regexp_extract_all(text, F.lit(SUM), F.lit(1))
    scales = F.regexp_extract_all(text, F.lit(SUM), F.lit(2))
    both = F.arrays_zip(numbers.alias("n"), scales.alias("s"))

    def one(x: Column) -> Column:
        letter = F.lower(F.substring(x["s"], 1, 1))
        by = F.when(letter == "k", 1e3).when(letter == "t", 1e3).when(letter == "m", 1e6).when(letter == "b", 1e9).otherwise(1.0)
        value = F.regexp_replace(x["n"], ",", "").try_cast("double") * by
        return F.when((x["s"] != "") | (value >= LEAST), F.floor(value).cast("bigint"))

    return F.filter(F.transform(both, one), lambda v: v.isNotNull())


def amount_bounds(text: Column) -> Column:
    """struct(low, high): the extremes of all sums if the text has a range, else the first sum for both."""
    sums = sums_in(text)
    ranged = text.rlike(RANGE) & (F.size(sums) >= 2)
    first = F.when(F.size(sums) > 0, F.element_at(sums, 1))
    return F.struct(F.when(ranged, F.array_min(sums)).otherwise(first).alias("low"), F.when(ranged, F.array_max(sums)).otherwise(first).alias("high"))


def dollars(value: Column) -> Column:
    """A whole number with a dollar sign and thousands separated."""
    return F.concat(F.lit("$"), F.format_number(value, 0))


def award_text(floor: Column, ceiling: Column, total: Column) -> Column:
    """How an interface's award reads: a range, an upper limit, or the estimated total."""
    has = lambda c: F.coalesce(c > 0, F.lit(False))
    return (
        F.when(has(floor) & has(ceiling), F.concat(dollars(floor), F.lit(" - "), dollars(ceiling)))
        .when(has(ceiling), F.concat(F.lit("Up to "), dollars(ceiling)))
        .when(has(total), F.concat(dollars(total), F.lit(" (estimated total)")))
    )


def _number(text: Column) -> Column:
    """The number that a run of digits and points begins with."""
    return F.regexp_extract(text, r"^(\d*\.?\d*)", 1).try_cast("double")


def _stated(text: Column, ranged: str, upper: str, single: str) -> tuple[Column, Column]:
    """Low and high of a range, an upper limit or a single number, in this order of precedence."""
    bare = F.regexp_replace(text, ",", "")
    took = lambda p, g=1: F.nullif(F.regexp_extract(bare, p, g), F.lit(""))
    is_range, is_upper = took(ranged).isNotNull(), took(upper).isNotNull()
    one = _number(took(single))
    low = F.when(is_range, _number(took(ranged))).when(is_upper, F.lit(None).cast("double")).otherwise(one)
    high = F.when(is_range, _number(took(ranged, 2))).when(is_upper, _number(took(upper))).otherwise(one)
    return low, high


def article_bounds(text: Column) -> Column:
    """struct(low, high) of sums in articles: every number needs its dollar sign; scales are not read."""
    low, high = _stated(text, r"(?i)\$\s*([\d.]+)\s*(?:to|-|–|—)\s*\$\s*([\d.]+)", r"(?i)up\s+to\s+\$\s*([\d.]+)", r"\$\s*([\d.]+)")
    return F.struct(low.alias("low"), high.alias("high"))


def table_bounds(text: Column) -> Column:
    """struct(low, high) of sums in free-form tables: signs may be missing; a k anywhere scales all numbers below a thousand."""
    low, high = _stated(text, r"\$?([\d.]+)\s*[kK]?\s*(?:-|–|—|to)+\s*\$?([\d.]+)", r"(?i)up\s+to\s+\$?([\d.]+)", r"\$?([\d.]+)")
    scaled = lambda v: F.when(F.contains(F.lower(text), F.lit("k")) & (v < 1000), v * 1000).otherwise(v)
    return F.struct(scaled(low).alias("low"), scaled(high).alias("high"))
