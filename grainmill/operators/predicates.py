"""Faceted filters of a listing as one declarative predicate."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values that the enumerated columns may hold (fixed values).
ENUMS = {
    "grant_type": ("FEDERAL", "STATE", "LOCAL", "PRIVATE"),
    "gender": ("WOMEN", "VETERAN", "MINORITY", "GENERAL", "ANY"),
    "business_stage": ("STARTUP", "EXISTING", "BOTH"),
    "status": ("OPEN", "CLOSED", "FORECASTED"),
}


def multi(text: str | None, allowed: Iterable[str]) -> list[str]:
    """The allowed values of a comma-separated parameter; none left means no filter."""
    allowed = set(allowed)
    return [v for part in (text or "").split(",") if (v := part.strip()) in allowed]


def whole_number(text: str | None) -> int | None:
    """The integer that a parameter begins with; None if it begins with none."""
    digits, text = "", (text or "").strip()
    for i, c in enumerate(text):
        if c.isdigit() or (i == 0 and c in "+-"):
            digits += c
        else:
            break
    return int(digits) if digits.strip("+-") else None


@dataclass(frozen=True)
class ListingQuery:
    """What a caller asks of the listing."""

    search: str | None = None
    grant_type: list[str] = field(default_factory=list)
    gender: list[str] = field(default_factory=list)
    business_stage: list[str] = field(default_factory=list)
    status: list[str] = field(default_factory=list)
    expenses: list[str] = field(default_factory=list)
    location: str | None = None
    industry: str | None = None
    amount_min: int | None = None
    amount_max: int | None = None

    @staticmethod
    def parse(params: dict[str, str]) -> ListingQuery:
        """From request parameters; unknown enumerated values drop out."""
        return ListingQuery(
            search=params.get("search") or None,
            **{c: multi(params.get(c), ENUMS[c]) for c in ("grant_type", "gender", "business_stage", "status")},
            expenses=[v for x in (params.get("expenses") or "").split(",") if (v := x.strip())],
            location=params.get("location") or None,
            industry=params.get("industry") or None,
            amount_min=whole_number(params.get("amount_min")),
            amount_max=whole_number(params.get("amount_max")),
        )


def contains_text(needle: str, *columns: str) -> Column:
    """Case-insensitive literal substring of any of the columns."""
    return reduce(or_, (F.contains(F.lower(F.col(c)), F.lit(needle.lower())) for c in columns))


def status_is(statuses: Iterable[str], as_of: Column) -> Column:
    """Status as asked: OPEN has not passed its deadline, CLOSED includes what has, FORECASTED is as stored."""
    passed = F.coalesce(F.col("deadline") < as_of, F.lit(False))
    one = {
        "OPEN": (F.col("status") == "OPEN") & ~passed,
        "CLOSED": (F.col("status") == "CLOSED") | ((F.col("status") == "OPEN") & passed),
        "FORECASTED": F.col("status") == "FORECASTED",
    }
    return reduce(or_, (one[s] for s in statuses))


def has_entry(column: str, value: str) -> Column:
    """Whether an array holds a value exactly; false for null arrays and arrays that hold nulls only."""
    return F.coalesce(F.array_contains(F.col(column), value), F.lit(False))


def predicate(query: ListingQuery, as_of: Column) -> Column:
    """All filters but the relation to expenses, joined by AND; nothing asked is true."""
    parts: list[Column] = []
    if query.search:
        parts.append(contains_text(query.search, "title", "description"))
    for c in ("grant_type", "gender", "business_stage"):
        if values := getattr(query, c):
            parts.append(F.col(c).isin(values))
    if query.status:
        parts.append(status_is(query.status, as_of))
    if query.location:
        parts.append(has_entry("locations", query.location))
    if query.industry:
        parts.append(has_entry("industries", query.industry))
    if query.amount_min is not None:
        parts.append(F.col("amount_max") >= query.amount_min)
    if query.amount_max is not None:
        parts.append(F.col("amount_min") <= query.amount_max)
    return reduce(and_, parts, F.lit(True))


def listed(rows: DataFrame, query: ListingQuery, as_of: Column, expenses: DataFrame | None = None) -> DataFrame:
    """The rows that a query asks for; `expenses` is the bridge (id, name), used as a semi join."""
    out = rows.where(predicate(query, as_of))
    if query.expenses and expenses is not None:
        out = out.join(expenses.where(F.col("name").isin(query.expenses)).select("id"), "id", "left_semi")
    return out


def display_status(as_of: Column) -> Column:
    """CLOSED once the deadline has passed, whatever is stored."""
    return F.when(F.col("deadline") < as_of, "CLOSED").otherwise(F.col("status"))
