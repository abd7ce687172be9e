"""Sort orders and pages of a listing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT = {"deadline": "asc", "rollingFirst": "asc", "amount": "desc", "recent": "desc", "title": "asc"}


def order_of(sort: str | None = None, direction: str | None = None, key: str = "id") -> list[Column]:
    """The columns of a named order, the key last; unknown names mean deadline, unknown directions the order's own."""
    name = sort if sort in DEFAULT else "deadline"
    down = (direction if direction in ("asc", "desc") else DEFAULT[name]) == "desc"
    last = lambda c: F.desc_nulls_last(c) if down else F.asc_nulls_last(c)
    orders = {
        "deadline": [last("deadline"), F.desc("created_at")],
        "rollingFirst": [F.asc_nulls_first("deadline"), F.desc("created_at")],
        "amount": [last("amount_max"), F.asc_nulls_last("deadline")],
        "recent": [last("created_at")],
        "title": [last("title")],
    }
    return [*orders[name], F.asc(key)]


def page_bounds(page: int | None, limit: int | None) -> tuple[int, int]:
    """(limit, offset): 1 to 100 rows a page, 20 unless asked, pages from 1."""
    size = min(100, max(1, 20 if limit is None else limit))
    return size, (max(1, page or 1) - 1) * size


def page_of(rows: DataFrame, order: list[Column], page: int | None = None, limit: int | None = None) -> DataFrame:
    """One page; planned as a top-k, so only limit + offset rows per task are kept."""
    size, skip = page_bounds(page, limit)
    return rows.orderBy(*order).offset(skip).limit(size)


def total_pages(total: int, limit: int) -> int:
    """Pages that a number of rows fills."""
    return math.ceil(total / limit)


def decision_order(key: str = "id") -> list[Column]:
    """What can still be decided on first: open, forecasted, closed, others; earliest deadline first."""
    rank = F.when(F.col("status") == "OPEN", 0).when(F.col("status") == "FORECASTED", 1).when(F.col("status") == "CLOSED", 2).otherwise(3)
    return [rank.asc(), F.asc_nulls_last("deadline"), F.asc(key)]
