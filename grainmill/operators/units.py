"""The same sum recorded in different units -> whole US dollars.

The columns that speak of one bound are tied by identities: number in the text x its unit =
number in the award x its unit = stored number x its scale. Every combination of candidate
units is tried for every record and the one with the least weighted sum of log residuals is
taken. A unit that is named is an observation of that number's unit, with the largest weight, so
the others follow from it; a number without one takes what makes the identities hold, then the
unit that the raw record names, then dollars. Where combinations differ in dollars but not in
the residuals of the identities, the record is flagged.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from grainmill.functions.money import parse_sum, unit_named

#: Dollars per unit that a number may be in.
CANDIDATES = (1.0, 0.01, 1e3, 1e6, 1e9)
#: Factors that turn a stored bound into its dollars: as it is, cents, thousands, millions.
STORED = (1.0, 0.01, 1e3, 1e6)
#: Residuals within this of each other count as equal.
EQUAL = 1e-6


class Weights(NamedTuple):
    """What a log residual of one costs.

    The first three belong to the identities; the others are defaults of the data, which decide
    among combinations that the identities leave open.
    """

    named: float = 8.0  # a number against the unit named for it
    agree: float = 4.0  # text against award
    stored: float = 0.05  # dollars against the stored number, whose own scale is often wrong
    shared: float = 2.0  # an unnamed unit against the one that the raw record names
    dollars: float = 1.0  # a unit named nowhere against dollars
    scaled: float = 0.005  # a stored number that needs a factor


WEIGHTS = Weights()

_SUM = StructType([StructField(c, DoubleType()) for c in ("low", "high", "low_unit", "high_unit")])


@F.pandas_udf(_SUM)
def text_sum(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """parse_sum over a column of amounts as written."""
    for s in texts:
        got = [parse_sum(x) for x in s]
        yield pd.DataFrame(got, columns=["low", "high", "low_unit", "high_unit"], dtype="float64")


@F.pandas_udf(DoubleType())
def dollars_per_unit(names: pd.Series) -> pd.Series:
    """unit_named over a column of units."""
    return names.map(unit_named).astype("float64")


_SOLUTION = StructType([StructField("usd", LongType()), StructField("stored_scale", DoubleType()), StructField("residual", DoubleType()), StructField("unique", BooleanType())])


def _log(x: np.ndarray) -> np.ndarray:
    """Logarithms; nan for what is missing, zero or negative."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(x > 0, np.log(x), np.nan)


def solve(text: np.ndarray, text_unit: np.ndarray, award: np.ndarray, award_unit: np.ndarray, stored: np.ndarray, w: Weights = WEIGHTS) -> pd.DataFrame:
    """(usd, stored_scale, residual, unique) of each record for one bound; nan where nothing is known.

    All combinations of the candidates for the text's unit, the award's unit and the scale of
    the stored number are laid out as axes 1, 2 and 3, and the least cost is taken; of equal
    costs the smaller sum of dollars.
    """
    n, has_text, has_award = len(text), text > 0, award > 0

    def units(named: np.ndarray) -> np.ndarray:
        return np.concatenate([np.tile(CANDIDATES, (n, 1)), np.where(named > 0, named, 1.0)[:, None]], axis=1)

    axis = lambda v, *at: v.reshape([n, *[v.shape[1] if a else 1 for a in at]])
    gap = lambda d: np.nan_to_num(np.abs(d))
    x, y = axis(units(text_unit), 1, 0), axis(units(award_unit), 0, 1)
    lx, ly, one = np.log(x), np.log(y), lambda v: v[:, None, None]
    # an absent number has no unit to choose: only its first candidate counts
    barred = (~one(has_text) & (np.arange(x.shape[1]) > 0)[None, :, None]) | (~one(has_award) & (np.arange(y.shape[2]) > 0)[None, None, :])
    lt, la, nt, na = (one(_log(v)) for v in (text, award, text_unit, award_unit))
    usd = np.where(one(has_text), one(text) * x, one(award) * y)
    off = gap(_log(usd)[..., None] - _log(stored)[:, None, None, None] - np.log(STORED))
    pay = w.stored * off + w.scaled * np.abs(np.log(STORED)) * (stored > 0)[:, None, None, None]
    fit = pay.argmin(axis=3)
    at_fit = lambda v: np.take_along_axis(v, fit[..., None], axis=3)[..., 0]
    residual = w.named * (gap(lx - nt) * one(has_text) + gap(ly - na) * one(has_award)) + w.agree * gap(lt + lx - la - ly) + w.stored * at_fit(off)
    nowhere = np.isnan(nt) & np.isnan(na)
    shared = gap(lx - na) * (one(has_text) & np.isnan(nt))
    default = nowhere * (np.abs(lx) * one(has_text) + np.abs(ly) * one(has_award))
    cost = residual + at_fit(pay) - w.stored * at_fit(off) + w.shared * shared + w.dollars * default
    cost, residual = np.where(barred, np.inf, cost).reshape(n, -1), np.where(barred, np.inf, residual).reshape(n, -1)
    usd, fit = usd.reshape(n, -1), fit.reshape(n, -1)
    low = cost.min(axis=1, keepdims=True)
    best = np.where(cost <= low + EQUAL, usd, np.inf).argmin(axis=1)[:, None]
    pick = lambda v: np.take_along_axis(v, best, axis=1)
    rival = ((residual <= pick(residual) + EQUAL) & (np.abs(usd - pick(usd)) > 0.5)).any(axis=1)
    known = has_text | has_award
    scale = np.where(known & (stored > 0), np.array(STORED)[pick(fit)[:, 0]], np.nan)
    said = np.where(known, np.floor(pick(usd)[:, 0] + 0.5), np.nan)
    return pd.DataFrame({"usd": pd.array(pd.Series(said), dtype="Int64"), "stored_scale": scale, "residual": np.where(known, pick(residual)[:, 0], np.nan), "unique": pd.array(np.where(known, ~rival, None), dtype="boolean")})


def _solver(w: Weights):
    @F.pandas_udf(_SOLUTION)
    def run(text: pd.Series, text_unit: pd.Series, award: pd.Series, award_unit: pd.Series, stored: pd.Series) -> pd.DataFrame:
        return solve(*[s.to_numpy(dtype="float64", na_value=np.nan) for s in (text, text_unit, award, award_unit, stored)], w)

    return run


def unit_solutions(rows: DataFrame, amount: str = "amount", raw: str = "raw_data", low: str = "amount_min", high: str = "amount_max", weights: Weights = WEIGHTS) -> DataFrame:
    """Add gm_min and gm_max, each struct(usd, stored_scale, residual, unique).

    usd is the bound in whole dollars (half up) where the record states it, else null;
    stored_scale what the stored number must be multiplied by; residual the weighted sum of
    log residuals of the identities; unique whether no combination with other dollars fits
    them as well. The text counts before the award; malformed raw data counts as none, and zero or
    negative numbers as not stated. All other columns pass through.
    """
    names = ["gm_text", "gm_award", "gm_unit"]
    spec = "award struct<floor: double, ceiling: double, unit: string>"
    award = F.when(F.col(raw).contains('"award"'), F.from_json(raw, spec)["award"])
    rows = rows.withColumns({"gm_text": text_sum(F.col(amount)), "gm_award": award})
    rows = rows.withColumn("gm_unit", dollars_per_unit(F.col("gm_award.unit")))
    positive = lambda c: F.when(F.col(c) > 0, F.col(c))
    has_text = F.coalesce(positive("gm_text.low"), positive("gm_text.high")).isNotNull()
    run, solved = _solver(weights), {}
    for out, side, other, stored in (("gm_min", "low", "floor", low), ("gm_max", "high", "ceiling", high)):
        number = positive(f"gm_text.{side}")
        # a text that bounds only one side keeps the award from speaking for the other
        said = F.when(number.isNotNull() | ~has_text, positive(f"gm_award.{other}"))
        got = run(number, F.col(f"gm_text.{side}_unit"), said, F.col("gm_unit"), F.col(stored).cast("double"))
        solved[out] = F.when(number.isNotNull() | said.isNotNull(), got)
    return rows.withColumns(solved).drop(*names)


def wrong_bounds(rows: DataFrame, key: str = "grant_id", low: str = "amount_min", high: str = "amount_max") -> DataFrame:
    """(key, bound, usd) of every stated bound whose stored number is null or not those dollars."""
    rows = unit_solutions(rows.select(key, "amount", low, high, "raw_data"), low=low, high=high)
    pair = lambda name, out, stored: F.struct(F.lit(name).alias("bound"), F.col(f"{out}.usd").alias("usd"), F.col(stored).cast("bigint").alias("stored"))
    both = rows.select(key, F.explode(F.array(pair("min", "gm_min", low), pair("max", "gm_max", high))).alias("b"))
    return both.where(F.col("b.usd").isNotNull() & ~F.col("b.usd").eqNullSafe(F.col("b.stored"))).select(key, "b.bound", "b.usd")
