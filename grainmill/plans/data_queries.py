"""Queries of the general data problems (2 and 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.operators.instants import DATED, InstantDictionary, dated_records, normalise_instants
from grainmill.operators.units import unit_solutions, wrong_bounds
from grainmill.runtime import table


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every deadline of the four tables that denotes a day or an instant, in UTC."""
    tables = {name: table(spark, folder, name) for name, *_ in DATED}
    rows = dated_records(tables, table(spark, folder, "source_registry"))
    return normalise_instants(rows, InstantDictionary.shared(spark)).select("record_table", "record_id", "utc_us")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Bounds of awards whose stored number isn't the stated one in whole US dollars."""
    return wrong_bounds(table(spark, folder, "grants")).select("grant_id", "bound", "usd")


def p2_solutions(spark: SparkSession, folder: str) -> DataFrame:
    """Every stated bound in dollars, with the scale of the stored number and its uniqueness."""
    rows = unit_solutions(table(spark, folder, "grants").select("grant_id", "amount", "amount_min", "amount_max", "raw_data"))
    part = lambda b: F.struct(F.lit(b).alias("bound"), F.col(f"gm_{b}.usd").alias("usd"), F.col(f"gm_{b}.stored_scale").alias("stored_scale"), F.col(f"gm_{b}.residual").alias("residual"), F.col(f"gm_{b}.unique").alias("is_unique"))
    return rows.select("grant_id", F.explode(F.array(part("min"), part("max"))).alias("x")).where("x.usd is not null").select("grant_id", "x.*")


def queries() -> dict:
    """Name -> callable of this module's queries."""
    return {f.__name__: f for f in (p2_found, p2_solutions, p7_found)}
