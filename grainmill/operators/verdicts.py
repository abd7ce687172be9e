"""Batched questions to a model, answered from recorded replies, and what follows from the verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.operators.windows import numbered

def asked(rows: DataFrame, order: str, size: int, calls: int) -> DataFrame:
    """Rows with batch, index within the batch and `within`: whether the budget of calls reaches their batch."""
    rows = numbered(rows, [F.asc(order)], [])
    batch = F.floor(F.col("position") / size).cast("bigint")
    return rows.withColumns({"batch": batch, "index": (F.col("position") % size).cast("int"), "within": batch < calls}).drop("position")


def answered(rows: DataFrame, replies: DataFrame) -> DataFrame:
    """Rows met by their replies (batch, index, ...), by position; replies beyond a batch meet nothing, the first of several counts.

    Rows beyond the budget or without a reply drop out, as they would if the model were asked.
    """
    columns = [c for c in replies.columns if c not in ("batch", "index")]
    first = replies.groupBy("batch", "index").agg(F.min(F.struct(*columns)).alias("gm_reply"))
    return rows.where("within").join(first, ["batch", "index"]).select(*[c for c in rows.columns if c != "within"], "gm_reply.*")


def accepted(is_real: Column, eligible: Column, kind: Column, confidence: Column) -> Column:
    """Whether a verdict lets a record in (fixed values)."""
    return F.coalesce(is_real & eligible & (kind == "grant_application") & (confidence != "LOW"), F.lit(False))


def spent(rows: DataFrame, tokens: Column) -> DataFrame:
    """(calls, records, tokens) that the batches within the budget take."""
    return rows.where("within").agg(F.count_distinct("batch").alias("calls"), F.count("*").alias("records"), F.sum(tokens).alias("tokens"))


def described(original: Column, found: Column) -> Column:
    """struct(description, original): what a model wrote, with the original kept; the original alone where it wrote nothing."""
    wrote = F.coalesce(F.trim(found) != "", F.lit(False))
    return F.struct(F.when(wrote, F.trim(found)).otherwise(original).alias("description"), F.when(wrote, original).alias("original"))
