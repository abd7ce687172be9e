"""Whether captured pages are alive, and the sweep that closes what is dead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.functions.text import any_phrase
from grainmill.functions.urls import is_safe

#: Characters in which a marker counts, and the size from which a page is no soft error (fixed values).
HEAD, SMALL = 2000, 3000


def health(url: Column, status: Column, body: Column, markers: list[str]) -> Column:
    """Why a page is dead (blocked, http_error, non_html, soft_404); null if it is alive."""
    return (
        F.when(~is_safe(url), "blocked")
        .when(~F.coalesce(status.between(200, 299), F.lit(False)), "http_error")
        .when(body.isNull(), "non_html")
        .when(any_phrase(F.substring(body, 1, HEAD), markers) & (F.length(body) < SMALL), "soft_404")
    )


def first_healthy(rows: DataFrame, candidates: str, key: str, dead: DataFrame, otherwise: Column) -> DataFrame:
    """(key, url): the first candidate address of each row that is not among the dead ones, else another."""
    each = rows.select(key, F.posexplode(candidates).alias("pos", "url"))
    alive = each.join(dead.select("url").distinct(), "url", "left_anti")
    best = alive.groupBy(key).agg(F.min_by("url", "pos").alias("gm_url"))
    return rows.join(best, key, "left").select(key, F.coalesce("gm_url", otherwise).alias("url"))


def swept(rows: DataFrame, dead: Column, failed: Column, kept: Column, as_of: Column) -> DataFrame:
    """Records after a sweep, with `outcome`: error (untouched), closed, or kept with a new stamp.

    A failed check changes nothing; dead pages and records that the verdict refuses are closed.
    """
    outcome = F.when(failed, "error").when(dead.isNotNull() | ~F.coalesce(kept, F.lit(True)), "closed").otherwise("kept")
    rows = rows.withColumn("outcome", outcome)
    return rows.withColumns({"status": F.when(F.col("outcome") == "closed", "CLOSED").otherwise(F.col("status")), "last_verified": F.when(F.col("outcome") == "kept", as_of).otherwise(F.col("last_verified"))})


def sweep_counts(rows: DataFrame) -> DataFrame:
    """(checked, closed, kept, errors) of a sweep."""
    of = lambda name: F.count_if(F.col("outcome") == name)
    return rows.agg(F.count("*").alias("checked"), of("closed").alias("closed"), of("kept").alias("kept"), of("error").alias("errors"))
