"""Facets, calendars and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def facet(rows: DataFrame, column: str) -> DataFrame:
    """(value): the distinct entries of an array column, blanks left out; sorted."""
    entries = rows.select(F.explode(column).alias("value")).where("value is not null and value <> ''")
    return entries.distinct().orderBy("value")


def calendar_month(rows: DataFrame, year: int, month: int) -> DataFrame:
    """Open rows with a deadline in the month, both ends included to the second."""
    start = F.make_timestamp_ntz(*[F.lit(x) for x in (year, month, 1, 0, 0, 0)])
    end = F.make_timestamp_ntz(*[F.lit(x) for x in (year + month // 12, month % 12 + 1, 1, 0, 0, 0)]) - F.expr("INTERVAL 1 SECOND")
    return rows.where((F.col("status") == "OPEN") & F.col("deadline").between(start, end))


def by_day(rows: DataFrame, key: str = "id") -> DataFrame:
    """(day, n, ids): the rows of each day, in the order of deadline and key."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct("deadline", key))), lambda x: x[key].cast("string"))
    return rows.groupBy(F.to_date("deadline").alias("day")).agg(F.count("*").alias("n"), F.array_join(listed, ",").alias("ids"))


def summary(rows: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """(measure, value, n): the total, the counts by status and type, and how many close soon, in one pass."""
    soon = (F.col("status") == "OPEN") & F.col("deadline").between(as_of, as_of + F.expr(f"INTERVAL {days} DAY"))
    measures = F.array(
        F.struct(F.lit("total").alias("measure"), F.lit("all").alias("value")),
        F.struct(F.lit("status").alias("measure"), F.col("status").alias("value")),
        F.struct(F.lit("type").alias("measure"), F.col("grant_type").alias("value")),
        F.struct(F.lit("closing soon").alias("measure"), F.when(soon, "yes").otherwise("no").alias("value")),
    )
    return rows.select(F.explode(measures).alias("m")).groupBy("m.measure", "m.value").agg(F.count("*").alias("n"))


def source_log(parts: dict[str, DataFrame | None], key: str = "id") -> DataFrame:
    """(source, status, found): one row per source; a source without table is an error and gives no rows."""
    out = None
    for name, rows in parts.items():
        if rows is None:
            continue
        one = rows.agg(F.count(key).alias("found")).select(F.lit(name).alias("source"), F.lit("success").alias("status"), "found")
        out = one if out is None else out.unionByName(one)
    spark = next(r for r in parts.values() if r is not None).sparkSession
    failed = [(n, "error", 0) for n, r in parts.items() if r is None]
    return out.unionByName(spark.createDataFrame(failed, "source string, status string, found bigint")) if failed else out
