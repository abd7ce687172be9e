"""A listing made of the order tables, for exercising the listing operators at any scale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.runtime import broadcast_if_few, table

#: The moment that all queries of the listing are asked at.
AS_OF = "1998-07-01 12:00:00"


def as_of() -> Column:
    """AS_OF as a column."""
    return F.expr(f"TIMESTAMP_NTZ '{AS_OF}'")


def listing(spark: SparkSession, folder: str, amounts: bool = True, industries: bool = False) -> DataFrame:
    """One row per order in the columns of a listing.

    `amounts` and `industries` say whether the line items are read at all; both are
    aggregated by order before they are joined, so the fact table is shuffled once.
    """
    orders, customer = table(spark, folder, "orders"), table(spark, folder, "customer")
    places = table(spark, folder, "nation").join(broadcast_if_few(table(spark, folder, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    who = customer.join(broadcast_if_few(places), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = orders.join(who, F.col("o_custkey") == F.col("c_custkey"))
    segment, priority = F.col("c_mktsegment"), F.col("o_orderpriority")
    of = lambda col, known, other: _case(col, known, other)
    rows = rows.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderkey").alias("seq"),
        F.concat_ws(" ", "c_name", "o_orderpriority").alias("title"),
        F.concat(segment, F.lit(" program in "), F.col("n_name"), F.lit(", "), F.col("r_name")).alias("description"),
        F.col("n_name").alias("source_name"),
        F.concat(F.lit("https://"), F.lower(segment), F.lit(".example.org/p/"), (F.col("o_orderkey") % 400).cast("string")).alias("source_url"),
        of(F.col("o_orderstatus"), {"O": "OPEN", "F": "CLOSED"}, "FORECASTED").alias("status"),
        of(priority, {"1-URGENT": "FEDERAL", "2-HIGH": "STATE", "3-MEDIUM": "LOCAL"}, "PRIVATE").alias("grant_type"),
        of(segment, {"BUILDING": "STARTUP", "MACHINERY": "EXISTING"}, "BOTH").alias("business_stage"),
        of(F.col("c_nationkey") % 5, {0: "WOMEN", 1: "VETERAN", 2: "MINORITY", 3: "GENERAL"}, "ANY").alias("gender"),
        F.when(priority != "4-NOT SPECIFIED", F.col("o_orderdate")).alias("deadline"),
        (F.col("o_orderdate") - F.expr("INTERVAL 60 DAY")).alias("created_at"),
        F.array("r_name", "n_name").alias("locations"),
    )
    if amounts or industries:
        lines = table(spark, folder, "lineitem")
        wanted = [F.floor(F.min("l_extendedprice")).cast("bigint").alias("amount_min"), F.floor(F.max("l_extendedprice")).cast("bigint").alias("amount_max")] if amounts else []
        if industries:
            lines = lines.join(table(spark, folder, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
            wanted.append(F.sort_array(F.collect_set("p_type")).alias("industries"))
        rows = rows.join(lines.groupBy(F.col("l_orderkey").alias("id")).agg(*wanted), "id", "left")
    return rows


def with_amounts(spark: SparkSession, folder: str, page: DataFrame, order: list[Column]) -> DataFrame:
    """A page of the listing with its sums; only the line items of its rows, at most a hundred, are read."""
    rows = page.collect()
    few = spark.createDataFrame(rows, page.schema)
    lines = table(spark, folder, "lineitem").where(F.col("l_orderkey").isin([r.id for r in rows]))
    sums = lines.groupBy(F.col("l_orderkey").alias("id")).agg(F.floor(F.min("l_extendedprice")).cast("bigint").alias("amount_min"), F.floor(F.max("l_extendedprice")).cast("bigint").alias("amount_max"))
    return few.join(sums, "id", "left").orderBy(*order)


def _case(column: Column, known: dict, other: str) -> Column:
    out = None
    for k, v in known.items():
        out = F.when(column == k, v) if out is None else out.when(column == k, v)
    return out.otherwise(other)


def expenses(spark: SparkSession, folder: str) -> DataFrame:
    """The bridge (id, name) of orders to the types of their parts."""
    parts = table(spark, folder, "part").select("p_partkey", F.col("p_type").alias("name"))
    lines = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("id"), "l_partkey")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select("id", "name").distinct()
