"""Listings as CSV, JSON and plain text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.functions.text import csv_field, elided

#: Columns of an exported row, in order; arrays are joined.
COLUMNS = ("title", "description", "source_name", "source_url", "amount_min", "amount_max", "deadline", "grant_type", "status", "gender", "locations", "industries")


def flat(rows: DataFrame, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """The columns as text: arrays joined by "; ", moments as ISO days."""

    def one(c: str) -> Column:
        kind = rows.schema[c].dataType.typeName()
        if kind == "array":
            return F.array_join(c, "; ").alias(c)
        if kind.startswith("timestamp"):
            return F.date_format(c, "yyyy-MM-dd").alias(c)
        return F.col(c).cast("string").alias(c)

    return rows.select("id", *[one(c) for c in columns])


def csv_lines(rows: DataFrame, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """(id, line): each row as one CSV record."""
    return flat(rows, columns).select("id", F.concat_ws(",", *[csv_field(F.col(c)) for c in columns]).alias("line"))


def write_csv(rows: DataFrame, path: str, columns: tuple[str, ...] = COLUMNS) -> None:
    """A folder of CSV files with headers and CRLF line ends."""
    flat(rows, columns).select(*columns).write.mode("overwrite").option("header", True).option("lineSep", "\r\n").option("escape", '"').csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    """A folder of JSON lines."""
    rows.write.mode("overwrite").json(path)


def text_entries(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
    """(place, entry): the first rows in an order as numbered entries of plain text."""
    from pyspark.sql import Window

    top = rows.orderBy(*order).limit(most)
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order))
    body = F.concat_ws("\n", F.concat(F.col("place").cast("string"), F.lit(". "), F.col("title")), F.concat(F.lit("   "), elided(F.col("description"))), F.concat(F.lit("   "), F.col("source_url")))
    return top.withColumn("place", place).select("place", body.alias("entry"))


def options(rows: DataFrame, column: str, asked: str, most: int = 50) -> DataFrame:
    """The first values, in order, that hold what was asked, whatever its case and outer spaces; all for nothing asked."""
    wanted = asked.strip().lower()
    return rows.where(F.contains(F.lower(column), F.lit(wanted))).select(column).distinct().orderBy(column).limit(most)
