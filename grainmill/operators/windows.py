"""Order-dependent choices: first wins, top of a group, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainmill.runtime import broadcast_if_few, stage


def first_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of the smallest `order` of each key; rows with a null key are kept all.

    Done by aggregation, so each task keeps one row per key before anything is shuffled and a
    key that holds a third of all rows costs no more than others.
    """
    known = rows
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    missing = rows.where(~F.coalesce(_all_known(keys), F.lit(False)))
    struct = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    best = known.groupBy(*keys).agg(F.min_by(struct, order).alias("gm_row")).select("gm_row.*")
    return best.unionByName(missing)


def _all_known(keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).isNotNull()
    return out


def cap_per_group(rows: DataFrame, group: list[str], order: list[Column], most: int) -> DataFrame:
    """At most `most` rows of each group in the given order; planned with a limit per group before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn("gm_place", place).where(F.col("gm_place") <= most).drop("gm_place")


def nearest_of_kind(rows: DataFrame, kind: str, order: list[Column], most: int = 3, key: str = "id") -> DataFrame:
    """For every row the first `most` other rows of its kind: (key, place, other).

    The first most + 1 rows of each kind are ranked once; each row then meets only these, so
    the work grows with the rows, not with their pairs.
    """
    top = cap_per_group(rows.where(F.col("gm_candidate")), [kind], order, most + 1)
    place = F.row_number().over(Window.partitionBy(kind).orderBy(*order))
    top = top.withColumn("gm_place", place).select(F.col(kind).alias("gm_kind"), F.col(key).alias("other"), "gm_place")
    heads = top.groupBy("gm_kind").agg(F.sort_array(F.collect_list(F.struct("gm_place", "other"))).alias("gm_top"))
    met = rows.select(key, F.col(kind).alias("gm_kind")).join(broadcast_if_few(heads), "gm_kind")
    others = F.slice(F.filter("gm_top", lambda x: x["other"] != F.col(key)), 1, most)
    return met.select(key, F.posexplode(others).alias("gm_pos", "x")).select(key, (F.col("gm_pos") + 1).alias("place"), "x.other")


#: Rows per range when positions are counted over a whole table.
RANGE_ROWS = 100_000


def numbered(rows: DataFrame, order: list[Column], per: list[str], column: str = "position") -> DataFrame:
    """Add the position of each row within its group of `per`, counting from 0, in a total order.

    Ranges of the order are numbered apart and offset by the rows of the group before them, so
    a group that holds all rows is numbered by as many tasks as it has ranges.
    """
    ranges = max(1, rows.count() // RANGE_ROWS)
    parts = stage(rows.repartitionByRange(ranges, *[F.col(c) for c in per], *order).withColumn("gm_part", F.spark_partition_id()), "numbered")
    sizes = parts.groupBy("gm_part", *per).agg(F.count("*").alias("gm_n"))
    before = F.sum("gm_n").over(Window.partitionBy(*per).orderBy("gm_part")) - F.col("gm_n")  # a row per range and group
    sizes = sizes.select(*[F.col(c).alias(f"gm_{c}") for c in per], F.col("gm_part").alias("gm_p"), before.alias("gm_before"))
    place = F.row_number().over(Window.partitionBy("gm_part", *per).orderBy(*order)) - 1
    same = F.col("gm_part") == F.col("gm_p")
    for c in per:
        same = same & F.col(c).eqNullSafe(F.col(f"gm_{c}"))
    out = parts.withColumn(column, place).join(broadcast_if_few(sizes), same)
    return out.withColumn(column, (F.col(column) + F.col("gm_before")).cast("bigint")).select(*rows.columns, column)


def batches(rows: DataFrame, order: list[Column], size: int, per: list[str]) -> DataFrame:
    """Add `batch`, counting from 0 every `size` rows within each group of `per`, in a total order."""
    return numbered(rows, order, per, "gm_place").withColumn("batch", F.floor(F.col("gm_place") / size).cast("bigint")).drop("gm_place")
