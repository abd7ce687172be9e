"""Joins against a dictionary of distinct values whose hot entries are known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.runtime import few


def join_dictionary(rows: DataFrame, entries: DataFrame, keys: list[str], count: str, hot_share: int = 2000) -> DataFrame:
    """Inner join of rows with a dictionary that has one entry per distinct key.

    `count` holds how many rows carry each key. An entry is hot when it covers more than
    1 / hot_share of the rows; there are at most hot_share such entries, whatever the data,
    so they are broadcast and a key that holds a third of all rows is never sent to one
    task. The others meet in a shuffled join. Keys must not be null.
    A dictionary of at most hot_share entries is broadcast whole.
    """
    entries_only = entries.drop(count)
    if few(entries, hot_share):
        return rows.join(F.broadcast(entries_only), keys)
    total = entries.agg(F.sum(count)).first()[0] or 0
    hot = entries.where(F.col(count) * hot_share > F.lit(total)).drop(count)
    cold = entries.where(F.col(count) * hot_share <= F.lit(total)).drop(count)
    near = rows.join(F.broadcast(hot), keys)
    far = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    return near.unionByName(far)
