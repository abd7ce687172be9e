"""Connected components of rows that share a value in either of two columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.operators.skew import join_dictionary
from grainmill.runtime import stage


def components(links: DataFrame, key: str, left: str, right: str, most_rounds: int = 60) -> DataFrame:
    """(key, label): for each row the smallest key of its component, rows with an equal left or right value being linked.

    Null values link nothing. Labels fall to the least of both sides and are then followed to
    their own labels, so the rounds grow as the logarithm of the longest chain. Every round is
    written to the shared folder; no side is gathered, and hot values are looked up by broadcast.
    Components that `most_rounds` don't finish are an error.
    """
    own = lambda c: F.coalesce(F.col(c), F.concat(F.lit("\u0000"), F.col(key)))
    rows = stage(links.select(F.col(key).alias("k"), own(left).alias("a"), own(right).alias("b"), F.col(key).alias("label")), "links")
    for _ in range(most_rounds):
        now = rows
        for side in ("a", "b"):
            least = stage(rows.groupBy(side).agg(F.min("label").alias(f"low_{side}"), F.count("*").alias("n")), "least")
            now = join_dictionary(now, least, [side], "n")
        rows = stage(now.select("k", "a", "b", F.col("label").alias("was"), F.least("label", "low_a", "low_b").alias("label")), "labels")
        if rows.where("label <> was").limit(1).count() == 0:
            return rows.select(F.col("k").alias(key), "label")
        wanted = rows.groupBy("label").agg(F.count("*").alias("n"))
        follow = stage(wanted.join(rows.select(F.col("k").alias("label"), F.col("label").alias("next")), "label"), "follow")
        rows = stage(join_dictionary(rows.drop("was"), follow, ["label"], "n").select("k", "a", "b", F.least("label", "next").alias("label")), "followed")
    raise RuntimeError(f"components are unfinished after {most_rounds} rounds")
