"""Mixing sources to target weights along a curriculum.

Each source has a weight schedule over the run of training, whose mean is its target share.
Its integral gives the tokens of the source demanded up to each moment; inverting that demand
at the cumulative tokens of the source's documents gives every document copy its position,
and the copies are range-sorted by it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainmill.llm.encode import VOCABULARY, token_count
from grainmill.runtime import broadcast_if_few, stage

#: Documents that one task may have to put in order.
BUCKET_ROWS = 20_000


def plan_sources(sizes: DataFrame, plan: DataFrame, tilt: float = 0.0) -> DataFrame:
    """One row per source of the plan with what it has, gives and repeats.

    Columns: source, target_share, weight (the target among sources that have tokens), slope
    (how the weight changes over the run), max_repeats, docs, available, demand, actual_share.
    The total is the largest for which every source can give its target share within its
    max_repeats, so shares miss their targets by at most a document each. A source without
    documents, or without tokens, has share 0 and the others take its weight in proportion.
    """
    known = plan.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    have = sizes.groupBy("source").agg(F.count("*").alias("docs"), F.sum("tokens").alias("available"))
    rows = known.join(have, "source", "left").fillna(0, ["docs", "available"])
    everything = Window.partitionBy()  # the plan's rows: one per source
    usable = F.when((F.col("available") > 0) & (F.col("max_repeats") > 0) & (F.col("target_share") > 0), F.col("target_share"))
    rows = rows.withColumn("weight", F.coalesce(usable / F.sum(usable).over(everything), F.lit(0.0)))
    reach = F.when(F.col("weight") > 0, F.col("available") * F.col("max_repeats") / F.col("weight"))
    rows = rows.withColumn("demand", F.coalesce(F.floor(F.col("weight") * F.min(reach).over(everything)), F.lit(0)).cast("bigint"))
    # early weights go to sources with much text, late ones to those repeated often; the slopes cancel out
    passes = F.when(F.col("weight") > 0, F.col("demand") / F.col("available"))
    mean = F.sum(passes * F.col("weight")).over(everything)
    spread = F.max(F.abs(passes - mean)).over(everything)
    return rows.withColumn("slope", F.coalesce(F.lit(tilt) * (passes - mean) / F.when(spread > 0, spread), F.lit(0.0)))


def sized(docs: DataFrame, plan: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", path: str = VOCABULARY) -> DataFrame:
    """(key, source, tokens) of the documents whose source is in the plan, staged."""
    known = broadcast_if_few(plan.select(F.col("source")).distinct())
    rows = docs.select(F.col(key), F.col(source).alias("source"), F.col(text).alias("gm_text")).join(known, "source", "left_semi")
    return stage(rows.select(key, "source", token_count(path)("gm_text").alias("tokens")), "sizes")


def mix(sizes: DataFrame, plan: DataFrame, key: str = "doc_id", tilt: float = 0.0, seed: int = 7) -> DataFrame:
    """(key, source, copy, tokens, position) of every use of a document, in training order.

    `position` lies in [0, 1). A source whose demand is k times its tokens and a rest uses
    every document k times and a hashed-order part of them once more, never more often than
    max_repeats. Documents without tokens are never used; repeated rows are documents of
    their own. tilt in [0, 1) makes the schedules vary over time; 0 keeps them level.
    No source is ordered by one task: documents fall into buckets by hash, buckets are summed
    first, and each bucket then counts on from the sum before it.
    """
    shares = plan_sources(sizes, plan, tilt).where("demand > 0")
    rows = sizes.where("tokens > 0").withColumn("gm_order", F.xxhash64(F.col(key), F.lit(seed)))
    buckets = max(1, sizes.count() // BUCKET_ROWS + 1)
    rows = rows.withColumn("gm_bucket", F.floor((F.shiftrightunsigned("gm_order", 1) / F.lit(2.0**63)) * buckets).cast("int"))
    rows = rows.withColumn("gm_order", F.shiftrightunsigned("gm_order", 1))
    sums = rows.groupBy("source", "gm_bucket").agg(F.sum("tokens").alias("gm_sum"))
    before = Window.partitionBy("source").orderBy("gm_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("gm_before", F.coalesce(F.sum("gm_sum").over(before), F.lit(0))).drop("gm_sum")
    rows = rows.join(broadcast_if_few(sums), ["source", "gm_bucket"]).join(broadcast_if_few(shares.select("source", "available", "demand", "slope")), "source")
    inside = Window.partitionBy("source", "gm_bucket").orderBy("gm_order", key).rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("gm_before") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))
    rows = rows.withColumn("gm_start", start)
    # copy c begins at c * available + start tokens of the source; it is used if that is within the demand
    copies = F.floor((F.col("demand") - F.col("gm_start") - F.col("tokens")) / F.col("available")) + 1
    rows = rows.withColumn("copy", F.explode(F.when(copies > 0, F.sequence(F.lit(0), copies.cast("int") - 1)).otherwise(F.array().cast("array<int>"))))
    done = (F.col("copy") * F.col("available") + F.col("gm_start")) / F.col("demand")
    # the share of the demand met by moment t is t * (1 - slope) + slope * t^2; this is its inverse
    a, b = F.col("slope"), 1 - F.col("slope")
    position = F.when(F.abs(a) < 1e-9, done).otherwise((F.sqrt(b * b + 4 * a * done) - b) / (2 * a))
    rows = rows.withColumn("position", position)
    return rows.select(key, "source", "copy", "tokens", F.abs("position").alias("position")).repartitionByRange("position", key, "copy").sortWithinPartitions("position", key, "copy")


def share_report(uses: DataFrame, sizes: DataFrame, plan: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per source of the plan: target and actual share, tokens, documents, uses and most repeats."""
    per_doc = uses.groupBy("source", key).agg(F.count("*").alias("n"), F.sum("tokens").alias("t"))
    used = per_doc.groupBy("source").agg(F.sum("t").alias("used_tokens"), F.sum("n").alias("uses"), F.max("n").alias("most_repeats"), F.count("*").alias("docs_used"))
    rows = plan_sources(sizes, plan).join(used, "source", "left").fillna(0, ["used_tokens", "uses", "most_repeats", "docs_used"])
    total = F.sum("used_tokens").over(Window.partitionBy())
    return rows.select("source", "target_share", (F.col("used_tokens") / F.when(total > 0, total)).alias("gm_share"), "used_tokens", "available", "docs", "docs_used", "uses", "most_repeats", "max_repeats").withColumn("actual_share", F.coalesce("gm_share", F.lit(0.0))).drop("gm_share")
