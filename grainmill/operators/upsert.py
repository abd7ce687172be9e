"""Merging a batch into a snapshot, duplicates, removals and retention."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.functions.text import normal_title
from grainmill.operators.components import components
from grainmill.runtime import stage

#: Columns whose stored value stays when the batch has none.
KEPT = ("amount_min", "amount_max", "deadline")
#: Columns that the batch always overwrites.
OVERWRITTEN = ("title", "description", "status", "grant_type", "business_stage", "gender")


def fold_batch(batch: DataFrame, key: str, order: str, kept: tuple[str, ...] = KEPT, overwritten: tuple[str, ...] = OVERWRITTEN, created: tuple[str, ...] = ()) -> DataFrame:
    """One row per key of a batch, as if its rows had been applied in order.

    Columns in `kept` take the last value that is not null, `overwritten` the last, `created`
    the first. All are aggregates, combined before the shuffle.
    """
    last = lambda c: F.max_by(c, order).alias(c)
    known = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c)
    first = lambda c: F.min_by(c, order).alias(c)
    return batch.groupBy(key).agg(*[last(c) for c in overwritten], *[known(c) for c in kept], *[first(c) for c in created], F.min(order).alias(order), F.count("*").alias("gm_rows"))


#: Letters, digits and single spaces that a title must have more than, to stand for its record (fixed value).
SHORT_TITLE = 10


def title_match(title: Column) -> Column:
    """What titles are compared by: equal but for case; null for titles too short to tell records apart."""
    return F.when(F.length(normal_title(title)) > SHORT_TITLE, F.lower(title))


def decided(snapshot: DataFrame, batch: DataFrame, key: str = "source_url", order: str = "seq", title: str = "title") -> DataFrame:
    """(order, action): what each row of a batch does when the rows are applied one after another.

    A row whose key is stored by then updates it, title included. Any other whose title a
    stored record has by then (equal but for case, see title_match) is skipped; the rest
    create. Only rows that share a key or a title with others, over any number of steps, can
    influence each other, so each such component is walked on its own, with keys and titles
    as hashes; one component is walked by one task. Rows with a null key create.
    """
    kind = batch.schema[order].dataType.simpleString()
    mine = batch.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), title_match(F.col(title)).alias("t"), F.col(order).cast("string").alias("row"), F.lit(1).alias("turn"), F.col(order).alias("gm_order"))
    mine = stage(mine, "batch-keys")
    stored = snapshot.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), title_match(F.col(title)).alias("t"))
    near = stored.join(mine.select("k").distinct(), "k", "left_semi").unionByName(stored.join(mine.select("t").where("t is not null").distinct(), "t", "left_semi").select("k", "t")).distinct()
    rows = mine.unionByName(near.select("k", "t", F.concat(F.lit("\u0001"), "k").alias("row"), F.lit(0).alias("turn"), F.lit(None).cast(kind).alias("gm_order")))
    # rows of one key and title are one node
    nodes = rows.groupBy("k", "t").agg(F.min("row").alias("node"))
    nodes = stage(nodes, "merge-nodes")
    labels = components(nodes, "node", "k", "t")
    known = nodes.join(labels, "node").select("k", F.coalesce("t", F.lit("\u0001")).alias("gm_t"), "label")
    rows = rows.withColumn("gm_t", F.coalesce("t", F.lit("\u0001"))).join(known, ["k", "gm_t"])

    def walk(g: pd.DataFrame) -> pd.DataFrame:
        has, holders, orders, actions = {}, Counter(), [], []
        for turn, o, k, t in g.sort_values(["turn", "gm_order"])[["turn", "gm_order", "k", "t"]].itertuples(index=False, name=None):
            t = None if pd.isna(t) else t
            action = "updated" if k in has else "skipped" if turn and t is not None and holders[t] > 0 else "created"
            if action != "skipped":
                if k in has:
                    holders[has[k]] -= 1
                has[k] = t
                holders[t] += 1
            if turn:
                orders.append(o)
                actions.append(action)
        return pd.DataFrame({"gm_order": orders, "action": actions})

    keyed = rows.select("label", "turn", "gm_order", F.xxhash64("k").alias("k"), F.when(F.col("t").isNotNull(), F.xxhash64("t").cast("string")).alias("t"))
    done = keyed.groupBy("label").applyInPandas(walk, f"gm_order {kind}, action string").withColumnRenamed("gm_order", order)
    return done.unionByName(batch.where(F.col(key).isNull()).select(order, F.lit("created").alias("action")))


def merge_snapshot(snapshot: DataFrame, batch: DataFrame, key: str = "source_url", order: str = "seq", title: str = "title", kept: tuple[str, ...] = KEPT, overwritten: tuple[str, ...] = OVERWRITTEN, created: tuple[str, ...] = ("id", "source_name")) -> DataFrame:
    """The snapshot after a batch, with `action`: kept, updated or created.

    What each row does is decided in order (see decided); the rows that aren't skipped are
    folded per key and laid over the snapshot in one join.
    """
    actions = stage(decided(snapshot.select(key, title), batch.select(key, order, title), key, order, title), "actions")
    folded = fold_batch(batch.join(actions.where("action <> 'skipped'"), order, "left_semi"), key, order, kept, overwritten, created)
    stored = snapshot.select(key, *created, *overwritten, *kept)
    old = lambda c: F.col(f"old.{c}")
    new = lambda c: F.col(f"new.{c}")
    both = stored.alias("old").join(folded.alias("new"), F.col(f"old.{key}") == F.col(f"new.{key}"), "full_outer")
    action = F.when(new(key).isNull(), "kept").when(old(key).isNull(), "created").otherwise("updated")
    return both.select(
        F.coalesce(old(key), new(key)).alias(key),
        *[F.coalesce(old(c), new(c)).alias(c) for c in created],
        *[F.when(new(key).isNull(), old(c)).otherwise(new(c)).alias(c) for c in overwritten],
        *[F.coalesce(new(c), old(c)).alias(c) for c in kept],
        new(order).alias(order),
        action.alias("action"),
    )


def bulk_insert(existing: DataFrame, batch: DataFrame, key: str, order: str) -> DataFrame:
    """Each row of a batch with `outcome`: created for the first of a new key, else duplicate."""
    first = batch.groupBy(key).agg(F.min(order).alias("gm_first"))
    known = existing.select(key).distinct().withColumn("gm_known", F.lit(True))
    rows = batch.join(first, key).join(known, key, "left")
    fresh = F.col("gm_known").isNull() & (F.col(order) == F.col("gm_first"))
    return rows.withColumn("outcome", F.when(fresh, "created").otherwise("duplicate")).drop("gm_first", "gm_known")


def without_keys(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key, exactly, is not listed; rows with a null key stay."""
    return rows.join(keys.select(key).distinct(), key, "left_anti")


def reconciled_deadline(stored: Column, found: Column, confidence: Column) -> Column:
    """struct(deadline, method, outcome) of a stored deadline and one found by a model.

    High confidence overwrites, medium only fills a gap, everything else leaves what is stored.
    """
    fills = (confidence == "MEDIUM") & found.isNotNull() & stored.isNull()
    wins = (confidence == "HIGH") & found.isNotNull()
    differs = (confidence == "MEDIUM") & found.isNotNull() & stored.isNotNull()
    return F.struct(
        F.when(wins | fills, found).otherwise(stored).alias("deadline"),
        F.when(wins | fills, F.lit("ai")).when(differs, F.lit("merged")).otherwise(F.lit("regex")).alias("method"),
        F.when(wins, F.lit("overwritten")).when(fills, F.lit("filled")).when(differs & (stored != found), F.lit("disagreement")).otherwise(F.lit("unchanged")).alias("outcome"),
    )


def later_of(a: Column, b: Column) -> Column:
    """The later of two moments, or the one that is there."""
    return F.greatest(a, b)


def merged_maps(base: Column, over: Column) -> Column:
    """A map with the entries of another laid over it; a null map counts as empty."""
    empty = F.create_map().cast("map<string,string>")
    a, b = F.coalesce(base, empty), F.coalesce(over, empty)
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)


def two_key_dedupe(rows: DataFrame, group: str, first_key: str, second_key: str, order: str) -> DataFrame:
    """Rows of each group kept in order while neither of their keys was kept before.

    A row that is skipped doesn't record its keys, so the rule is sequential; but only rows of a
    group that share a key, over any number of steps, matter to each other. Each such component
    is walked on its own, with the keys as hashes, and the kept rows are joined back. Null keys
    never clash. The order must be unique.
    """
    kind = rows.schema[order].dataType.simpleString()
    own = lambda c: F.when(F.col(c).isNotNull(), F.concat_ws("\u0001", F.coalesce(F.col(group).cast("string"), F.lit("\u0002")), F.col(c).cast("string")))
    keys = stage(rows.select(F.col(order).alias("gm_order"), own(first_key).alias("a"), own(second_key).alias("b")), "two-keys")
    nodes = stage(keys.groupBy("a", "b").agg(F.min(F.col("gm_order").cast("string")).alias("node"), F.min("gm_order").alias("gm_order")), "two-key-nodes")
    # of rows with the same keys only the first can be kept, unless both are null
    labels = components(nodes.where("a is not null or b is not null"), "node", "a", "b")
    lone = keys.where("a is null and b is null").select("gm_order")

    def walk(g: pd.DataFrame) -> pd.DataFrame:
        seen_a, seen_b, out = set(), set(), []
        for o, a, b in g.sort_values("gm_order")[["gm_order", "a", "b"]].itertuples(index=False, name=None):
            a, b = (None if pd.isna(x) else x for x in (a, b))
            if (a is not None and a in seen_a) or (b is not None and b in seen_b):
                continue
            seen_a.add(a)
            seen_b.add(b)
            out.append(o)
        return pd.DataFrame({"gm_order": out})

    text = lambda c: F.when(F.col(c).isNotNull(), F.xxhash64(c).cast("string")).alias(c)
    kept = nodes.join(labels, "node").select("label", "gm_order", text("a"), text("b")).groupBy("label").applyInPandas(walk, f"gm_order {kind}")
    return rows.join(kept.unionByName(lone).withColumnRenamed("gm_order", order), order, "left_semi")
