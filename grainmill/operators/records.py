"""Changes to stored records: partial updates, closing, removal, upserts of small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most records that one request may remove, and how many of them it may without saying so twice (fixed values).
MOST_REMOVED, UNCONFIRMED = 100, 10


def blank_to_null(text: Column) -> Column:
    """A trimmed text, null if nothing is left."""
    return F.nullif(F.trim(text), F.lit(""))


def tidy_list(values: Column) -> Column:
    """The trimmed entries of a list that say something, in order."""
    return F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v.isNotNull() & (v != ""))


def patched(rows: DataFrame, patches: DataFrame, key: str, texts: tuple[str, ...] = (), lists: tuple[str, ...] = ()) -> DataFrame:
    """Rows with the fields that a patch names.

    `patches` has the key, `fields` (the names that the patch sets) and the new values. Blank
    texts clear a field, lists lose empty entries, fields that aren't named stay.
    """
    values = [c for c in patches.columns if c not in (key, "fields")]
    kinds = {c: blank_to_null if c in texts else tidy_list if c in lists else (lambda x: x) for c in values}
    asked = patches.select(key, F.col("fields").alias("gm_fields"), *[F.col(c).alias(f"gm_{c}") for c in values])
    both = rows.join(asked, key, "left")
    named = lambda c: F.coalesce(F.array_contains("gm_fields", c), F.lit(False))
    return both.select(*[F.when(named(c), kinds[c](F.col(f"gm_{c}"))).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in rows.columns])


def removed(rows: DataFrame, ids: list, key: str, confirmed: bool = False) -> DataFrame:
    """Rows without those of the given keys; many at once need a confirmation, too many are refused."""
    ids = list(dict.fromkeys(ids))
    if not 1 <= len(ids) <= MOST_REMOVED:
        raise ValueError(f"between 1 and {MOST_REMOVED} records can be removed at once")
    if len(ids) > UNCONFIRMED and not confirmed:
        raise ValueError(f"more than {UNCONFIRMED} records are removed only if confirmed")
    return rows.where(~F.coalesce(F.col(key).isin(ids), F.lit(False)))


def upserted(stored: DataFrame, batch: DataFrame, key: str, overwritten: tuple[str, ...], order: str | None = None) -> DataFrame:
    """A table after a batch: known keys take the given columns, new keys come in whole; of rows of one key the last by `order` counts."""
    last = batch if order is None else batch.groupBy(key).agg(*[F.max_by(c, order).alias(c) for c in batch.columns if c not in (key, order)])
    columns = [c for c in stored.columns if c != key]
    both = stored.withColumn("gm_old", F.lit(True)).alias("o").join(last.alias("n"), key, "full_outer")
    new = lambda c: F.col(f"n.{c}") if c in last.columns else F.lit(None)
    return both.select(key, *[F.when(F.col("o.gm_old").isNull(), new(c)).when(F.col(f"n.{overwritten[0]}").isNotNull(), new(c) if c in overwritten else F.col(f"o.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in columns])


def incremented(rows: DataFrame, column: str, by: int = 1) -> DataFrame:
    """Every row with a number raised."""
    return rows.withColumn(column, F.col(column) + by)


def closed(raw: Column, method: Column, status: Column, reason: Column, at: Column) -> Column:
    """The raw data, a map of JSON texts, of a record that is closed: without its live text, with why it was closed."""
    empty = F.create_map().cast("map<string,string>")
    kept = F.map_filter(F.coalesce(raw, empty), lambda k, v: ~k.isin("liveBodyText", "closedReason"))
    why = F.to_json(F.struct(method.alias("method"), status.alias("status"), reason.alias("reason"), at.alias("at")))
    return F.map_concat(kept, F.create_map(F.lit("closedReason"), why))


def rejected(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Rows with reject_reason, the first check that fails, so that a bad row is set aside and the others go on."""
    reason = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()])
    return rows.withColumn("reject_reason", reason)
