"""What changed between captures of the same thing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.functions.text import content_hash


def latest_capture(captures: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """The last capture of each key, by aggregation."""
    row = F.struct(*[F.col(c) for c in captures.columns])
    return captures.groupBy(key).agg(F.max_by(row, F.struct(at, tie)).alias("r")).select("r.*")


def detect_changes(snapshot: DataFrame, captures: DataFrame, key: str = "url", text: str = "body") -> DataFrame:
    """The snapshot (key, content_hash, last_changed, needs_reparse) after new captures (key, body, captured_at).

    A hash that differs, a missing one included, sets last_changed and needs_reparse; keys
    without a capture, or whose capture has no text, stay untouched.
    """
    new = captures.where(F.col(text).isNotNull()).select(key, content_hash(F.col(text)).alias("gm_hash"), F.col("captured_at").alias("gm_at"))
    rows = snapshot.join(new, key, "left")
    differs = F.col("gm_at").isNotNull() & ~F.col("gm_hash").eqNullSafe(F.col("content_hash"))
    return rows.select(
        key,
        F.coalesce("gm_hash", "content_hash").alias("content_hash"),
        F.coalesce("gm_at", "last_checked").alias("last_checked"),
        F.when(differs, F.col("gm_at")).otherwise(F.col("last_changed")).alias("last_changed"),
        (differs | F.coalesce("needs_reparse", F.lit(False))).alias("needs_reparse"),
    )
