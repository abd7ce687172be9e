"""The ledger of runs: which one holds the lock, how it ended, what came last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Minutes after which a run that never ended no longer holds the lock (fixed value).
STALE_MINUTES = 10


def locked(ledger: DataFrame, as_of: Column, status: str = "status", started: str = "started_at") -> DataFrame:
    """The ledger before a new run: `holds` for running ones that are fresh; older running ones have failed."""
    running = F.col(status) == "running"
    fresh = F.col(started) >= as_of - F.expr(f"INTERVAL {STALE_MINUTES} MINUTE")
    return ledger.withColumns({"holds": F.coalesce(running & fresh, F.lit(False)), status: F.when(running & ~fresh, F.lit("failed")).otherwise(F.col(status))})


def finished(ledger: DataFrame, run: Column, log: DataFrame, as_of: Column) -> DataFrame:
    """The ledger with one run ended: success, the moment, and the sum of what its sources found."""
    total = log.agg(F.sum("found")).first()[0] or 0  # one number
    own = F.coalesce(run, F.lit(False))
    return ledger.withColumns({"status": F.when(own, F.lit("success")).otherwise(F.col("status")), "finished_at": F.when(own, as_of).otherwise(F.col("finished_at")), "found": F.when(own, F.lit(total).cast("bigint")).otherwise(F.col("found"))})


def last_runs(ledger: DataFrame, most: int = 10, started: str = "started_at", key: str = "run_id") -> DataFrame:
    """The most recent runs, latest first."""
    return ledger.orderBy(F.desc(started), F.desc(key)).limit(most)
