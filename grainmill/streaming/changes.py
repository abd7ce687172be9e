"""Captures as a stream, merged into a snapshot per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from grainmill.operators.change import detect_changes, latest_capture

#: Versions of the snapshot that stay readable.
KEPT = 2
SNAPSHOT = "{key} string, content_hash string, last_checked timestamp, last_changed timestamp, needs_reparse boolean"


def _version(spark: SparkSession, path: str, number: int):
    """The folder of a version as a path of the file system, and that file system."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version={number}")
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def follow_changes(captures: DataFrame, snapshot_path: str, checkpoint: str, key: str = "url") -> StreamingQuery:
    """Keep the newest snapshot version under a path while captures (key, body, captured_at, capture_id) stream in.

    Each micro-batch reads the last version, or nothing at first, and writes the next as a
    folder of its number, so a batch that is repeated overwrites its own version only and
    readers never see half a one. Keys that the snapshot lacks come in as changed. Of the
    versions the last KEPT stay.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        folder, files = _version(spark, snapshot_path, number)
        base = spark.read.parquet(str(folder)) if files.exists(folder) else spark.createDataFrame([], SNAPSHOT.format(key=key))
        latest = latest_capture(batch, key, "captured_at", "capture_id")
        fresh = latest.select(key).join(base.select(key), key, "left_anti")
        after = detect_changes(base.unionByName(fresh, allowMissingColumns=True), latest, key)
        after.write.mode("overwrite").parquet(f"{snapshot_path}/version={number + 1}")
        if number + 1 > KEPT:
            old, files = _version(spark, snapshot_path, number + 1 - KEPT)
            files.delete(old, True)

    return captures.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
