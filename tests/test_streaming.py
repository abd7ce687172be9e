"""Streams against their batch versions."""

import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from grainmill.streaming.changes import follow_changes
from grainmill.streaming.limiter import limit_stream, limited

EVENTS = "event_id long, user_id long, ts timestamp_ntz"


def events(spark, path, rows):
    spark.createDataFrame([(i, u, datetime(2026, 1, 1) + timedelta(seconds=s)) for i, u, s in rows], EVENTS).coalesce(1).write.mode("append").parquet(path)


def decisions(spark, source, out, checkpoint, **options):
    rows = limit_stream(spark.readStream.schema(EVENTS).parquet(source), 60_000_000, 5, **options)
    rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return {(r.event_id, r.nth, r.allowed) for r in spark.read.parquet(out).collect()}


def test_limiter_as_a_stream_and_its_forgetting(spark, tmp_path, request):
    # state that expires asks for batches without data as well, which a run over what is there would never end
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled"))
    source, a = str(tmp_path / "in"), str(tmp_path / "a")
    hits = [(i, 1, i) for i in range(6)] + [(6, 2, 3), (7, 1, 60)]
    events(spark, source, hits)
    want = {(r.event_id, r.nth, r.allowed) for r in limited(spark.read.parquet(source), 60_000_000, 5).collect()}
    assert decisions(spark, source, f"{a}/out", f"{a}/check", keep_ms=1) == want
    time.sleep(1)
    events(spark, source, [(8, 1, 20)])
    # the key was dropped in between, so its window begins anew; with the usual time to live it would be the 8th
    assert (8, 1, True) in decisions(spark, source, f"{a}/out", f"{a}/check", keep_ms=1)


def test_changes_as_a_stream(spark, tmp_path):
    source, snapshot, check = (str(tmp_path / x) for x in ("in", "snapshot", "check"))
    kind = "url string, body string, captured_at timestamp, capture_id long"

    def step(rows):
        spark.createDataFrame([(u, b, datetime(2026, 1, d), d) for u, b, d in rows], kind).write.mode("append").parquet(source)
        follow_changes(spark.readStream.schema(kind).parquet(source), snapshot, check).awaitTermination()

    step([("a", "one", 1), ("b", "two", 1)])
    step([("a", "one", 2), ("b", "other", 2), ("c", None, 2)])
    step([("a", "one 1/2/2026", 3)])
    last = {r.url: r for r in spark.read.parquet(f"{snapshot}/version=3").collect()}
    assert last["b"].last_changed == datetime(2026, 1, 2) and last["a"].last_changed == datetime(2026, 1, 1) and last["a"].last_checked == datetime(2026, 1, 3) and last["c"].content_hash is None
    import os

    assert sorted(os.listdir(snapshot)) == ["version=2", "version=3"]
    assert spark.read.parquet(f"{snapshot}/version=3").where(F.col("url") == "a").count() == 1
