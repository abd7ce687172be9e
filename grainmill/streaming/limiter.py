"""A counter of hits per key in windows that begin with the first hit.

The window is not aligned to the clock and not a session: it opens with a hit, lasts a fixed
time, and the next hit after its end opens a new one. Every hit counts, refused ones too.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

DECISION = StructType([StructField("event_id", LongType()), StructField("user_id", LongType()), StructField("us", LongType()), StructField("nth", LongType()), StructField("allowed", BooleanType())])


def step(start: int | None, count: int, now: int, window_us: int) -> tuple[int, int]:
    """(start, count) of the window that a hit falls into; at exactly its end a window still holds."""
    if start is None or now > start + window_us:
        return now, 1
    return start, count + 1


def limited(events: DataFrame, window_us: int, most: int) -> DataFrame:
    """(event_id, user_id, us, nth, allowed) of a finished table of events (event_id, user_id, ts).

    Each user's hits are walked in the order of time and id. The walk carries two numbers, so
    it runs over sorted partitions and no user is gathered into memory.
    """
    rows = events.select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    rows = rows.repartition("user_id").sortWithinPartitions("user_id", "us", "event_id")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, start, count, seen = None, None, 0, False
        for b in batches:
            nth = []
            for u, us in zip(b.user_id, b.us):
                u = None if pd.isna(u) else u
                if not seen or u != user:
                    user, start, count, seen = u, None, 0, True
                start, count = step(start, count, us, window_us)
                nth.append(count)
            b = b.assign(nth=nth)
            yield b.assign(allowed=b.nth <= most)

    return rows.mapInPandas(walk, DECISION)


class WindowCounter(StatefulProcessor):
    """The same count as stream state: start and count per key, forgotten when a key has not been seen for so long."""

    def __init__(self, window_us: int, most: int, keep_ms: int):
        self.window_us, self.most, self.keep_ms = window_us, most, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("window", StructType([StructField("start", LongType()), StructField("count", LongType())]), self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        start, count = self.state.get() if self.state.exists() else (None, 0)
        for b in rows:
            b = b.sort_values(["us", "event_id"])
            nth = []
            for us in b.us:
                start, count = step(start, count, int(us), self.window_us)
                nth.append(count)
            out = pd.DataFrame({"event_id": b.event_id, "user_id": b.user_id, "us": b.us, "nth": nth})
            out["allowed"] = out.nth <= self.most
            yield out
        if start is not None:
            self.state.update((start, count))

    def close(self) -> None:
        pass


def limit_stream(events: DataFrame, window_us: int, most: int, keep_ms: int | None = None) -> DataFrame:
    """Decisions for a stream of events; hits count in the order of their micro-batches.

    The state of a key that no hit came for during `keep_ms`, twice the window unless given, is
    dropped, so the state holds the keys of late only.
    """
    keep_ms = max(1, 2 * window_us // 1000) if keep_ms is None else keep_ms
    rows = events.select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return rows.groupBy("user_id").transformWithStateInPandas(statefulProcessor=WindowCounter(window_us, most, keep_ms), outputStructType=DECISION, outputMode="Append", timeMode="ProcessingTime")
