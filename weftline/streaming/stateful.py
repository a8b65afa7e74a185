"""Folds over the rows of a key as stateful streams: resource versions with diffs, and request windows."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from weftline.streaming.cdc import with_diff

DIFF = "added array<string>, removed array<string>, added_count int, removed_count int, change_ratio double, major boolean"
VERSIONED = "event_id string, operation string, resource string, seq long, success boolean, diff string, version long"
LIMITED = "client string, seq long, ts timestamp, allowed boolean"
#: State needs this store; its files lie under the query's checkpoint.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_store(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class Versions(StatefulProcessor):
    """A counter for each resource: an event that was applied gets the next number, a failed one gets none."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.version = handle.getValueState("version", "version long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.version.get()
        at = held[0] if held else 0
        # a batch's events of one key, in order; its size is bounded by the source's limit a trigger
        batch = pd.concat(list(rows)).sort_values("seq", kind="stable")
        numbers = at + batch["success"].astype("int64").cumsum()
        self.version.update((int(numbers.iloc[-1]),))
        yield batch[["event_id", "operation", "resource", "seq", "success", "diff"]].assign(version=numbers.where(batch["success"]).astype("Int64"))

    def close(self) -> None:
        pass


def versioned(events: DataFrame) -> DataFrame:
    """The event step of a change stream: event_id, operation, resource, seq, success, diff, version.

    ``events`` has event_id, operation, resource, seq, success, before, after. The line diff of
    an update is made from the event's own images; the version of a resource rises by one
    with each success, over all batches and restarts, and is null for a failure. Events of a
    resource are taken in ``seq`` order within a batch, batches in the order of the source;
    a null success is a failure, and events of a null resource share one counter.
    """
    use_store(events.sparkSession)
    rows = with_diff(events).select("event_id", "operation", "resource", F.col("seq").cast("long").alias("seq"), F.coalesce("success", F.lit(False)).alias("success"), F.to_json("diff").alias("diff"))
    numbered = rows.groupBy("resource").transformWithStateInPandas(Versions(), VERSIONED, "Append", "None")
    return numbered.withColumn("diff", F.from_json("diff", DIFF))


class Limiter(StatefulProcessor):
    """The times of a client's allowed requests within the window; a timer lets idle clients go."""

    def __init__(self, limit: int, window_s: int) -> None:
        self.limit, self.window = limit, window_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "times array<double>, timer long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.kept.get()
        kept, timer = (deque(held[0]), held[1]) if held else (deque(), 0)
        batch = pd.concat(list(rows)).sort_values(["ts", "seq"], kind="stable")
        ok = []
        for t in batch["ts"].astype("int64") / _per_second(batch["ts"]):
            while kept and kept[0] < t - self.window:
                kept.popleft()
            ok.append(len(kept) < self.limit)
            if ok[-1]:
                kept.append(t)
        if timer:
            self.handle.deleteTimer(timer)
        timer = int((kept[-1] + self.window) * 1000) + 1 if kept else 0
        if timer:
            self.handle.registerTimer(timer)
        self.kept.update(([float(t) for t in kept], timer))
        yield batch[["client", "seq", "ts"]].assign(allowed=ok)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The whole window has passed without a request."""
        self.kept.clear()
        yield from ()

    def close(self) -> None:
        pass


def _per_second(ts: pd.Series) -> float:
    unit = getattr(ts.dt, "unit", "ns")
    return {"s": 1.0, "ms": 1e3, "us": 1e6, "ns": 1e9}[unit]


def limited(requests: DataFrame, limit: int = 60, window_s: int = 60, late: str = "0 seconds") -> DataFrame:
    """(client, seq, ts, allowed) of a stream of requests (client, seq, ts): at most ``limit`` allowed ones in a sliding window.

    Refused requests do not count. A client's state is the at most ``limit`` times of its
    window; a timer in event time drops it once the watermark has left them behind. Requests
    of a batch are judged in time order, batches in the order of the source.
    """
    use_store(requests.sparkSession)
    rows = requests.select(F.col("client").cast("string").alias("client"), F.col("seq").cast("long").alias("seq"), F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    return rows.groupBy("client").transformWithStateInPandas(Limiter(limit, window_s), LIMITED, "Append", "EventTime")
