"""Streams with keyed state and timers: duplicates by two keys, and work that has gone quiet.

They need a state store that can hold several variables per key; ``state_store(spark)`` sets it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from timelinekit.functions.text import title_key

# ---- fixed values -------------------------------------------------------------------------
LATENESS_S = 30 * 3600
STALE_S = 3600
# -------------------------------------------------------------------------------------------

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class _FirstHolder(StatefulProcessor):
    """Remembers who first held a token, until ``horizon_ms`` of event time after it was last seen."""

    def __init__(self, horizon_ms: int):
        self.horizon_ms = horizon_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.holder = handle.getValueState("holder", "item_id string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["rank", "item_id"], kind="stable")
        late = batch["published"] < pd.Timestamp(timerValues.getCurrentWatermarkInMs(), unit="ms")
        batch = batch[~late]
        if batch.empty:
            return
        held = self.holder.get()[0] if self.holder.exists() else None
        if held is None:
            held = batch["item_id"].iloc[0]
            self.holder.update((held,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        newest = int(batch["published"].max().timestamp() * 1000)
        self.handle.registerTimer(max(newest, timerValues.getCurrentWatermarkInMs()) + self.horizon_ms)
        yield pd.DataFrame({"item_id": batch["item_id"], "published": batch["published"], "first": batch["item_id"] == held})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.holder.clear()
        return iter(())

    def close(self) -> None:
        pass


def _marks(items: DataFrame) -> DataFrame:
    """A row per item and token: its title key and its url."""
    tokens = F.array(F.concat(F.lit("title:"), title_key(F.col("title"))), F.concat(F.lit("url:"), F.col("url")))
    known = F.array_distinct(F.filter(tokens, lambda t: t.isNotNull()))
    return items.select(F.col("item_id").cast("string").alias("item_id"), F.explode(known).alias("token"), F.col("rank").cast("long").alias("rank"), "published")


def stream_first_items(items: DataFrame, lateness_s: int = LATENESS_S) -> DataFrame:
    """(item_id, published, first), one row per token of an item: whether it is the first to hold the token.

    ``items``: item_id, title, url, published, rank; the tokens are title key and url. A token is
    held by the first item of the earliest micro-batch that brings it (the smallest rank inside
    it) and is free again ``lateness_s`` of event time after it was last seen; items later than
    that are dropped. Repeated deliveries of an item agree with the first one. ``all_first`` unites
    an item's rows; with items in the order of rank that equals ``first_items`` of the whole table.
    Unlike ``first_wins``, an item blocks its tokens even where it was itself turned down.
    """
    marks = _marks(items.withWatermark("published", f"{lateness_s} seconds"))
    return marks.groupBy("token").transformWithStateInPandas(
        _FirstHolder(lateness_s * 1000), "item_id string, published timestamp, first boolean", "Append", "EventTime"
    )


def all_first(marks: DataFrame) -> DataFrame:
    """(item_id, first) of a table of marks: an item is first when it is so on every token."""
    return marks.groupBy("item_id").agg(F.bool_and("first").alias("first"))


def first_items(items: DataFrame) -> DataFrame:
    """(item_id, first): items that come first, by rank, on their title key and on their url."""
    marks = _marks(items)
    holders = marks.groupBy("token").agg(F.min(F.struct("rank", "item_id")).alias("_h"))
    return all_first(marks.join(holders, "token").withColumn("first", F.col("item_id") == F.col("_h.item_id")))


class _Heartbeat(StatefulProcessor):
    """Emits a job's last beat when none has followed for ``limit_ms`` of event time."""

    def __init__(self, limit_ms: int):
        self.limit_ms = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at_ms bigint, beats bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        beats = pd.concat(list(rows))["heartbeat_at"]
        at, seen = self.last.get() if self.last.exists() else (-1, 0)
        at = max(at, int(beats.max().timestamp() * 1000))
        self.last.update((at, seen + len(beats)))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(at + self.limit_ms, timerValues.getCurrentWatermarkInMs() + 1))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, seen = self.last.get()
        self.last.clear()
        yield pd.DataFrame({"job_id": [str(key[0])], "last_beat": [pd.Timestamp(at, unit="ms")], "beats": [seen]})

    def close(self) -> None:
        pass


def stream_quiet_jobs(beats: DataFrame, limit_s: int = STALE_S, late_s: int = 0) -> DataFrame:
    """(job_id, last_beat, beats): jobs that have gone quiet, once each time they do.

    ``beats``: job_id, heartbeat_at. A job's timer moves with its latest beat; beats that come late
    or twice never move it back. A beat after the alarm opens a new watch. State is two numbers
    per job that is alive.
    """
    watched = beats.withWatermark("heartbeat_at", f"{late_s} seconds").select(F.col("job_id").cast("string").alias("job_id"), "heartbeat_at")
    return watched.groupBy("job_id").transformWithStateInPandas(
        _Heartbeat(limit_s * 1000), "job_id string, last_beat timestamp, beats bigint", "Append", "EventTime"
    )
